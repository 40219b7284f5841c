"""Chat formats, packing and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import conversations as C
from tessera.operators import packing as P
from tessera.registry import Tables, query
from tessera.shipping import ship


def chats(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("x"))
    return turns.select("conv_id", F.transform("x", lambda m: C.message(m["role"], m["content"])).alias("messages"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS sys, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lead FROM conversations), t AS (
  SELECT *, CASE WHEN lead = 'system' THEN i - 1 ELSE i END AS k, lead = 'system' AND i = 1 AS drop FROM c), g AS (
  SELECT conv_id, count(*) AS n, bool_and(role = CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AS alternates FROM t WHERE NOT drop GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN coalesce(n, 0) > 0 AND n % 2 = 0 AND alternates THEN n - 1 ELSE 0 END::BIGINT AS n_prompt, CASE WHEN coalesce(n, 0) > 0 AND n % 2 = 0 AND alternates THEN 1 ELSE 0 END::BIGINT AS n_response
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN g USING (conv_id)
""")
def convert_sharegpt(t: Tables) -> DataFrame:
    rows = C.CONVERTERS["sharegpt"](chats(t))
    return rows.select("conv_id", F.size("_prompt").cast("long").alias("n_prompt"), F.size("_response").cast("long").alias("n_response"))


@query("""
SELECT doc_id, md5(text || chr(10) || source) AS asked, 1::BIGINT AS n_response FROM documents
""")
def convert_alpaca(t: Tables) -> DataFrame:
    rows = C.CONVERTERS["alpaca"](t.documents, "text", "source", "lang")
    return rows.select("doc_id", F.md5(F.get("_prompt", F.lit(0))["content"]).alias("asked"), F.size("_response").cast("long").alias("n_response"))


@query("""
SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS rendered, count(*)::BIGINT AS n_parsed FROM conversations GROUP BY conv_id
""")
def render_and_parse_chatml(t: Tables) -> DataFrame:
    rows = chats(t).withColumn("text", C.chatml(F.col("messages")))
    return rows.select("conv_id", F.md5("text").alias("rendered"), F.size(C.from_chatml(F.col("text"))).cast("long").alias("n_parsed"))


@query("""
WITH r AS (SELECT conv_id, turn, md5(text) AS a, conv_id // 10 AS b FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, coalesce(lag(a) OVER (PARTITION BY b ORDER BY conv_id, turn), last_value(a) OVER (PARTITION BY b ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS mismatched FROM r
""")
def mismatched_answer_pairs(t: Tables) -> DataFrame:
    rows = t.conversations.where("role = 'assistant'").withColumn("a", F.md5("text"))
    return C.mismatched_answers(rows, ["conv_id", "turn"], "a", F.floor(F.col("conv_id") / 10)).select("conv_id", "turn", "mismatched")


@query("""
WITH l AS (SELECT doc_id, n_chars::INTEGER AS s, (n_chars // 7)::INTEGER AS t FROM documents), r AS (
  SELECT *, CASE WHEN t * 2 < 1024 THEN 1024 WHEN s * 2 < 1024 THEN 1024 - s ELSE trunc(1024 * (t / (s + t)))::INTEGER END AS room FROM l)
SELECT doc_id, least(greatest(1024 - least(room, t), 0), s)::INTEGER AS kept_source, least(room, t)::INTEGER AS kept_target FROM r
""")
def truncation_lengths(t: Tables) -> DataFrame:
    s, a = C.most_lengths(F.col("n_chars").cast("int"), F.floor(F.col("n_chars") / 7).cast("int"), 1024)
    return t.documents.select("doc_id", s.alias("kept_source"), a.alias("kept_target"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id // 1000 AS b, list({'n': n_chars, 'k': doc_id} ORDER BY n_chars, doc_id) FILTER (n_chars <= 8192) AS free FROM documents GROUP BY 1),
r AS (SELECT b, free, 8192::BIGINT AS room, 0 AS pack, 0 AS next_place, 0::BIGINT AS next_at, NULL::BIGINT AS k, NULL::BIGINT AS n, NULL::INTEGER AS place, NULL::BIGINT AS began FROM d UNION ALL
  SELECT b, CASE WHEN c > 0 THEN free[1:c - 1] || free[c + 1:] ELSE free END, CASE WHEN c > 0 THEN room - free[c].n ELSE 8192 END, pack + (c = 0)::INTEGER, CASE WHEN c > 0 THEN next_place + 1 ELSE 0 END, CASE WHEN c > 0 THEN next_at + free[c].n ELSE 0 END,
    CASE WHEN c > 0 THEN free[c].k END, CASE WHEN c > 0 THEN free[c].n END, next_place, next_at FROM (SELECT *, len(list_filter(free, lambda x: x.n <= room)) AS c FROM r) WHERE len(free) > 0)
SELECT b AS batch, pack, place, k AS doc_id, n AS n_chars, began AS "offset" FROM r WHERE k IS NOT NULL
""")
def pack_sequences(t: Tables) -> DataFrame:
    ship(t.spark)
    return P.packed(t.documents, "doc_id", "n_chars", F.floor(F.col("doc_id") / 1000), 8192)


@query(None)
def balance_sequences(t: Tables) -> DataFrame:
    ship(t.spark)
    return P.balanced(t.documents, "doc_id", "n_chars", F.floor(F.col("doc_id") / 500), 8)


@query("""
SELECT doc_id, (24576 * n_chars + n_chars * n_chars)::BIGINT AS cost FROM documents
""")
def sequence_workload(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.workload(F.col("n_chars")).cast("long").alias("cost"))


@query("""
WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 ELSE 1 END AS ok, value FROM events)
SELECT count(CASE WHEN value > 20 THEN 1 END)::BIGINT AS long_delta, count(CASE WHEN ok = 1 THEN 1 END)::BIGINT AS first_anchor FROM x
""")
def training_filter_reasons(t: Tables) -> DataFrame:
    text = F.concat(
        F.when(F.col("event_id") % 3 == 0, '<anchor t="0.0-1.0"></anchor>').otherwise('<anchor t="2.0-3.0"></anchor>'),
        F.format_string('<delta t="1.00-%.2f">x</delta>', F.col("value") + 1),
    )
    reasons = t.events.select(F.explode(C.hard_reasons(text)).alias("r"))
    return reasons.agg(F.count_if(F.col("r") == "long_delta").alias("long_delta"), F.count_if(F.col("r") == "first_anchor").alias("first_anchor"))
