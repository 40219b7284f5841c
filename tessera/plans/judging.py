"""Queries on free-text judging, timelines and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import judging as J
from tessera.functions import mathematics as X
from tessera.operators import metrics as M
from tessera.operators import timeline as L
from tessera.registry import Tables, query, seconds
from tessera.shipping import ship


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS same FROM part
""")
def open_answers(t: Tables) -> DataFrame:
    ship(t.spark)
    k = F.col("p_size") % 4
    answer = F.when(k == 0, F.concat(F.lit("A) The "), "p_name", F.lit(" is on a table."))).when(k == 1, "I cannot answer that question").when(
        k == 2, F.concat(F.lit("on a table there is the "), "p_name", F.lit(" shown")),
    ).otherwise("blue")
    gold = F.concat(F.lit("the "), "p_name", F.lit(" is on a table"))
    return t.part.select("p_partkey", J.open_answer(answer, gold).alias("same"))


@query("""
SELECT p_partkey, '\\frac{' || p_size || '}{4}' AS answer, true AS same FROM part
""")
def boxed_math(t: Tables) -> DataFrame:
    ship(t.spark)
    text = F.concat(F.lit("so \\boxed{1} or rather $\\boxed{\\frac{"), F.col("p_size").cast("string"), F.lit("}{4}}$."))
    box = J.boxed_answer(text)
    return t.part.select("p_partkey", box.alias("answer"), X.math_equal(box, F.concat(F.lit("x = "), (F.col("p_size") * 25 / 100).cast("string"))).alias("same"))


@query("""
SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS found, (props->>'$.k')::INTEGER % 2 = 0 AS correct FROM events
""")
def json_in_prose(t: Tables) -> DataFrame:
    ship(t.spark)
    text = F.concat(F.lit("```json\nSure [: "), F.col("props"), F.lit("\n```"))
    k = F.get_json_object("props", "$.k").cast("int") % 2
    judge = F.concat(F.lit('I say {"correct": '), F.when(k == 0, '"Yes"').otherwise("0.2"), F.lit("}"))
    return t.events.select("event_id", J.json_in(text).alias("found"), J.judged(judge).alias("correct"))


@query("""
SELECT item_id, 1.0::DOUBLE AS bleu4, 1.0::DOUBLE AS rouge_l FROM benchmark
""")
def overlap_scores(t: Tables) -> DataFrame:
    ship(t.spark)
    s = J.overlap_scores(F.col("text"), F.col("text"))
    return t.benchmark.select("item_id", s.alias("s")).select("item_id", F.round("s.bleu4", 6).alias("bleu4"), F.round("s.rouge_l", 6).alias("rouge_l"))


@query("""
WITH s AS (SELECT user_id, value AS v, list(value) OVER (PARTITION BY user_id) AS vs, event_id FROM events)
SELECT event_id, list_max(list_filter(vs, lambda x: x < v)) AS previous, list_min(list_filter(vs, lambda x: x > v)) AS next FROM s
""")
def previous_and_next(t: Tables) -> DataFrame:
    lists = t.events.groupBy("user_id").agg(F.collect_set("value").alias("vs"))
    rows = t.events.select("event_id", "user_id", "value").join(lists, "user_id")
    return rows.select("event_id", L.neighbours(F.col("vs"), F.col("value")).alias("n")).select("event_id", "n.previous", "n.next")


@query("""
WITH s AS (SELECT conv_id AS video, turn AS i, turn * 5.0 AS a, turn * 5.0 + 5 AS b FROM conversations), e AS (SELECT event_id, user_id % 100 AS video, value AS v FROM events)
SELECT event_id, coalesce(min(CASE WHEN a < v AND v <= b THEN i END), min(CASE WHEN b >= v THEN i END), max(i)) AS step_index FROM e LEFT JOIN s USING (video) GROUP BY event_id
""")
def step_of_event(t: Tables) -> DataFrame:
    steps = t.conversations.select(F.col("conv_id").alias("video"), F.col("turn").alias("step_index"), (F.col("turn") * 5.0).alias("step_start"), (F.col("turn") * 5.0 + 5).alias("step_end"))
    return L.step_at(steps, t.events.select("event_id", (F.col("user_id") % 100).alias("video"), "value"), ["video"], "value").select("event_id", "step_index")


@query("""
SELECT event_id, floor(value)::BIGINT AS t, CASE WHEN event_id % 3 = 0 THEN 3 ELSE greatest(least(floor(value)::BIGINT + 2, 150), greatest(floor(value)::BIGINT - 2, 0)) - greatest(floor(value)::BIGINT - 2, 0) + 1 END::BIGINT AS n FROM events
""")
def evidence_or_frames_around(t: Tables) -> DataFrame:
    v = F.floor("value")
    evidence = F.when(F.col("event_id") % 3 == 0, F.array(*(F.lit(x).cast("long") for x in (9, 3, 5, 3)))).otherwise(F.array().cast("array<bigint>"))
    frames = L.around(evidence, v, F.lit(0).cast("long"), F.lit(150).cast("long"))
    return t.events.select("event_id", v.alias("t"), F.size(frames).cast("long").alias("n"))


@query("""
WITH q AS (SELECT o_orderkey, list(struct_pack(k := l_linenumber, s := l_partkey) ORDER BY l_linenumber, l_partkey) AS qs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, string_agg(coalesce(CASE WHEN i % 2 = 1 THEN round(i * 0.5, 1)::VARCHAR END, '-'), ',' ORDER BY i) AS scores FROM (SELECT o_orderkey, unnest(range(0, len(qs))) AS i FROM q) GROUP BY o_orderkey
""")
def scores_into_nested_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("s")))).alias("qs")
    ).join(t.orders.select("o_orderkey"), "o_orderkey")
    n = rows.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.size("qs") - 1)).alias("i")).where("i % 2 = 1")
    out = L.scores_written_back(rows, ["o_orderkey"], "qs", n.withColumn("score", F.round(F.col("i") * 0.5, 1)), "i", ["score"])
    return out.select("o_orderkey", F.array_join(F.transform("qs", lambda q: F.coalesce(q["score"].cast("string"), F.lit("-"))), ",").alias("scores"))


@query("""
WITH p AS (SELECT vec_id, -abs(embedding[i]::DOUBLE) AS a, -abs(embedding[i + 32]::DOUBLE) AS b FROM embeddings, (SELECT unnest(range(1, 33)) AS i)), r AS (
  SELECT vec_id, exp(-sum(a) / (32 + 1e-8)) AS ppl_new, exp(-sum(b) / (32 + 1e-8)) AS ppl_old, -sum(a - b) / (32 + 1e-8) AS kl, sum(exp(a - b) - (a - b) - 1) / (32 + 1e-8) AS k3, sum(exp(2 * (a - b))) / (32 + 1e-8) - 1 AS chi2 FROM p GROUP BY vec_id)
SELECT round(avg(ppl_new), 6) AS ppl_new, round(avg(ppl_old), 6) AS ppl_old, round(avg(kl), 6) AS kl, round(avg(k3), 6) AS k3, round(avg(chi2), 6) AS chi2 FROM r
""")
def off_policy_metrics(t: Tables) -> DataFrame:
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: -F.abs(x))
    rows = t.embeddings.select(F.slice(v, 1, 32).alias("a"), F.slice(v, 33, 32).alias("b"), F.array_repeat(F.lit(1.0), 32).alias("m"))
    out = M.off_policy(rows, "a", "b", "m")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""
SELECT m AS metric, round(avg(v), 4) AS mean, max(v)::DOUBLE AS max, min(v)::DOUBLE AS min FROM (SELECT unnest(['n_chars', 'doc_id']) AS m, unnest([n_chars, doc_id]) AS v FROM documents) GROUP BY m
""")
def metric_spread(t: Tables) -> DataFrame:
    return M.spread(t.documents, ["n_chars", "doc_id"]).select("metric", F.round("mean", 4).alias("mean"), "max", "min")


@query("""
SELECT round(avg((n_chars >= 4000)::INTEGER), 6) AS clip_ratio, round(avg((n_chars = 0)::INTEGER), 6) AS aborted_ratio, round(1 - var_samp(n_chars - doc_id) / (var_samp(n_chars) + 1e-5), 6) AS explained_variance FROM documents
""")
def rollout_data_metrics(t: Tables) -> DataFrame:
    out = M.data_metrics(t.documents, "n_chars", 4000, "n_chars", "doc_id")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""
WITH r AS (SELECT event_type AS s, user_id AS u, value AS v, count(*) OVER (PARTITION BY event_type, user_id) AS n, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) AS k FROM events), p AS (
  SELECT s, u, avg(v) AS mean, stddev_pop(v) AS std, sum(v * (pow(k / n, 4) - pow((k - 1) / n, 4))) AS best, sum(v * (pow((n - k + 1) / n, 4) - pow((n - k) / n, 4))) AS worst FROM r GROUP BY ALL)
SELECT s AS source, 'mean' AS metric, round(avg(mean), 4) AS value FROM p GROUP BY s UNION ALL SELECT s, 'std', round(avg(std), 4) FROM p GROUP BY s UNION ALL SELECT s, 'best@4', round(avg(best), 4) FROM p GROUP BY s UNION ALL SELECT s, 'worst@4', round(avg(worst), 4) FROM p GROUP BY s
""")
def validation_metrics(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("source"), "user_id", "value", (F.col("event_id") % 3).alias("a"), "event_id")
    return M.validation(rows, "source", "user_id", "value", "a", "event_id", [4]).where("metric <> 'maj'").select("source", "metric", F.round("value", 4).alias("value"))


@query("""
WITH p AS (SELECT vec_id, vec_id % 25 AS g, i - 1 AS place, embedding[i]::DOUBLE AS r, abs(embedding[i + 8]::DOUBLE) AS w FROM embeddings, (SELECT unnest(range(1, 9)) AS i)), s AS (
  SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY place) AS ww, sum(r) OVER (PARTITION BY vec_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gg FROM p)
SELECT vec_id, place::INTEGER AS place, round(gg - CASE WHEN count(*) OVER x > 1 THEN sum(gg * ww) OVER x / (sum(ww) OVER x + 1e-8) ELSE 0 END, 6) AS advantage FROM s WINDOW x AS (PARTITION BY g, place)
""")
def optimal_token_baseline(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select("vec_id", (F.col("vec_id") % 25).alias("g"), F.slice(v, 1, 8).alias("r"), F.transform(F.slice(v, 9, 8), F.abs).alias("w"))
    return M.token_baseline(rows, "vec_id", "g", "r", "w").select("vec_id", "place", F.round("advantage", 6).alias("advantage"))


@query("""
WITH f AS (SELECT user_id, min_by(value, (ts, event_id)) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, printf('%.2f', v) AS answer, (10 + 2 >= v AND 10 - 2 <= v + 5) AS in_time FROM f
""")
def first_answer_in_time(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'purchase'").select(
        "user_id", F.struct(seconds("ts"), F.col("event_id")).alias("o"), F.format_string("%.2f", "value").alias("answer"), F.col("value").alias("a"),
        (F.col("value") + 5).alias("b"), F.lit(10.0).alias("due"),
    )
    return L.first_answer_in_time(rows, ["user_id"], "o", "answer", "a", "b", "due")
