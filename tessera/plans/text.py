"""Text functions and scorers over documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.functions import scorers as S
from tessera.functions import text as T
from tessera.registry import Tables, query, seconds


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS simple, sha1(concat_ws(chr(9), source, lang)) [1:12] AS short_hash,
       regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9._-]+', '_', 'g') AS name
FROM documents
""")
def text_normalised(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.md5(T.simple(F.col("text"))).alias("simple"), T.stable_hash(F.col("source"), F.col("lang")).alias("short_hash"),
        T.safe_name(F.concat("source", F.lit(" / "), "lang")).alias("name"),
    )


@query(r"""
WITH w AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), '[!-/:-@\[-`{-~]', '', 'g') AS x FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(x, '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))) AS em FROM w
WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')
""")
def text_exact_match_form(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").select("doc_id", F.md5(T.exact_match_text(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).alias("em"))


@query(r"""
SELECT conv_id, turn, CASE WHEN y AND NOT n THEN 'YES' WHEN n AND NOT y THEN 'NO' END AS said FROM (
  SELECT conv_id, turn, regexp_matches(x, '\b(YES|Y)\b') AS y, regexp_matches(x, '\b(NO|N)\b') AS n FROM (
    SELECT conv_id, turn, upper(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')) AS x FROM conversations)
)
""")
def yes_no_answers(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.yes_no(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).alias("said"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN chr((65 + p_size % 4)::INTEGER) ELSE chr((64 + (p_size % 4) + 1)::INTEGER) END AS letter FROM part
""")
def mcq_choice(t: Tables) -> DataFrame:
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("answer ("), F.char(65 + F.col("p_size") % 4), F.lit(").")))
    said = said.otherwise(F.concat(F.lit("number 77 or "), (F.col("p_size") % 4 + 1).cast("string")))
    return t.part.select("p_partkey", T.choice(said).alias("letter"))


@query("""
SELECT e.event_id, CASE WHEN v % 2 = 0 THEN (v / 60)::BIGINT * 60.0 + v % 60 ELSE v::DOUBLE END AS secs FROM (
  SELECT event_id, floor(value)::BIGINT - floor(value)::BIGINT % 1 AS v FROM events) AS e
""".replace("(v / 60)::BIGINT", "(v // 60)"))
def clock_to_seconds(t: Tables) -> DataFrame:
    v = F.floor("value")
    text = F.when(v % 2 == 0, F.format_string("%02d:%02d", F.floor(v / 60), v % 60)).otherwise(v.cast("string"))
    return t.events.select("event_id", R.clock_seconds(text).alias("secs"))


@query("""
SELECT event_id, floor(value * 3.0 + 0.5) / 3.0 AS fps_time, floor(value + 0.5)::BIGINT AS half_up, round_even(value::DOUBLE, 0)::DOUBLE AS half_even,
       trunc(value)::BIGINT AS cut, greatest(1, ceil(value - 1e-9))::BIGINT AS declared, printf('%.4f', value) AS rate
FROM events
""")
def rounding_rules(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id", R.to_fps(v, F.lit(3.0)).alias("fps_time"), R.half_up(v).cast("long").alias("half_up"), R.half_even(v).alias("half_even"),
        R.truncated(v).alias("cut"), R.declared_end(v).cast("long").alias("declared"), R.rate_key(v).alias("rate"),
    )


@query("""
SELECT CASE WHEN value <= 10 THEN '0-10s' WHEN value <= 50 THEN '10-50s' WHEN value <= 100 THEN '50-100s' ELSE '>100s' END AS bucket, count(*)::BIGINT AS n FROM events GROUP BY ALL
""")
def duration_buckets(t: Tables) -> DataFrame:
    return t.events.groupBy(R.duration_bucket(F.col("value"), [10, 50, 100]).alias("bucket")).agg(F.count("*").alias("n"))


@query(r"""
WITH b AS (SELECT item_id, text AS g, (item_id * 7) % (SELECT count(*) FROM documents) AS doc_id FROM benchmark), w AS (
  SELECT item_id, regexp_extract_all(lower(regexp_replace(g, '[^\x00-\x7F]', '', 'g')), '\w+') AS gw, regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '\w+') AS aw FROM b JOIN documents USING (doc_id)
), c AS (
  SELECT item_id, len(list_distinct(gw)) AS want, len(list_intersect(list_distinct(gw), aw)) AS have, len(gw) AS ng, len(aw) AS na, gw, aw FROM w
), s AS (
  SELECT item_id, sum(least(x, y)) AS shared FROM (
    SELECT item_id, u, len(list_filter(gw, lambda v: v = u)) AS x, len(list_filter(aw, lambda v: v = u)) AS y FROM (SELECT item_id, gw, aw, unnest(list_distinct(gw)) AS u FROM c)) GROUP BY item_id
)
SELECT item_id, round(CASE WHEN want < 3 THEN 0.0 ELSE have / want END, 6) AS coverage, round(2.0 * shared / (ng + na), 6) AS f1 FROM c JOIN s USING (item_id)
""")
def score_words_against_gold(t: Tables) -> DataFrame:
    n = t.documents.count()
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    gold = t.benchmark.select("item_id", ascii_(F.col("text")).alias("gold"), (F.col("item_id") * 7 % n).alias("doc_id"))
    rows = gold.join(t.documents.select("doc_id", ascii_(F.col("text")).alias("answer")), "doc_id")
    return rows.select("item_id", F.round(S.keyword_coverage(F.col("answer"), F.col("gold")), 6).alias("coverage"), F.round(S.token_f1(F.col("answer"), F.col("gold")), 6).alias("f1"))


@query("""
SELECT p_type, count(*)::BIGINT AS n, avg(CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 0.0 ELSE (p_size % 2 = 0)::INTEGER END)::DOUBLE AS score FROM part GROUP BY p_type
""")
def score_by_source(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("mcq"), F.lit("em"), F.lit("yes_no")), F.col("p_size") % 3 + 1)
    answer = F.when(kind == "mcq", "I say B.").when(kind == "em", "the ring").otherwise(F.when(F.col("p_size") % 2 == 0, "Yes, it is").otherwise("No"))
    gold = F.when(kind == "mcq", "B").when(kind == "em", "rings").otherwise("yes")
    score = S.by_source(kind, answer, gold, {"mcq": "mcq", "em": "em", "yes_no": "yes_no"})
    return t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.avg(score).alias("score"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_open, len(regexp_extract_all(html, '</p>'))::BIGINT AS n_close, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages
""")
def tag_structure_counts(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_open"), F.regexp_count("html", F.lit("</p>")).cast("long").alias("n_close"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
    )


@query("""
SELECT event_id, CASE WHEN value < v2 THEN value END AS a, CASE WHEN value < v2 THEN v2 END AS b FROM (SELECT event_id, value, round(100 - value, 2) AS v2 FROM events WHERE value <= 100)
""")
def interval_text_parsed(t: Tables) -> DataFrame:
    text = F.concat(
        F.col("value").cast("decimal(10,2)").cast("string"), F.when(F.col("event_id") % 2 == 0, " - ").otherwise("–"),
        F.round(100 - F.col("value"), 2).cast("decimal(10,2)").cast("string"),
    )
    return t.events.where("value <= 100").select("event_id", T.interval(text)["start"].alias("a"), T.interval(text)["end"].alias("b"))


@query("""
SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type
""")
def json_field_sums(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("""
SELECT user_id, max(epoch(ts)) AS last_second, count(*)::BIGINT AS n FROM events GROUP BY user_id
""")
def last_event_second(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max(seconds("ts")).alias("last_second"), F.count("*").alias("n"))
