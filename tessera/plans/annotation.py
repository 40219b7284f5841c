"""Queries on annotated videos: orders stand for videos, their lines for query and answer events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.functions import text as T
from tessera.operators import annotations as A
from tessera.operators.relational import tasks_for
from tessera.registry import Tables, query, seconds

#: DuckDB: one row for each answer, with its video.
ANSWERS = """
WITH a AS (
  SELECT o_orderkey AS video_id, floor(o_totalprice / 4000.0) AS video_seconds, l_returnflag AS qid,
         floor(l_quantity * l_linenumber * 0.8 * 2.0 + 0.5) / 2.0 AS time, l_linestatus AS gt, l_linenumber AS line, l_partkey AS part
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
)
"""


def videos(t: Tables) -> DataFrame:
    """Videos with nested query events; a query's options are its answers' ground truths and its id."""
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", (F.col("l_quantity") * F.col("l_linenumber") * 0.8).alias("time"))
    answer = F.struct(F.col("time"), F.col("l_linestatus").alias("gt"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    lines = lines.repartition("l_orderkey")  # one exchange serves both groupings and the join
    queries = lines.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(answer).alias("answer_events"), F.min("time").alias("time"))
    event = F.struct(
        F.col("l_returnflag").alias("qid"), F.greatest(F.lit(0.0), F.col("time") - 10.0).alias("time"),
        F.array(F.col("l_returnflag"), F.lit("B. none")).alias("options"), F.array_sort("answer_events").alias("answer_events"),
    )
    events = queries.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(event)).alias("query_events"))
    rows = t.orders.join(events, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("video_id"), F.floor(F.col("o_totalprice") / 4000.0).cast("double").alias("video_seconds"), F.lit(2.0).alias("fps"), "query_events")


@query("""
WITH l AS (
  SELECT o_orderkey AS v, floor(o_totalprice / 4000.0) AS secs, l_returnflag AS qid, l_quantity * l_linenumber * 0.8 AS raw
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
), a AS (
  SELECT v, secs, qid, floor(raw * 2.0 + 0.5) / 2.0 AS t, floor(greatest(0.0, min(raw) OVER (PARTITION BY v, qid) - 10.0) * 2.0 + 0.5) / 2.0 AS q FROM l
), g AS (
  SELECT *, CASE WHEN secs <= 110 OR t <= 110 THEN t - lag(t) OVER (PARTITION BY v, qid ORDER BY t) END AS gap FROM a
), s AS (
  SELECT v, any_value(secs) AS secs, count(qid) AS n, min(q) AS asked, min(t) AS first,
         count(CASE WHEN secs <= 110 OR t <= 110 THEN 1 END) AS kept, min(gap) AS gap,
         max(CASE WHEN secs <= 110 OR t <= 110 THEN t END) AS last
  FROM g GROUP BY v
), r AS (
  SELECT CASE WHEN n = 0 THEN 'missing_query_events' WHEN secs < 20 THEN 'original_video_too_short'
              WHEN secs > 110 AND asked > 110 THEN 'query_after_max_cutoff' WHEN secs > 110 AND first > 110 THEN 'first_answer_after_max_cutoff'
              WHEN kept = 0 THEN 'no_answers_before_cutoff' WHEN gap < 7 - 1e-6 THEN 'answer_gap_too_small'
              WHEN greatest(1, ceil(last - 1e-9)) < 20 THEN 'final_video_too_short' WHEN greatest(1, ceil(last - 1e-9)) > 110 THEN 'final_video_too_long'
              WHEN greatest(1, ceil(last - 1e-9)) - last < 0 OR greatest(1, ceil(last - 1e-9)) - last > 1 + 1e-6 THEN 'final_frame_not_aligned' ELSE 'kept' END AS reason
  FROM s
)
SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason
""")
def filter_first_failing_reason(t: Tables) -> DataFrame:
    return A.first_failing_reason(videos(t)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT doc_id, n_chars, text, lang FROM documents), r AS (
  SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END,
                 CASE WHEN lang <> 'en' THEN 'language' END], lambda v: v IS NOT NULL)) AS reason FROM x)
SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason
""")
def filter_all_failing_reasons(t: Tables) -> DataFrame:
    checks = {"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 5000, "table": F.col("text").contains("|"), "language": F.col("lang") != "en"}
    return A.violations(t.documents, checks).select(F.col("check").alias("reason"), "n")


@query(ANSWERS + """
SELECT video_id, qid, count(*)::BIGINT AS n_answers, min(time) AS first_time, max(time) AS last_time,
       string_agg(gt, ',' ORDER BY time, gt, line) AS truths FROM a GROUP BY video_id, qid
""")
def nest_and_flatten_events(t: Tables) -> DataFrame:
    rows = videos(t).where("query_events is not null").withColumn("query_events", A.on_grid(F.col("query_events"), F.col("fps")))
    flat = A.flattened(rows, "query_events", [])
    return flat.select(
        "video_id", "qid", F.size("answer_events").cast("long").alias("n_answers"), F.get("answer_events", F.lit(0))["time"].alias("first_time"),
        F.element_at("answer_events", -1)["time"].alias("last_time"), F.array_join(F.transform("answer_events", lambda a: a["gt"]), ",").alias("truths"),
    )


@query(ANSWERS + """
, d AS (SELECT *, row_number() OVER (PARTITION BY video_id, round(time, 3), gt ORDER BY line, part) AS r FROM a)
SELECT video_id, time, gt, part FROM d WHERE r = 1
""")
def dedupe_events_keep_first(t: Tables) -> DataFrame:
    dealt = t.lineitem.repartition(tasks_for(t.lineitem), "l_orderkey")  # one exchange serves the join and the keys
    lines = dealt.join(t.orders.select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.select(
        F.col("l_orderkey").alias("video_id"), R.to_fps(F.col("l_quantity") * F.col("l_linenumber") * 0.8, F.lit(2.0)).alias("time"),
        F.col("l_linestatus").alias("gt"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )
    return A.first_of(rows, ["video_id", F.round("time", 3), "gt"], ["line", "part"]).select("video_id", "time", "gt", "part")


@query("""
WITH p AS (
  SELECT l_orderkey AS video_id, min(l_quantity) AS asked, max(l_quantity) AS answered, max(l_quantity) - min(l_quantity) AS gap FROM lineitem GROUP BY l_orderkey
), k AS (SELECT * FROM p WHERE gap BETWEEN 15 AND 30)
SELECT video_id, 'No' AS answer, asked AS time FROM k UNION ALL SELECT video_id, 'Yes', answered FROM k
""")
def yes_no_pair_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("video_id")).agg(F.min("l_quantity").alias("asked"), F.max("l_quantity").alias("answered"))
    return A.yes_no_pairs(rows.withColumn("gap", F.col("answered") - F.col("asked"))).select("video_id", "answer", "time")


@query("""
WITH e AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS step, event_type FROM events)
SELECT user_id, step, count(*)::BIGINT AS n FROM e WHERE event_type = 'click' GROUP BY ALL HAVING count(*) > 1
""")
def same_step_conflicts(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'click'").select("user_id", F.floor(seconds("ts") / 3600).alias("step"))
    return rows.groupBy("user_id", "step").agg(F.count("*").alias("n")).where("n > 1")


@query("""
SELECT p_partkey, CASE WHEN d >= i THEN d + 1 ELSE d END AS other FROM (
  SELECT p_partkey, p_size % 5 AS i, ('0x' || substr(sha1(concat_ws(chr(9), p_brand, p_name)), 1, 8))::BIGINT % 4 AS d FROM part)
""")
def counterfactual_option(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", A.unable_option(F.col("p_size") % 5, F.lit(5), F.col("p_brand"), F.col("p_name")).alias("other"))


@query("""
SELECT 'negative_gap' AS "check", count(*)::BIGINT AS n FROM lineitem WHERE l_discount > l_tax UNION ALL
SELECT 'large', count(*)::BIGINT FROM lineitem WHERE l_quantity > 45
""")
def validation_violations(t: Tables) -> DataFrame:
    return A.violations(t.lineitem, {"negative_gap": F.col("l_discount") > F.col("l_tax"), "large": F.col("l_quantity") > 45, "missing": F.col("l_partkey").isNull()})


@query("""
SELECT o_orderkey, CASE WHEN n >= 5 THEN 'multi' WHEN n >= 2 THEN 'one' ELSE 'unable' END AS bucket
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
""")
def route_three_ways(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("o_orderkey", F.when(n >= 5, "multi").when(n >= 2, "one").otherwise("unable").alias("bucket"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN chr((65 + p_size % 4)::INTEGER) END AS letter,
       p_name || chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. none' AS question
FROM part
""")
def option_letters_and_prompt(t: Tables) -> DataFrame:
    options = F.array("p_brand", "p_type", F.lit("none"))
    gt = (F.col("p_size") % 4).cast("string")
    return t.part.select("p_partkey", T.ground_truth_letter(gt, options).alias("letter"), T.question_with_options(F.col("p_name"), options).alias("question"))
