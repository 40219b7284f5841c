"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scorers as S
from tessera.operators import aggregates as A
from tessera.registry import Tables, query, seconds


@query("""
SELECT conv_id, count(*)::BIGINT AS n_turns, sum((role = 'assistant')::INTEGER)::BIGINT AS n_answers, sum(length(text))::BIGINT AS n_chars, max(turn)::BIGINT AS last_turn
FROM conversations GROUP BY conv_id
""")
def agg_session_answer_stats(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n_answers"), F.sum(F.length("text")).cast("long").alias("n_chars"),
        F.max("turn").alias("last_turn"),
    )


@query("""
SELECT 'lang' AS counter, lang AS key, count(*)::BIGINT AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents GROUP BY source
""")
def counters_of_columns(t: Tables) -> DataFrame:
    return A.counters(t.documents, ["lang", "source"])


@query("""
SELECT bin::INTEGER AS bin, lo::DOUBLE AS lo, hi::DOUBLE AS hi, count(value)::BIGINT AS n FROM (VALUES (0, 0, 1), (1, 1, 10), (2, 10, 100), (3, 100, 1000), (4, 1000, 9999)) AS b(bin, lo, hi)
LEFT JOIN events ON value >= lo AND value < hi GROUP BY ALL
""")
def histogram_zero_filled(t: Tables) -> DataFrame:
    return A.histogram(t.events, F.col("value"), [0, 1, 10, 100, 1000, 9999])


@query("""
WITH r AS (SELECT lang, n_chars, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k FROM documents)
SELECT lang, max(n)::BIGINT AS n, max(CASE WHEN k = 0 THEN n_chars END) AS p0, max(CASE WHEN k = floor(0.25 * (n - 1)) THEN n_chars END) AS p25, max(CASE WHEN k = floor(0.5 * (n - 1)) THEN n_chars END) AS p50,
       max(CASE WHEN k = floor(0.75 * (n - 1)) THEN n_chars END) AS p75, max(CASE WHEN k = n - 1 THEN n_chars END) AS p100 FROM r GROUP BY lang
""")
def exact_order_statistics(t: Tables) -> DataFrame:
    return A.order_statistics(t.documents, ["lang"], "n_chars", [0, 0.25, 0.5, 0.75, 1])


RUNS = """WITH r AS (SELECT l_orderkey AS k, (l_linenumber * 1000000 + l_partkey) * 100 + round(l_discount * 100)::BIGINT AS run, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 0 END AS score, CASE WHEN l_tax > 0.07 THEN 'late' ELSE '' END AS error, l_discount AS rate, l_linestatus AS answer FROM lineitem)"""


def runs(t: Tables) -> DataFrame:
    f = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"),
        ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100 + F.round(F.col("l_discount") * 100).cast("long")).alias("run"),
        F.when(f == "A", 1).when(f == "N", 0).alias("score"), F.when(F.col("l_tax") > 0.07, "late").otherwise("").alias("error"),
        F.col("l_discount").alias("rate"), F.col("l_linestatus").alias("answer"),
    )


@query(RUNS + """
, a AS (SELECT k, coalesce(sum(score), 0)::BIGINT AS pass_count, count(score)::BIGINT AS scored, avg(score) AS pass_rate, sum((error <> '')::INTEGER)::BIGINT AS errors, avg(rate) AS m FROM r GROUP BY k)
SELECT k, pass_count, scored, round(pass_rate, 6) AS pass_rate, errors, round(m, 6) AS mean_rate, CASE WHEN pass_rate IS NULL THEN 'unscored' WHEN pass_rate >= 1 THEN 'easy' WHEN pass_rate >= 2 / 3.0 - 1e-9 THEN 'medium' WHEN pass_rate >= 1 / 3.0 - 1e-9 THEN 'hard' ELSE 'unsolved' END AS difficulty FROM a
""")
def repeated_runs_and_difficulty(t: Tables) -> DataFrame:
    a = A.runs(runs(t), ["k"], "score", "error", ["rate"])
    return a.select("k", "pass_count", "scored", F.round("pass_rate", 6).alias("pass_rate"), "errors", F.round("mean_rate", 6).alias("mean_rate"), S.difficulty(F.col("pass_rate")).alias("difficulty"))


@query(RUNS + """
, c AS (SELECT k, answer, count(*) AS n FROM r GROUP BY ALL)
SELECT k, round(max(n) / sum(n), 6) AS consistency FROM c GROUP BY k
""")
def answer_consistency(t: Tables) -> DataFrame:
    return A.consistency(runs(t), ["k"], F.col("answer")).select("k", F.round("consistency", 6).alias("consistency"))


MACRO = """WITH c AS (SELECT r_name, n_name, c_mktsegment, (c_acctbal > 0)::INTEGER AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(MACRO + """
, a AS (SELECT r_name, n_name, avg(hit) AS v FROM c GROUP BY ALL), b AS (SELECT r_name, avg(v) AS v FROM a GROUP BY ALL)
SELECT 'n_name' AS level, r_name || '/' || n_name AS name, round(v, 6) AS value FROM a UNION ALL SELECT 'r_name', r_name, round(v, 6) FROM b UNION ALL SELECT 'total', '', round(avg(v), 6) FROM b
""")
def macro_average_three_levels(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select("r_name", "n_name", (F.col("c_acctbal") > 0).cast("int").alias("hit"))
    return A.macro_average(rows, ["r_name", "n_name"], "hit").select("level", "name", F.round("value", 6).alias("value"))


@query(MACRO + """
SELECT coalesce(c_mktsegment, 'Average') AS category, count(*)::BIGINT AS n, round(avg(hit), 6) AS accuracy FROM c GROUP BY GROUPING SETS ((c_mktsegment), ())
""")
def category_accuracy_with_average(t: Tables) -> DataFrame:
    rows = t.customer.select("c_mktsegment", (F.col("c_acctbal") > 0).cast("int").alias("hit"))
    return rows.rollup("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy")).select(F.coalesce("c_mktsegment", F.lit("Average")).alias("category"), "n", "accuracy")


@query(RUNS + """
, v AS (SELECT k, answer, count(*) AS n, min_by(rate, run) AS value, min(run) AS f FROM r GROUP BY ALL)
SELECT k, max_by(value, n::HUGEINT * 1000000000000 - f) AS value FROM v GROUP BY k HAVING count(*) > 0
""")
def majority_vote_value(t: Tables) -> DataFrame:
    return A.majority(runs(t), ["k"], "answer", "rate", "run")


@query("""
WITH m AS (SELECT CASE event_type WHEN 'view' THEN 'score/max' WHEN 'click' THEN 'score/min' WHEN 'purchase' THEN 'timing_s/step' WHEN 'signup' THEN 'tokens_total' ELSE 'loss/mean' END AS name, value, event_id FROM events)
SELECT name, round(CASE name WHEN 'score/max' THEN max(value) WHEN 'score/min' THEN min(value) WHEN 'loss/mean' THEN avg(value) ELSE sum(value) END, 4) AS value FROM m GROUP BY name
""")
def metrics_by_name_rule(t: Tables) -> DataFrame:
    name = F.expr("CASE event_type WHEN 'view' THEN 'score/max' WHEN 'click' THEN 'score/min' WHEN 'purchase' THEN 'timing_s/step' WHEN 'signup' THEN 'tokens_total' ELSE 'loss/mean' END")
    rows = t.events.select(name.alias("name"), "value", "event_id")
    return A.aggregated_by_name(rows, "name", "value", "event_id").select("name", F.round("value", 4).alias("value"))


@query("""
WITH e AS (SELECT vec_id, embedding AS v, list_transform(embedding, lambda x, i: CASE WHEN i % 3 = 0 THEN 0 ELSE 1 END) AS m FROM embeddings), p AS (
  SELECT vec_id, unnest(v)::DOUBLE AS v, unnest(m) AS m FROM e)
SELECT vec_id, round(sum(v * m), 5) AS total, round(sum(v * m) / (sum(m) + 1e-8), 5) AS mean,
       round((sum(v * v * m) / (sum(m) + 1e-8) - (sum(v * m) / (sum(m) + 1e-8)) ** 2) * sum(m) / (sum(m) - 1), 5) AS var FROM p GROUP BY vec_id
""")
def masked_array_statistics(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.transform("embedding", lambda x, i: F.when((i + 1) % 3 == 0, 0).otherwise(1)).alias("m"))
    return rows.select("vec_id", F.round(A.masked("v", "m", "sum"), 5).alias("total"), F.round(A.masked("v", "m", "mean"), 5).alias("mean"), F.round(A.masked("v", "m", "var"), 5).alias("var"))


@query("""
WITH b AS (SELECT n_chars // 1000 * 1000 AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY ALL)
SELECT bucket, n, sum(n) OVER (ORDER BY bucket)::BIGINT AS up_to, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS share FROM b
""")
def length_cumulative_distribution(t: Tables) -> DataFrame:
    return A.length_distribution(t.documents, F.col("n_chars"), 1000).select("bucket", "n", "up_to", F.round("share", 6).alias("share"))


@query("""
WITH r AS (SELECT user_id, value, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, round(sum(value * (pow(k / n, 4) - pow((k - 1) / n, 4))), 4) AS best, round(sum(value * (pow((n - k + 1) / n, 4) - pow((n - k) / n, 4))), 4) AS worst FROM r GROUP BY user_id
""")
def expected_best_of_four(t: Tables) -> DataFrame:
    return A.best_and_worst_of(t.events, ["user_id"], "value", 4).select("user_id", F.round("best", 4).alias("best"), F.round("worst", 4).alias("worst"))


@query("""
SELECT count_if(q = 1 AND p = 1)::BIGINT AS tp, count_if(q = 1 AND p = 0)::BIGINT AS fn, count_if(q = 0 AND p = 1)::BIGINT AS fp, count_if(q = 0 AND p = 0)::BIGINT AS tn, count_if(q IS NULL)::BIGINT AS unlabelled
FROM (SELECT quality AS q, (n_chars > 1500)::INTEGER AS p FROM documents LEFT JOIN labels USING (doc_id))
""")
def answer_silence_confusion(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.col("quality").alias("q"), (F.col("n_chars") > 1500).alias("p"))
    q, p = F.col("q"), F.col("p")
    return rows.agg(
        F.count_if((q == 1) & p).alias("tp"), F.count_if((q == 1) & ~p).alias("fn"), F.count_if((q == 0) & p).alias("fp"),
        F.count_if((q == 0) & ~p).alias("tn"), F.count_if(q.isNull()).alias("unlabelled"),
    )


@query("""
SELECT user_id, count(*)::BIGINT AS n, min(floor(epoch(ts)))::BIGINT AS first, count(DISTINCT event_type)::BIGINT AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id
""")
def trace_metrics(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min(F.floor(seconds("ts"))).alias("first"), F.count_distinct("event_type").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"),
    )


@query("""
WITH d AS (SELECT sha1(text) AS digest, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY ALL)
SELECT doc_id, n FROM d
""")
def dedupe_rows_by_digest(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha1("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")
