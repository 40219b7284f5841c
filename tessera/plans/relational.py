"""Join, set-operation and layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import relational as J
from tessera.registry import Tables, query


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3)
""")
def resume_pending(t: Tables) -> DataFrame:
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return J.pending(t.orders.select("o_orderkey"), done, ["o_orderkey"], 3)


@query("""
SELECT s_suppkey, r::INTEGER AS repeat FROM supplier, (SELECT unnest(range(0, 3)) AS r) WHERE NOT (s_suppkey % 3 = 0 AND r = 1)
""")
def jobs_without_completed(t: Tables) -> DataFrame:
    done = t.supplier.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(1).alias("repeat"))
    return J.jobs(t.supplier.select("s_suppkey"), 3, done, ["s_suppkey"])


@query("""
WITH u AS (SELECT c_custkey AS id, 'customer' AS src, 0 AS p FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 'supplier', 1 FROM supplier)
SELECT id, min_by(src, p) AS src FROM u GROUP BY id
""")
def union_first_source_wins(t: Tables) -> DataFrame:
    a = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src"))
    return J.first_source_wins([a, t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src"))], ["id"])


@query("""
SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL
""")
def last_write_per_key(t: Tables) -> DataFrame:
    return J.last_write_wins(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""
WITH p AS (SELECT user_id, max((event_type = 'click' AND value > 100)::INTEGER) AS a, max((event_type = 'view' AND value > 100)::INTEGER) AS b FROM events GROUP BY user_id)
SELECT user_id, a AS click, b AS view, least(a, b) AS "both" FROM p
""")
def branch_pairs_missing_is_miss(t: Tables) -> DataFrame:
    rows = t.events.where("event_type in ('click', 'view')").withColumn("hit", (F.col("value") > 100).cast("int"))
    found = J.branch_pairs(rows, ["user_id"], "event_type", ("click", "view"), "hit")
    return t.events.select("user_id").distinct().join(found, "user_id", "left").select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "both")))


@query("""
WITH a AS (SELECT doc_id, quality AS s FROM labels), b AS (SELECT doc_id, (n_chars > 1000)::INTEGER AS s FROM documents)
SELECT count(*)::BIGINT AS n, count_if(a.s > b.s)::BIGINT AS wins, count_if(a.s < b.s)::BIGINT AS losses, count_if(a.s = b.s AND a.s > 0)::BIGINT AS both_right, count_if(a.s = b.s AND a.s <= 0)::BIGINT AS both_wrong FROM a JOIN b USING (doc_id)
""")
def compare_two_models(t: Tables) -> DataFrame:
    a = t.labels.select("doc_id", F.col("quality").alias("s"))
    return J.compared(a, t.documents.select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("s")), ["doc_id"], "s")


@query("""
SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'fail' END, 'missing') AS status FROM documents LEFT JOIN labels USING (doc_id)
""")
def expected_rows_with_errors(t: Tables) -> DataFrame:
    actual = t.labels.select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"))
    return J.completed_with_errors(t.documents.select("doc_id"), actual, ["doc_id"], "status", "missing")


@query("""
SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1)::BIGINT AS position FROM documents
""")
def global_row_number(t: Tables) -> DataFrame:
    return J.with_position(t.documents.select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", F.col("position").cast("long").alias("position"))


@query("""
WITH a AS (SELECT 'c' || c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS r, 0 AS p FROM customer), b AS (SELECT 's' || s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS r, 1 AS p FROM supplier)
SELECT id, (row_number() OVER (ORDER BY r, p) - 1)::BIGINT AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE r <= (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)))
""")
def interleave_until_first_ends(t: Tables) -> DataFrame:
    a = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"))
    b = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("k"))
    rows = J.interleaved([a, b], [["k"], ["k"]], "first")
    return rows.select("id", (F.col("place.position") * 2 + F.col("place._part")).cast("long").alias("place"))


@query("""
SELECT p_partkey, unnest(range(0, p_size % 3))::INTEGER AS copy FROM part
""")
def repeat_rows_by_count(t: Tables) -> DataFrame:
    return J.repeated(t.part.select("p_partkey", "p_size"), F.col("p_size") % 3).select("p_partkey", "copy")


@query("""
SELECT (c_custkey // 10)::BIGINT AS fold, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS names FROM customer GROUP BY ALL
""")
def fold_rows(t: Tables) -> DataFrame:
    return J.folded(t.customer, "c_custkey", 10, F.col("c_mktsegment")).select("fold", F.array_join("values", ",").alias("names"))


@query("""
SELECT vec_id, c::INTEGER AS chunk, round(list_sum(list_transform(embedding[c * 16 + 1:c * 16 + 16], lambda x: x::DOUBLE)), 5) AS total FROM embeddings, (SELECT unnest(range(0, 4)) AS c)
""")
def column_chunks_as_rows(t: Tables) -> DataFrame:
    rows = J.column_chunks(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", 4)
    return rows.select("vec_id", "chunk", F.round(F.aggregate("piece", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""
SELECT a.doc_id, a.quality, b.source FROM labels AS a JOIN documents AS b USING (doc_id)
""")
def zip_aligned_columns(t: Tables) -> DataFrame:
    d = t.documents
    return J.zipped(t.labels.select("doc_id", "quality"), d.select("doc_id", "source"), ["doc_id"])


@query("""
SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size > 40 AND l_quantity > 30
""")
def lookup_dimensions(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_quantity > 30").join(t.part.where("p_size > 40"), F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name")
