"""Sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sampling as S
from tessera.registry import Tables, query

RANKED = "WITH r AS (SELECT doc_id, lang, n_chars, quality, row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) AS k FROM documents LEFT JOIN labels USING (doc_id))"


@query("""
SELECT doc_id, CASE WHEN k <= 50 THEN 'train' WHEN k <= 70 THEN 'val' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) AS k FROM documents)
""")
def split_by_counts(t: Tables) -> DataFrame:
    return S.split_counts(t.documents.select("doc_id", "lang"), ["lang"], "s", ["doc_id"], 50, 20).select("doc_id", "split")


@query("""
WITH d AS (SELECT doc_id, lang, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS size FROM documents), g AS (
  SELECT 'en' AS lang, 'short' AS size, 0.5 * 0.75 AS share UNION ALL SELECT 'en', 'long', 0.5 * 0.25 UNION ALL SELECT 'fr', 'short', 0.5 * 0.75 UNION ALL SELECT 'fr', 'long', 0.5 * 0.25
), r AS (SELECT d.*, row_number() OVER (PARTITION BY lang, size ORDER BY md5('s:' || doc_id), doc_id) AS k, coalesce(share, 0) AS share FROM d LEFT JOIN g USING (lang, size))
SELECT doc_id FROM r ORDER BY k > round_even(90.0::DOUBLE * share, 0), md5('s:' || doc_id), doc_id LIMIT 90
""")
def select_to_joint_ratios(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("size"))
    return S.joint_ratios(d, "lang", "size", {"en": 1, "fr": 1}, {"short": 3, "long": 1}, 90, "s", ["doc_id"]).select("doc_id")


@query(RANKED + """
, c AS (SELECT min(n // CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END) AS unit FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY lang))
SELECT doc_id, lang FROM r, c WHERE (lang = 'en' AND k <= 3 * unit) OR (lang = 'de' AND k <= 2 * unit) OR (lang = 'fr' AND k <= unit)
""")
def sample_ratio_units(t: Tables) -> DataFrame:
    return S.ratio_units(t.documents.select("doc_id", "lang"), "lang", {"en": 3, "de": 2, "fr": 1}, "s", ["doc_id"])


@query("""
WITH r AS (SELECT doc_id, toxic, quality, row_number() OVER (PARTITION BY toxic, quality = 1 ORDER BY md5('s:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY toxic, quality = 1) AS n FROM labels)
SELECT doc_id FROM r WHERE quality <> 1 OR k <= floor(n * 0.3)
""")
def keep_fails_and_share_of_passes(t: Tables) -> DataFrame:
    return S.fails_and_share_of_passes(t.labels, F.col("quality") == 1, ["toxic"], 0.3, "s", ["doc_id"]).select("doc_id")


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_size <= 15 THEN 0.0 WHEN p_size >= 30 THEN 1.0 ELSE 0.5 END AS rate FROM part), s AS (
  SELECT *, row_number() OVER (PARTITION BY rate ORDER BY md5('s:' || p_partkey), p_partkey) AS k, (SELECT floor(count(*) * 0.1 + 0.5) FROM r WHERE rate = 0.5) AS most FROM r)
SELECT p_partkey, rate::DOUBLE AS rate FROM s WHERE rate = 0.5 OR k <= most
""")
def sample_middle_and_sides(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") <= 15, 0.0).when(F.col("p_size") >= 30, 1.0).otherwise(0.5).alias("rate"))
    return S.middle_and_sides(rows, "rate", 0.1, "s", ["p_partkey"]).select("p_partkey", "rate")


@query("""
SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY ln((('0x' || md5('w:' || c_custkey)[1:12])::BIGINT + 0.5) / 281474976710656.0) / c_acctbal DESC, c_custkey LIMIT 100
""")
def weighted_sample(t: Tables) -> DataFrame:
    return S.weighted_best(t.customer, "c_acctbal", 100, "w", ["c_custkey"]).select("c_custkey")


@query("""
WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('u:' || s_suppkey), s_suppkey) AS k, (SELECT count(*) FROM supplier) AS n FROM supplier)
SELECT s_suppkey, unnest(range(0, 250 // n + (k <= 250 % n)::INTEGER))::INTEGER AS copy FROM r
""")
def upsample_to_count(t: Tables) -> DataFrame:
    return S.resampled(t.supplier.select("s_suppkey"), 250, "u", ["s_suppkey"])


@query("""
WITH RECURSIVE g AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY sha256('v:' || c_nationkey)) AS i FROM customer GROUP BY c_nationkey),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS total, []::INTEGER[] AS kept UNION ALL SELECT g.i, CASE WHEN total + n <= 200 THEN total + n ELSE total END, CASE WHEN total + n <= 200 THEN list_append(kept, c_nationkey) ELSE kept END FROM r JOIN g ON g.i = r.i + 1)
SELECT c_custkey, list_contains((SELECT kept FROM r ORDER BY i DESC LIMIT 1), c_nationkey) AS chosen FROM customer
""")
def validation_groups(t: Tables) -> DataFrame:
    return S.whole_groups(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", 200, "v").select("c_custkey", "chosen")


@query("""
WITH c AS (SELECT s_suppkey, s_acctbal AS w, sum(s_acctbal) OVER (ORDER BY md5('i:' || s_suppkey), s_suppkey) AS hi, sum(s_acctbal) OVER () AS total FROM supplier WHERE s_acctbal > 0), u AS (
  SELECT *, ('0x' || md5('i:start')[1:12])::BIGINT / 281474976710656.0::DOUBLE AS u FROM c)
SELECT s_suppkey, unnest(range(0, (ceil(hi * 60 / total - u) - ceil((hi - w) * 60 / total - u))::BIGINT))::INTEGER AS copy FROM u
""")
def importance_resample(t: Tables) -> DataFrame:
    return S.importance_resampled(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 60, "i", ["s_suppkey"]).select("s_suppkey", "copy")


@query("""
WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 4 THEN NULL ELSE (p_size % 5) / 3.0 END AS rate FROM part), k AS (
  SELECT *, coalesce(rate > 0 AND rate < 1, false) AS pool FROM r), o AS (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5('c:' || p_partkey), p_partkey) AS n, count(*) OVER (PARTITION BY pool) AS m FROM k)
SELECT p_partkey, unnest(CASE WHEN rate IS NULL THEN ['unscored'] WHEN rate >= 1 THEN ['drop'] WHEN pool THEN [CASE WHEN n <= round_even(m * 0.4::DOUBLE, 0) THEN 'sft' ELSE 'rl' END] WHEN p_size % 2 = 0 THEN ['sft', 'rl'] ELSE ['unsolved'] END) AS target FROM o
""")
def allocate_curriculum(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_size", F.when(F.col("p_size") % 5 != 4, (F.col("p_size") % 5) / 3.0).alias("rate"), (F.col("p_size") % 2 == 0).alias("rescued"))
    return S.curriculum(rows, "rate", "rescued", 0.4, "c", ["p_partkey"]).select("p_partkey", "target")
