"""Queries of one source grouped into one row: same-time choices, least gaps, cover rows, benchmark layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import thinned


def priority(kind: Column, order: list[str]) -> Column:
    """Rank of a kind; unknown kinds come last."""
    out = None
    for i, k in enumerate(order):
        out = F.when(kind == k, i) if out is None else out.when(kind == k, i)
    return F.lit(99) if out is None else out.otherwise(99)


def one_per_time(df: DataFrame, key: list[str], time: str, order: list) -> DataFrame:
    """The first event of those at one time (microseconds), with partial choices before the shuffle."""
    row = F.struct(*df.columns)
    found = df.groupBy(*key, F.round(time, 6).alias("_t")).agg(F.min_by(row, F.struct(*order)).alias("_r"))
    return found.select("_r.*")


def grouped(df: DataFrame, key: list[str], time: str, order: list, fields: list[str], gap: float, least: int, cover: list[str]) -> DataFrame:
    """One row for each key: events at least gap apart, numbered qids, and the columns of the widest source row.

    Keys with fewer than `least` events left are dropped. One video's events are folded, not joined.
    """
    events = one_per_time(df, key, time, order)
    event = F.struct(F.col(time).alias("time"), *fields)
    rows = events.groupBy(*key).agg(F.array_sort(F.collect_list(event)).alias("_e"), F.max_by(F.struct(*cover), F.struct(*cover)).alias("cover"))
    kept = thinned(F.transform("_e", lambda e: e["time"].cast("double")), gap - 1e-9)
    rows = rows.withColumn("_k", kept).withColumn("events", F.filter("_e", lambda e: F.array_contains("_k", e["time"].cast("double"))))
    out = rows.where(F.size("events") >= least).select(*key, "cover.*", "events")
    return out.withColumn("events", F.transform("events", lambda e, i: F.struct(F.concat(F.lit("q"), i.cast("string")).alias("qid"), e["time"].alias("time"), *(e[f].alias(f) for f in fields))))


def one_per_bucket(df: DataFrame, key: list[str], time: str, seed: str, row_key: str) -> DataFrame:
    """A seeded choice among the events at one time (milliseconds)."""
    return one_per_time_by_hash(df, [*key, F.round(time, 3).alias("_t")], seed, row_key)


def one_per_time_by_hash(df: DataFrame, key: list, seed: str, row_key: str) -> DataFrame:
    row = F.struct(*df.columns)
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(row_key).cast("string")))
    return df.groupBy(*key).agg(F.min_by(row, F.struct(draw, F.col(row_key))).alias("_r")).select("_r.*")


def benchmark_samples(df: DataFrame, nested: str, is_nested: Column, fields: list[str]) -> DataFrame:
    """One sample for each test of rows that nest tests, one for each other row."""
    tests = df.where(is_nested).select(*[c for c in df.columns if c != nested], F.posexplode(nested).alias("test_index", "_t"))
    a = tests.select(*[c for c in df.columns if c != nested and c not in fields], "test_index", *(F.col(f"_t.{f}").alias(f) for f in fields))
    b = df.where(~is_nested).drop(nested).withColumn("test_index", F.lit(0))
    return a.unionByName(b, allowMissingColumns=True)


def two_branches(df: DataFrame, key: str, branches: list[tuple[str, str]]) -> DataFrame:
    """Rows (key, branch, and the branch's struct) of rows that hold several branches as columns."""
    items = F.array(*(F.struct(F.lit(name).alias("branch"), F.col(c).alias("item")) for name, c in branches))
    return df.select(key, F.inline(items)).where("item is not null").select(key, "branch", "item.*")


def first_accepted(df: DataFrame, video: str, order: list, accepted: Column) -> DataFrame:
    """The first accepted row of each video, numbered by input order (id)."""
    w = Window.partitionBy(video).orderBy(*order)
    return df.where(accepted).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
