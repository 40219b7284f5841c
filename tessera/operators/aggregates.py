"""Aggregations of evaluation and curation: counters, distributions, repeated runs, macro averages, votes, name rules."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shipping import ship


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(counter, key, n) of each column's values in one aggregation; null: empty."""
    rows = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")) for c in columns))))
    return rows.groupBy("counter", "key").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """(bin, n) of half-open bins, empty ones too; values outside aren't counted."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], "bin int, lo double, hi double")
    place = reduce(lambda acc, i: acc.when((value >= bounds[i]) & (value < bounds[i + 1]), i), range(1, len(bounds) - 1), F.when((value >= bounds[0]) & (value < bounds[1]), 0))
    found = df.select(place.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(found, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def order_statistics(df: DataFrame, key: list[str], value: str, shares: list[float]) -> DataFrame:
    """The values at rank int(share * (n - 1)) of each key, exactly, from counts of distinct values instead of gathered rows."""
    w = Window.partitionBy(*key)
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    rows = counts.select(*key, value, F.sum("_c").over(w).alias("_n"), F.sum("_c").over(w.orderBy(value)).alias("_to"), "_c")
    place = lambda s: F.floor(F.lit(s) * (F.col("_n") - 1))
    at = [F.max(F.when((F.col("_to") > place(s)) & (F.col("_to") - F.col("_c") <= place(s)), F.col(value))).alias(f"p{int(100 * s)}") for s in shares]
    return rows.groupBy(*key).agg(F.max("_n").alias("n"), *at)


def runs(df: DataFrame, key: list[str], score: str, error: str, rates: list[str]) -> DataFrame:
    """Passes, scored runs, pass rate (null if none is scored), errors and mean rates of repeated runs."""
    return df.groupBy(*key).agg(
        F.sum(F.coalesce((F.col(score) == 1).cast("long"), F.lit(0))).alias("pass_count"),
        F.count(score).alias("scored"),
        F.avg(score).alias("pass_rate"),
        F.sum((F.coalesce(error, F.lit("")) != "").cast("long")).alias("errors"),
        *(F.avg(r).alias(f"mean_{r}") for r in rates),
    )


def consistency(df: DataFrame, key: list[str], answer: Column) -> DataFrame:
    """Share of the commonest non-empty answer among all runs."""
    counts = df.select(*key, answer.alias("_a")).groupBy(*key, "_a").agg(F.count("*").alias("_n"))
    return counts.groupBy(*key).agg((F.coalesce(F.max(F.when(F.coalesce("_a", F.lit("")) != "", F.col("_n"))), F.lit(0)) / F.sum("_n")).alias("consistency"))


def macro_average(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean of means, from the finest level to the total; (level, name, value), all rows of a level weigh the same."""
    out, now = None, df.groupBy(*levels).agg(F.avg(value).alias("value"))
    for i in range(len(levels), -1, -1):
        if i < len(levels):
            now = now.groupBy(*levels[:i]).agg(F.avg("value").alias("value"))
        part = now.select(F.lit(levels[i - 1] if i else "total").alias("level"), F.concat_ws("/", *levels[:i]).alias("name"), "value")
        out = part if out is None else out.unionAll(part)
    return out


def majority(df: DataFrame, key: list[str], answer: str, value: str, order: str) -> DataFrame:
    """Value of the first run with the commonest answer; of equally common answers, the one seen first."""
    votes = df.groupBy(*key, answer).agg(F.count("*").alias("_n"), F.min_by(value, order).alias("value"), F.min(order).alias("_first"))
    return votes.groupBy(*key).agg(F.max_by("value", F.struct("_n", -F.col("_first"))).alias("value"))


def reduced_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """One number for each metric: its greatest value if the name holds max, its least for min, else the mean."""
    rule = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(rule.alias("value"))


def aggregated_by_name(df: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """As metric names say: time_sum and sum add up, avg, max and min, last; others: mean. The first rule that fits counts."""
    low = F.lower(name)
    rule = F.when(low.contains("timing_s/") | low.contains("time_sum"), F.sum(value))
    for part, f in (("avg", F.avg(value)), ("mean", F.avg(value)), ("max", F.max(value)), ("min", F.min(value)), ("sum", F.sum(value)), ("total", F.sum(value)), ("last", F.max_by(value, order))):
        rule = rule.when(low.contains(part), f)
    return df.groupBy(name).agg(rule.otherwise(F.avg(value)).alias("value"))


def masked(values: str, mask: str, how: str) -> Column:
    """sum, mean or var (Bessel) of an array's masked items."""
    pairs = F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["v"] * p["m"])
    n = F.aggregate(F.col(mask), F.lit(0.0), lambda a, m: a + m)
    if how == "sum":
        return total
    mean = total / (n + 1e-8)
    if how == "mean":
        return mean
    var = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["v"] - mean) * (p["v"] - mean) * p["m"]) / (n + 1e-8)
    return F.when(n > 1, var * n / (n - 1))


def length_distribution(df: DataFrame, length: Column, step: int) -> DataFrame:
    """(bucket, n, up_to, share) of lengths in steps, counts running up."""
    counts = df.groupBy((F.floor(length / step) * step).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bucket")  # over the few buckets, not over rows
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("bucket", "n", F.sum("n").over(w).alias("up_to"), (F.sum("n").over(w) / total).alias("share"))


def group_statistics(df: DataFrame, key: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """Adds mean, std and n of the key; one row alone: mean 0, std 1; variances of at least floor."""
    w = Window.partitionBy(*key)
    n = F.count(value).over(w)
    var = F.greatest(F.var_samp(value).over(w), F.lit(floor))
    return df.select("*", n.alias("group_n"), F.when(n > 1, F.avg(value).over(w)).otherwise(0.0).alias("group_mean"), F.when(n > 1, F.sqrt(var)).otherwise(1.0).alias("group_std"))


def bootstrap_bounds(n: int, size: int) -> tuple[list[float], list[float]]:
    """Weights of the sorted values whose sums are the expected least and greatest of `size` draws with replacement from n."""
    at_most = [(i / n) ** size for i in range(n + 1)]
    best = [at_most[i + 1] - at_most[i] for i in range(n)]
    return best[::-1], best


def best_and_worst_of(df: DataFrame, key: list[str], value: str, size: int) -> DataFrame:
    """Expected best and worst of `size` draws with replacement from each key's values: the bootstrap's limit, without sampling."""
    n, r = F.count("*").over(Window.partitionBy(*key)), F.row_number().over(Window.partitionBy(*key).orderBy(value))
    rows = df.select(*key, F.col(value).alias("_v"), n.alias("_n"), r.alias("_r"))
    best = F.pow(F.col("_r") / F.col("_n"), size) - F.pow((F.col("_r") - 1) / F.col("_n"), size)
    worst = F.pow((F.col("_n") - F.col("_r") + 1) / F.col("_n"), size) - F.pow((F.col("_n") - F.col("_r")) / F.col("_n"), size)
    return rows.groupBy(*key).agg(F.sum(best * F.col("_v")).alias("best"), F.sum(worst * F.col("_v")).alias("worst"))


def bootstrap_of(df: DataFrame, key: list[str], value: str, size: int) -> DataFrame:
    """(key, best, best_std, worst, worst_std, mean, mean_std): mean and standard deviation of the greatest, the least and the mean of `size` draws with replacement from each key's values.

    What resampling tends to, exactly: the i-th of n sorted values is the greatest of the draws with probability (i / n) ** size - ((i - 1) / n) ** size.
    """
    n, r = F.count(value).over(Window.partitionBy(*key)), F.row_number().over(Window.partitionBy(*key).orderBy(value))
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"), n.alias("_n"), r.alias("_r"))
    up = lambda k: F.pow(k / F.col("_n"), F.lit(size))
    rows = rows.withColumns({"_b": up(F.col("_r")) - up(F.col("_r") - 1), "_w": up(F.col("_n") - F.col("_r") + 1) - up(F.col("_n") - F.col("_r"))})
    sums = rows.groupBy(*key).agg(
        F.sum(F.col("_b") * F.col("_v")).alias("best"), F.sum(F.col("_b") * F.col("_v") * F.col("_v")).alias("_bb"), F.sum(F.col("_w") * F.col("_v")).alias("worst"),
        F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_ww"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("_s"),
    )
    std = lambda second, first: F.sqrt(F.greatest(F.col(second) - F.col(first) * F.col(first), F.lit(0.0)))
    return sums.select(*key, "best", std("_bb", "best").alias("best_std"), "worst", std("_ww", "worst").alias("worst_std"), "mean", (F.col("_s") / F.sqrt(F.lit(float(size)))).alias("mean_std"))


def poisson_bootstrap(df: DataFrame, key: list[str], row: Column, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(key, mean, std): of the weighted means of `replicates` resamples, in each of which a row counts Poisson(1) times.

    A row's counts follow from the hash of what tells it apart (`row`), the replicate and the seed, so that any partitioning gives the same. Each task
    sums its rows by key and replicate; rows with a null value take no part.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(value).isNotNull()).select(*key, F.xxhash64(row, F.lit(seed)).alias("_h"), F.col(value).cast("double").alias("_v"))
    chance = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])

    def weights(hashes: np.ndarray) -> np.ndarray:
        x = hashes[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(chance, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            places = t.select(key).append_column("_i", pa.array(np.arange(len(t)))).group_by(key).aggregate([("_i", "list")])
            hashes, values = t.column("_h").to_numpy().view(np.uint64), t.column("_v").to_numpy()
            n, x = [], []
            for i in places.column("_i_list").to_pylist():
                parts = [(w.sum(axis=0), values[i[lo : lo + 4096]] @ w) for lo in range(0, len(i), 4096) for w in [weights(hashes[i[lo : lo + 4096]])]]
                n.append(sum(p for p, _ in parts))
                x.append(sum(p for _, p in parts))
            yield from places.select(key).append_column("n", pa.array(n, pa.list_(pa.float64()))).append_column("x", pa.array(x, pa.list_(pa.float64()))).to_batches()

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    partial = rows.mapInArrow(run, f"{kinds}, n array<double>, x array<double>").select(*key, F.posexplode(F.arrays_zip("n", "x")).alias("r", "s"))
    means = partial.groupBy(*key, "r").agg((F.sum("s.x") / F.nullif(F.sum("s.n"), F.lit(0.0))).alias("m"))
    return means.groupBy(*key).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
