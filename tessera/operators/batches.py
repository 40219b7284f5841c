"""Batches: chunks, order and its inverse, selection, padding, dealing to workers and back, micro-batches under a token budget, resumable reading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.packing import karmarkar_karp, workload
from tessera.operators.relational import with_position


def reordered(df: DataFrame, place: str, order: DataFrame, index: str) -> DataFrame:
    """Rows in a new order: order (index, at) names the old place of each new one; place becomes the new one."""
    return df.join(order.select(F.col(index).alias(place), F.col("at").alias("_at")), place).drop(place).withColumnRenamed("_at", place)


def inverse(order: DataFrame, index: str, at: str) -> DataFrame:
    """The permutation that undoes one: where each old place went."""
    return order.select(F.col(at).alias(index), F.col(index).alias(at))


def chunked(df: DataFrame, place: str, n_rows: int, chunks: int) -> DataFrame:
    """Adds chunk: runs of places whose sizes differ by one at most, the longer ones first."""
    size, more = divmod(n_rows, chunks)
    p = F.col(place)
    cut = more * (size + 1)
    return df.withColumn("chunk", F.when(p < cut, F.floor(p / F.lit(size + 1))).otherwise(more + F.floor((p - cut) / F.lit(max(size, 1)))).cast("int"))


def selected(df: DataFrame, place: str, places: list[int]) -> DataFrame:
    """Rows at places, once for each time a place is named, in that order (at); negative places count from the end."""
    n = df.count() if any(p < 0 for p in places) else 0
    wanted = df.sparkSession.createDataFrame([(p if p >= 0 else n + p, i) for i, p in enumerate(places)], f"{place} long, at int")
    return df.join(F.broadcast(wanted), place)  # an argument


def padded(df: DataFrame, place: str, n_rows: int, divisor: int) -> DataFrame:
    """Rows up to a multiple of divisor, the first ones once more as padding (column padding)."""
    more = -n_rows % divisor
    real = df.withColumn("padding", F.lit(False))
    if not n_rows or not more:
        return real
    extra = df.withColumn("_k", F.explode(F.sequence(F.col(place), F.lit(more - 1), F.lit(n_rows)))) if more > n_rows else df.where(F.col(place) < more).withColumn("_k", F.col(place))
    extra = extra.where(F.col(place) < more).withColumn(place, F.col("_k") + n_rows).drop("_k").withColumn("padding", F.lit(True))
    return real.unionByName(extra)


def unpadded(df: DataFrame) -> DataFrame:
    return df.where(~F.col("padding")).drop("padding")


def dealt(df: DataFrame, place: str, workers: int, rest: bool = False) -> DataFrame:
    """Adds worker: runs of places of equal length; a number of rows that doesn't divide fails the job. rest: such rows go on to further runs of that length (no length, no worker)."""
    size = df.agg(F.floor(F.count("*") / workers).alias("_size"), (F.count("*") % workers).alias("_rest"))
    run = F.floor(F.col(place) / F.nullif(F.col("_size"), F.lit(0)))
    even = run if rest else F.when(F.col("_rest") == 0, run).otherwise(F.raise_error(f"rows don't divide among {workers} workers"))
    return df.crossJoin(F.broadcast(size)).withColumn("worker", even.cast("int")).drop("_size", "_rest")  # one row


def worked(df: DataFrame, place: str, workers: int, work, schema: str, rest: bool = False) -> DataFrame:
    """The parts of dealt() through work (a function of a pandas frame that keeps rows and their places), collected in the old order."""
    parts = dealt(df, place, workers, rest)
    return parts.groupBy("worker").applyInPandas(lambda pdf: work(pdf.sort_values(place).reset_index(drop=True)), schema)


def gathered(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Lists of each column's values in order: rows of metrics as one row of lists."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*keys).agg(rows.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in columns))


def micro_batches(lengths: list[int], budget: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """Places in micro-batches of nearly equal work: as few as the token budget needs, at least `least`, a multiple of `multiple`, small ones at both ends."""
    if max(lengths, default=0) > budget:
        raise ValueError("a sequence is longer than the budget")
    n = max(least, min(len(lengths), -(-sum(lengths) // budget)))
    n = -(-n // multiple) * multiple
    if n > len(lengths):
        raise ValueError("more micro-batches than sequences")
    costs = [24576 * x + x * x for x in lengths]
    parts = sorted(karmarkar_karp(costs, n), key=lambda p: (sum(costs[i] for i in p), p[:1]), reverse=True)
    return parts[::2][::-1] + parts[1::2]


def with_micro_batches(df: DataFrame, batch: Column, key: str, length: str, budget: int) -> DataFrame:
    """(batch, key, micro, place, back) of each batch, whose size the caller bounds; back: where the row stood in key order, which restores it."""
    kind = df.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        rows = [(pdf.batch[i], pdf[key][i], m, i) for m, part in enumerate(micro_batches(pdf[length].tolist(), budget)) for i in part]
        return pd.DataFrame([(b, k, m, p, i) for p, (b, k, m, i) in enumerate(rows)], columns=["batch", key, "micro", "place", "back"])

    return df.select(batch.cast("long").alias("batch"), key, F.col(length).cast("long").alias(length)).groupBy("batch").applyInPandas(one, f"batch long, {key} {kind}, micro int, place int, back int")


def resumed(df: DataFrame, order: list[str], size: int, done: int) -> DataFrame:
    """Batches of `size` rows in order (columns batch and at), from batch number `done` on, the last one short: what a reader sees that starts again."""
    rows = with_position(df, order, "_p")
    return rows.withColumns({"batch": F.floor(F.col("_p") / size).cast("int"), "at": (F.col("_p") % size).cast("int")}).where(F.col("batch") >= done).drop("_p")


def assembled(parts: list[DataFrame], metrics: list[str], name: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows of queue samples as one batch (name: which sample), and the mean of each metric over samples."""
    all_ = None
    for i, p in enumerate(parts):
        rows = p.withColumn(name, F.lit(i))
        all_ = rows if all_ is None else all_.unionByName(rows)
    each = all_.groupBy(name).agg(*(F.avg(m).alias(m) for m in metrics))
    return all_, each.agg(*(F.avg(m).alias(m) for m in metrics))


def appended(df: DataFrame, more: DataFrame, place: str) -> DataFrame:
    """A table with more rows at its end, whose places go on from its own."""
    last = df.agg(F.coalesce(F.max(place) + 1, F.lit(0)).alias("_next"))
    new = more.crossJoin(F.broadcast(last)).withColumn(place, F.col(place) + F.col("_next")).drop("_next")  # one row
    return df.unionByName(new)


def running_mean(df: DataFrame, key: list[str], order: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Adds mean_so_far, weighted by weight if given."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col(weight) if weight else F.lit(1)
    return df.withColumn("mean_so_far", F.sum(F.col(value) * n).over(w) / F.sum(n).over(w))


def total_work(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + workload(n).cast("long"))
