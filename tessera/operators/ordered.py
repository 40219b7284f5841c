"""Operators on ordered sequences: gaps, greedy choices, islands, streaks, folds and lookups in time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def least_adjacent_gap(df: DataFrame, key: list[str], time: str) -> DataFrame:
    gap = F.col(time) - F.lag(time).over(by(key, [time]))
    return df.withColumn("_gap", gap).groupBy(*key).agg(F.min("_gap").alias("gap"))


def running_number(df: DataFrame, key: list[str], order: list[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by(key, order)) - 1)


def history(df: DataFrame, key: list[str], order: list[str], value: Column, name: str = "history") -> DataFrame:
    """Values of all earlier rows of the key, in order."""
    return df.withColumn(name, F.collect_list(value).over(by(key, order).rowsBetween(Window.unboundedPreceding, -1)))


def recent(df: DataFrame, key: list[str], order: list[str], value: Column, n: int, name: str = "recent") -> DataFrame:
    """Values of the last n rows, this one included."""
    return df.withColumn(name, F.collect_list(value).over(by(key, order).rowsBetween(1 - n, 0)))


def scanned(values: Column, step: Callable[[list[float]], list[float]]) -> Column:
    """step of each array, in Arrow batches: for recursions along a sequence, which built-in folds would copy at each step."""

    @F.pandas_udf("array<double>")
    def each(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else step([float(x) for x in a]) for a in arrays], dtype=object)

    return each(values.cast("array<double>"))


def discounted(rewards: Column, beta: float) -> Column:
    """c[t] = r[t] + beta c[t+1] of an array in time order."""

    def step(r: list[float]) -> list[float]:
        total, out = 0.0, []
        for x in reversed(r):
            total = x + beta * total
            out.append(total)
        return out[::-1]

    return scanned(rewards, step)


def all_later(df: DataFrame, key: list[str], order: list[str], flag: str, name: str = "all_later") -> DataFrame:
    """Whether flag holds in this row and all later ones."""
    w = by(key, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.min(F.coalesce(F.col(flag), F.lit(False))).over(w))


def thinned(times: Column, gap: float) -> Column:
    """Of an ascending array, each time at least gap after the last one kept."""

    def step(ts: list[float]) -> list[float]:
        out: list[float] = []
        for t in ts:
            if not out or t - out[-1] >= gap:
                out.append(t)
        return out

    return scanned(times, step)


def spread_best(items: Column, gap: float, most: int) -> Column:
    """Of structs (score, at), the best scores first (ties: earlier), each at least gap from all chosen; at most `most`, by place."""
    ordered = F.array_sort(items, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    start = F.array().cast("array<double>")
    chosen = F.aggregate(
        F.transform(ordered, lambda x: x["at"].cast("double")), start,
        lambda kept, t: F.when((F.size(kept) < most) & F.forall(kept, lambda k: F.abs(k - t) >= gap), F.concat(kept, F.array(t))).otherwise(kept),
    )
    return F.array_sort(chosen)


def islands(df: DataFrame, key: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Intervals of a key merged while the next one starts less than gap after the furthest end so far."""
    w = by(key, [start, end])
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(F.col(start) - before < gap, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(w))
    return rows.groupBy(*key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def filled_gaps(df: DataFrame, key: list[str], start: str, end: str, first: Column, last: Column, size: int) -> DataFrame:
    """Tumbling chunks of at most `size` in the gaps that inclusive whole-number intervals leave between first and last."""
    w = by(key, ["s"])
    rows = df.select(*key, F.col(start).alias("s"), F.col(end).alias("e"), first.alias("lo"), last.alias("hi"))
    rows = rows.withColumn("from", F.coalesce(F.lag("e").over(w) + 1, F.col("lo"))).withColumn("tail", F.lead("s").over(w).isNull())
    gaps = rows.select(
        *key,
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("from") < F.col("s"), F.struct(F.col("from").alias("a"), (F.col("s") - 1).alias("b"))),
                    F.when(F.col("tail") & (F.col("e") < F.col("hi")), F.struct((F.col("e") + 1).alias("a"), F.col("hi").alias("b"))),
                )
            )
        ),
    )
    chunks = gaps.select(*key, "b", F.explode(F.sequence("a", "b", F.lit(size).cast("long"))).alias("start"))
    return chunks.select(*key, "start", F.least(F.col("start") + size - 1, F.col("b")).alias("end"))


def streak(df: DataFrame, key: list[str], order: list[str], reset: str, name: str = "streak") -> DataFrame:
    """Rows since the last reset of the key, which counts as zero."""
    w = by(key, order)
    rows = df.withColumn("_part", F.sum(F.col(reset).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order))
    return rows.withColumn(name, F.when(F.col("_part") == 0, n).otherwise(n - 1)).drop("_part")


def last_answer(df: DataFrame, key: list[str], order: str, answer: str) -> DataFrame:
    """The last non-empty answer of each key."""
    said = F.trim(F.coalesce(answer, F.lit(""))) != ""
    return df.groupBy(*key).agg(F.max_by(F.when(said, F.col(answer)), F.when(said, F.col(order))).alias("answer"))


def smoothed(values: Column, weight: float) -> Column:
    """Exponential moving averages of an array."""

    def step(vs: list[float]) -> list[float]:
        out: list[float] = []
        for v in vs:
            out.append(out[-1] * weight + v * (1 - weight) if out else v)
        return out

    return scanned(values, step)


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the key's latest right row at or before it (strict: before it).

    Both sides are united and sorted once by key and time; the last right row so far is carried along.
    """
    row = F.struct(F.col(right_time).alias("at"), *values)
    kind = right.select(row.alias("r")).schema["r"].dataType
    names = left.columns
    a = left.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
        F.struct(*names).alias("_left"), F.lit(None).cast(kind).alias("_right"),
    )
    b = right.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*names).alias("l")).schema["l"].dataType).alias("_left"), row.alias("_right"),
    )
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(key)))).orderBy("_t", "_side", *(F.col(f"_right.{v}") for v in values)).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionAll(b).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return found.select("_left.*", F.col("_found.at").alias("found_time"), *(F.col(f"_found.{v}").alias(v) for v in values))
