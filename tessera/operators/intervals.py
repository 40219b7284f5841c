"""Joins of intervals and points of flat tables, without comparing all pairs.

An interval has a level, the least power of two that holds its length, and at any level from its own on lies in at most two bins of that width. Two intervals
meet at the greater of their levels, in the first bin that both have: an equi-join on keys, level, the side that this level belongs to, and bin, which adaptive execution splits where a bin is hot. Without keys, tasks are as many as the pairs of the bins need, and a bin of very many pairs is dealt to several. An interval
is copied only to the levels from its own on that the other side has, and many candidates of a bin are true matches, since the longer of two fills half a bin at least; two of lesser levels
never meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The level of points and of intervals shorter than two to this power.
LEAST_LEVEL = -20
#: Pairs of one task's bins, and the most tasks (more pairs a task beyond them).
PAIRS, MOST_TASKS = 1 << 22, 1 << 14


def _level(length: Column) -> Column:
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(length, F.lit(2.0**LEAST_LEVEL))))).cast("int")


def _binned(df: DataFrame, on: list[str], start: str, end: str, others: list[int], side: str) -> DataFrame:
    """(on, level, whose, bin, first bin, all columns as a struct), once for each bin at its own level, and at the levels of others that are not less; whose: the side that has an interval of this level.

    Where both have, the level is the left side's.
    """
    a, b = F.col(start).cast("double"), F.col(end).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull() & (a <= b)).select(*(F.col(k).alias(f"_{side}_{k}") for k in on), a.alias(f"_{side}_a"), b.alias(f"_{side}_b"), _level(b - a).alias("own"), F.struct("*").alias(f"_{side}"))

    def at(level: Column, whose: str) -> Column:
        return F.struct(level.alias("level"), F.lit(whose).alias("whose"))

    fits = (lambda x: x > F.col("own")) if side == "l" else (lambda x: x >= F.col("own"))
    above = F.transform(F.filter(F.array(*map(F.lit, others)).cast("array<int>"), fits), lambda x: at(x, "r" if side == "l" else "l"))
    rows = rows.withColumn("at", F.explode(F.concat(F.array(at(F.col("own"), side)), above)))
    rows = rows.withColumns({f"_{side}_level": F.col("at.level"), f"_{side}_whose": F.col("at.whose")}).drop("at", "own")
    width = F.pow(F.lit(2.0), f"_{side}_level")
    first, last = F.floor(F.col(f"_{side}_a") / width), F.floor(F.col(f"_{side}_b") / width)
    return rows.withColumn(f"_{side}_first", first).withColumn(f"_{side}_bin", F.explode(F.sequence(first, last)))


def levels_of(df: DataFrame, start: str, end: str) -> list[int]:
    """Levels that occur, of which numbers of 64 bits allow some 1,100 at most; in practice a few."""
    found = df.select(_level(F.col(end).cast("double") - F.col(start).cast("double")).alias("level")).where("level is not null").distinct()
    return sorted(r.level for r in found.collect())


def _dealt(a: DataFrame, b: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides by tasks that bring no more than some PAIRS together each, and the names that they are to agree in.

    Sides are small beside their pairs, so that sizes of shuffled blocks, by which adaptive execution joins tasks, do not tell the work.
    """
    def of(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*(F.col(f"_{side}_{k}").alias(f"_{k}") for k in names)).agg(F.count("*").cast("double").alias(f"n_{side}"))

    keys = [f"_{k}" for k in names]
    bins = of(a, "l").join(of(b, "r"), keys).select(*keys, (F.col("n_l") * F.col("n_r")).alias("pairs"), (F.col("n_l") >= F.col("n_r")).alias("by_left"))
    pairs, hot = bins.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.count_if(F.col("pairs") > PAIRS)).first()
    if pairs <= PAIRS:
        return a, b, names
    if hot:  # at most pairs / PAIRS bins
        shares = bins.where(F.col("pairs") > PAIRS).select(*keys, "by_left", F.least(F.ceil(F.col("pairs") / PAIRS), F.lit(MOST_TASKS)).cast("int").alias("shares"))

        def with_share(df: DataFrame, side: str) -> DataFrame:
            of_row = [f"_{side}.`{f.name}`" for f in df.schema[f"_{side}"].dataType.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
            rows = df.join(F.broadcast(shares), [F.col(f"_{side}_{k}") == F.col(f"_{k}") for k in names], "left")
            own = F.array(F.pmod(F.xxhash64(*of_row), F.col("shares").cast("long")).cast("int"))
            deals = F.col("by_left") if side == "l" else ~F.col("by_left")
            share = F.when(F.col("shares").isNull(), F.array(F.lit(0))).when(deals, own).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))
            return rows.withColumn(f"_{side}_share", F.explode(share)).select(*df.columns, f"_{side}_share")

        a, b, names = with_share(a, "l"), with_share(b, "r"), [*names, "share"]
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, int(-(-pairs // PAIRS))))
    a, b = (df.repartition(tasks, *(f"_{side}_{k}" for k in names)) for df, side in ((a, "l"), (b, "r")))
    return a, b, names


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], condition: Column | None = None) -> DataFrame:
    """(l, r): pairs of rows, as structs, that agree in `on` and whose closed intervals meet; a point is an interval whose ends are one column.

    Rows with a null end, or one before its start, meet nothing; null keys agree with nothing. condition: further demands on l and r.
    """
    a, b = _binned(left, on, *left_ends, levels_of(right, *right_ends), "l"), _binned(right, on, *right_ends, levels_of(left, *left_ends), "r")
    names = [*on, "level", "whose", "bin"]
    if not on:  # bins are few then, and hold many pairs; with keys, counting them costs more than it spares
        a, b, names = _dealt(a, b, names)
    same = F.lit(True)
    for k in names:
        same = same & (F.col(f"_l_{k}") == F.col(f"_r_{k}"))
    once = F.col("_l_bin") == F.greatest("_l_first", "_r_first")
    meet = (F.col("_l_a") <= F.col("_r_b")) & (F.col("_r_a") <= F.col("_l_b"))
    pairs = a.join(b, same & once & meet).select(F.col("_l").alias("l"), F.col("_r").alias("r"))
    return pairs if condition is None else pairs.where(condition)


def holding(points: DataFrame, windows: DataFrame, on: list[str], at: str, ends: tuple[str, str], order: list[str]) -> DataFrame:
    """Each point with the first window, by order, that holds it (a struct `window`, null if none does); points are told apart by all their columns."""
    found = overlapping(points, windows, on, (at, at), ends)
    first = found.groupBy("l").agg(F.min_by("r", F.struct(*(F.col(f"r.{o}") for o in order))).alias("window"))
    none = points.select(F.struct("*").alias("p")).distinct()
    return none.join(first, F.col("p").eqNullSafe(F.col("l")), "left").select("p.*", "window")


def before(queries: DataFrame, windows: DataFrame, on: list[str], at: str, end: str) -> DataFrame:
    """(l, r): each query with all windows of its keys that end by its time: an equi-join, as large as its result."""
    l, r = queries.select(F.struct("*").alias("l")), windows.select(F.struct("*").alias("r"))  # noqa: E741
    same = F.col(f"r.{end}") <= F.col(f"l.{at}")
    for k in on:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, same)
