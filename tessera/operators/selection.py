"""Exact selection of the first n rows of an order without sorting the table.

Rounds of counts narrow the range in which the n-th key lies: each counts keys in equal parts of the range, with map-side combination, and goes on in the part that the n-th falls in, with
that part's own least and greatest key, so that a range shrinks until its keys are equal or few. Equal keys go on with the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1024
#: So few rows are sorted as they are.
FEW = 1 << 16
INFINITE = float("inf")


def number_of(hex_: Column) -> Column:
    """The first 12 digits of a hexadecimal text as a number, in the same order."""
    return F.conv(F.substring(hex_, 1, 12), 16, 10).cast("double")


def first_n(df: DataFrame, keys: list[Column], n: int, order: list[Column | str]) -> DataFrame:
    """The first n rows by keys (numbers) and then order; rows with a null or NaN key come last and take no part.

    order must tell rows apart where all keys are equal, or which of them come is left open; so many rows that agree in all keys are sorted at once.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select("*", *(k.cast("double").alias(name) for k, name in zip(keys, names, strict=True)))
    for name in names:
        rows = rows.where(F.col(name).isNotNull() & ~F.isnan(name))
    taken, left, open_ = None, n, rows
    for name in names:
        if left <= 0:
            break
        x = F.col(name)
        total = open_.agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        inside, lo, hi = total.n, total.lo, total.hi
        if inside <= left:
            taken, left = _with(taken, open_), 0
            break
        below = 0
        while inside > FEW and lo < hi:
            share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, so that no difference overflows
            finite = F.least(F.lit(PARTS - 1), F.floor(share * PARTS))
            part = (finite if abs(lo) < INFINITE and abs(hi) < INFINITE else F.when(x == -INFINITE, 0).when(x == INFINITE, 2).otherwise(1)).cast("long")  # least and greatest keys are in different parts
            found = open_.where((x >= lo) & (x <= hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy("part").collect()  # at most PARTS rows
            for r in found:
                if below + r.n >= left:
                    inside, lo, hi = r.n, r.lo, r.hi
                    break
                below += r.n
        taken, left = _with(taken, open_.where(x < lo)), left - below
        open_ = open_.where((x >= lo) & (x <= hi))
        if inside <= FEW or lo < hi:
            break
    if left > 0:
        taken = _with(taken, open_.orderBy(*names, *order).limit(left))
    return (taken if taken is not None else rows.limit(0)).drop(*names)


def _with(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionAll(b)
