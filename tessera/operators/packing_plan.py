"""Packing of a whole table by a plan: no group of rows meets in one task.

The greedy rule (each pack takes the longest item that fits until none does) depends on lengths only. Their histogram, at most `capacity` numbers, is all that the
driver sees; on it the rule runs pattern by pattern, each repeated as often as the counts allow, which is at most twice for each length that is used up. Rows are then numbered within their
length, in salted parts, and find their pack by rank.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one length that one task numbers.
SALT_ROWS = 1 << 20


class Share(NamedTuple):
    """Rows of a length, from rank `begin` to `end`, that fill packs from `pack` on, `each` of them a pack, from place and offset on."""

    length: int
    begin: int
    end: int
    pack: int
    each: int
    place: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> Iterator[Share]:
    """Shares of all lengths up to the capacity; packs are numbered in the order in which the greedy rule fills them."""
    left = {n: c for n, c in histogram.items() if 0 <= n <= capacity and c > 0}
    order: list[int] = []
    for n in left:
        insort(order, n)
    used, pack = dict.fromkeys(left, 0), 0
    while order:
        room, pattern, at = capacity, [], len(order)
        while (at := bisect_right(order, room, 0, at)) > 0:
            n = order[at - 1]
            each = left[n] if n == 0 else min(left[n], room // n)
            pattern.append((n, each))
            room -= n * each
            at -= 1
        times = min(left[n] // each for n, each in pattern)
        place = offset = 0
        for n, each in pattern:
            yield Share(n, used[n], used[n] + times * each, pack, each, place, offset)
            used[n] += times * each
            left[n] -= times * each
            place, offset = place + each, offset + n * each
            if not left[n]:
                order.remove(n)
        pack += times


def packed_table(df: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """(pack, place, key, length, offset) of all rows; those that are longer than the capacity, or have no length, are left out.

    Which of two rows of one length comes first is decided by the key's hash and the key; keys that repeat are rows each.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_k"), F.col(length).cast("long").alias("_n")).where((F.col("_n") >= 0) & (F.col("_n") <= capacity))
    counts = {r["_n"]: r["c"] for r in rows.groupBy("_n").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    salts = max(1, max(counts.values(), default=0) // SALT_ROWS)
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(salts)))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_n", "_s").orderBy("_k")) - 1)
    sizes = rows.groupBy("_n", "_s").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.partitionBy("_n").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    numbered = numbered.join(before, ["_n", "_s"]).select("_k", "_n", (F.col("_r") + F.col("_b")).alias("_r")) if salts > 1 else numbered.select("_k", "_n", "_r")
    shares: dict[int, list[Share]] = {}
    for s in plan(counts, capacity):
        shares.setdefault(s.length, []).append(s)
    kind = "_n long, _shares array<struct<length:long,begin:long,`end`:long,pack:long,each:long,place:long,offset:long>>"
    planned = spark.createDataFrame([(n, [tuple(x) for x in found]) for n, found in shares.items()], kind)
    mine = F.get(F.filter("_shares", lambda s: (s["begin"] <= F.col("_r")) & (F.col("_r") < s["end"])), F.lit(0))
    found = numbered.join(F.broadcast(planned), "_n").withColumn("s", mine)  # a row for each length, at most capacity + 1
    at = F.col("_r") - F.col("s.begin")
    within = at % F.col("s.each")
    return found.select(
        (F.col("s.pack") + F.floor(at / F.col("s.each"))).alias("pack"), (F.col("s.place") + within).alias("place"), F.col("_k").alias(key), F.col("_n").alias(length),
        (F.col("s.offset") + within * F.col("_n")).alias("offset"),
    )


def packed_rows(df: DataFrame, key: str, ids: str, labels: str, capacity: int, pad: int, ignore: int = -100, neat: bool = True) -> DataFrame:
    """(pack, n, input_ids, labels, position_ids, attention): examples of each pack of packed_table(), one after another, padded to capacity; keys tell examples apart."""
    rows = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"), F.col(labels).alias("_labels"), F.size(ids).cast("long").alias("_size"))
    places = packed_table(rows, "_key", "_size", capacity).select("pack", "place", "_key")
    item = F.struct("place", F.col("_ids").alias("ids"), F.col("_labels").alias("labels"))
    packs = places.join(rows, "_key").groupBy("pack").agg(F.array_sort(F.collect_list(item)).alias("x"))  # a pack holds at most capacity tokens
    joined = lambda f: F.flatten(F.transform("x", f))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(capacity) - F.size(c)))
    number = lambda p, i: F.array_repeat(i + 1 if neat else F.lit(1), F.size(p["ids"]))
    positions = lambda p: F.transform(p["ids"], lambda _, i: i)
    return packs.select(
        "pack", F.size("x").alias("n"), fill(joined(lambda p: p["ids"]), pad).alias("input_ids"), fill(joined(lambda p: p["labels"]), ignore).alias("labels"), fill(joined(positions), 0).alias("position_ids"),
        fill(F.flatten(F.transform("x", number)), 0).alias("attention"),
    )
