"""Exact counting of repeated windows: packed runs of windows meet in their bucket.

A window is `length` consecutive units (words or bytes) of a document. Callers find which windows can
repeat at all and send runs of such windows as one packed string each to the bucket of a key that equal
windows share. `counted` sorts the windows of each bucket and says which occur more than once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

PACKED = "key long, salt int, salts int, row long, start int, n int, packed binary"
#: Rows whose buckets are counted together.
TOGETHER = 1000
FOUND = "row long, start int, n int, window binary, times long"


def salted(keyed: DataFrame, most: int) -> DataFrame:
    """Deals the rows of a key that has more than `most` of them (column rows) to several salts."""
    salts = F.ceil(F.col("rows") / F.lit(most)).cast("int")
    dealt = F.pmod(F.xxhash64("row", "start"), F.col("salts").cast("long")).cast("int")
    return keyed.withColumn("salts", salts).withColumn("salt", dealt).drop("rows")


def word_windows(length: int) -> Callable[[bytes, int], list[bytes]]:
    def cut(packed: bytes, n: int) -> list[bytes]:
        at, i = [0], packed.find(b" ")
        while i >= 0:
            at.append(i + 1)
            i = packed.find(b" ", i + 1)
        at.append(len(packed) + 1)
        return [packed[at[i] : at[i + length] - 1] for i in range(n)]

    return cut


def byte_windows(length: int) -> Callable[[bytes, int], list[bytes]]:
    def cut(packed: bytes, n: int) -> list[bytes]:
        return [packed[i : i + length] for i in range(n)]

    return cut


class Found:
    """Rows of FOUND."""

    def __init__(self) -> None:
        self.cols: tuple[list, ...] = ([], [], [], [], [])

    def add(self, *row) -> None:
        for c, v in zip(self.cols, row, strict=True):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.cols, kinds, strict=True)], names=["row", "start", "n", "window", "times"])
        self.cols = ([], [], [], [], [])
        return out


def exact_bucket(cut: Callable[[bytes, int], list[bytes]]) -> Callable:
    """Counts windows by sorting them as strings; rows: row, start, n, packed, salts."""

    def bucket(rows: list[tuple], out: Found) -> None:
        where: dict[tuple[bytes, int, bool], list[tuple[int, int]]] = {}
        for doc, start, n, packed, salts in rows:
            where.setdefault((packed, n, salts > 1), []).append((doc, start))
        each = [cut(packed, n) for packed, n, _ in where]
        order = sorted((w, i, j) for i, windows in enumerate(each) for j, w in enumerate(windows))
        copies = [len(v) for v in where.values()]
        flags = [bytearray(len(w)) for w in each]
        several, k = [s for _, _, s in where], 0
        places = list(where.values())
        while k < len(order):
            w, times, e = order[k][0], copies[order[k][1]], k + 1
            while e < len(order) and order[e][0] == w:
                times += copies[order[e][1]]
                e += 1
            if times > 1:
                for _, i, j in order[k:e]:
                    flags[i][j] = 1
            if several[order[k][1]]:  # other salts may hold it too
                _, i, j = order[k]
                doc, start = places[i][0]
                out.add(doc, start + j, 1, hashlib.blake2b(w, digest_size=16).digest(), times)
            k = e
        for flag, at in zip(flags, places, strict=True):
            j = flag.find(1)
            while j >= 0:
                e = flag.find(0, j)
                e = len(flag) if e < 0 else e
                for doc, start in at:
                    out.add(doc, start + j, e - j, None, 0)
                j = flag.find(1, e)

    return bucket


def _counter(bucket: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands whole buckets to `bucket`, TOGETHER rows or one bucket at a time: windows of different keys always differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, out = None, Found()
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("key", "salt", "row", "start", "n", "packed", "salts")]
            for key, salt, *row in zip(*cols, strict=True):
                if len(held) >= TOGETHER and (key, salt) != last or salt and (key, salt) != last:
                    bucket(held, out)
                    held = []
                last = key, salt
                held.append(tuple(row))
            yield out.batch()
        if held:
            bucket(held, out)
        yield out.batch()

    return run


def counted(packed: DataFrame, bucket: Callable, name: str) -> DataFrame:
    """Runs (row, start, n) of windows that occur more than once, from rows of PACKED.

    A bucket dealt to several salts is counted in each; one row for each of its distinct windows and salt then
    settles what no salt could see alone, grouped by a 128-bit digest of the window.
    """
    found = packed.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_counter(bucket), FOUND)
    found = written(found, name)
    one = found.where("window is null").select("row", "start", "n")
    spread = found.where("window is not null")
    more = spread.groupBy("window").agg(F.sum("times").alias("all")).where("all > 1")
    late = spread.where("times = 1").join(more, "window").select("row", "start", "n")
    return one.unionAll(late)


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of rows_of() with the runs of their windows, as a set."""
    return texts.join(runs.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("runs")), "row", "left")


def covered(n_units: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which units the windows cover that begin in the runs (starts, counts)."""
    edge = np.zeros(n_units + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + length, n_units), -1)
    return np.cumsum(edge[:-1]) > 0
