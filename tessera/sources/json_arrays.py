"""JSON documents that are one list of rows, however large, read by many tasks.

Whether a byte lies within a string, and how deep, depends on all bytes before it. A first job reads chunks side by side and says of each what it does to both: whether its
quotes change the state, and the change of depth if it begins outside and if it begins inside a string. Chained, these few numbers a chunk give every chunk its beginning. A second job finds
the list (of objects that hold one under a name), a third cuts the rows that begin in a chunk, reading on for the last one's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship
from tessera.sources.ranges import cut, listed, size_of

CHUNK = 8 << 20
QUOTE, BACKSLASH, COMMA = b'"'[0], b"\\"[0], b","[0]
OPENS, CLOSES = np.frombuffer(b"[{", np.uint8), np.frombuffer(b"]}", np.uint8)
#: By byte: whether it is a bracket or a comma, and how it changes the depth.
MARKS, STEPS = np.zeros(256, bool), np.zeros(256, np.int8)
MARKS[[COMMA, *OPENS, *CLOSES]] = True
STEPS[OPENS], STEPS[CLOSES] = 1, -1
#: Bytes before a list in which its name must stand, and bytes that are read on at once.
NAME_BYTES, AHEAD = 1 << 12, 1 << 20
MOST_TASKS = 4096


@dataclass(frozen=True)
class Chunk:
    """A stretch of a file, and how it begins: within a string or not, so many brackets deep. parts: the files (and sizes) that make up a document of several."""

    file: str
    start: int
    end: int
    inside: bool = False
    depth: int = 0
    parts: tuple[tuple[str, int], ...] = ()

    def cut(self, start: int, end: int) -> bytes:
        """Bytes of the document, wherever its files end."""
        if not self.parts:
            return cut(self.file, start, end)
        out, at = [], 0
        for name, size in self.parts:
            if start < at + size and at < end:
                out.append(cut(name, max(0, start - at), min(size, end - at)))
            at += size
        return b"".join(out)


def _backslashes(c: Chunk, at: int) -> int:
    """How many end right before a place."""
    n, step = 0, 256
    while at - n > 0:
        part = c.cut(max(0, at - n - step), at - n)
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < len(part):
            break
    return n


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Places of quotes that no backslash escapes; before: backslashes right before the data. Memory goes by the marks, not by the bytes."""
    at, slashes = np.flatnonzero(data == QUOTE), np.flatnonzero(data == BACKSLASH)
    run = np.where(at == 0, before, 0)
    if len(at) and len(slashes):
        new = np.r_[True, np.diff(slashes) > 1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # of each backslash: where its run begins
        length = np.arange(len(slashes)) - first + 1 + np.where(slashes[first] == 0, before, 0)
        k = np.searchsorted(slashes, at) - 1
        run = np.where((k >= 0) & (slashes[np.maximum(k, 0)] == at - 1), length[np.maximum(k, 0)], run)
    return at[run % 2 == 0]


def structure(data: bytes, before: int, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, bytes and depths after them of all brackets and commas outside strings."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(MARKS[b])
    at = at[(np.searchsorted(_quotes(b, before), at) + inside) % 2 == 0]
    return at, b[at], depth + np.cumsum(STEPS[b[at]], dtype=np.int64)


def _effect(c: Chunk) -> dict:
    data, before = c.cut(c.start, c.end), _backslashes(c, c.start)
    ends = [structure(data, before, inside, 0)[2] for inside in (False, True)]
    return {"file": c.file, "start": c.start, "odd": bool(len(_quotes(np.frombuffer(data, np.uint8), before)) % 2), "outside": int(ends[0][-1]) if len(ends[0]) else 0, "within": int(ends[1][-1]) if len(ends[1]) else 0}


def _lists(c: Chunk, names: tuple[str, ...]) -> list[dict]:
    """Where a document's own list, or one under a name in its object, begins or ends in this chunk; rank: which name."""
    data = c.cut(c.start, c.end)
    at, byte, depth = structure(data, _backslashes(c, c.start), c.inside, c.depth)
    out = [{"file": c.file, "at": c.start + int(i), "depth": int(d), "opens": False, "rank": -1} for i, x, d in zip(at, byte, depth, strict=True) if x == CLOSES[0] and d <= 1]
    for i, x, d in zip(at.tolist(), byte.tolist(), depth.tolist(), strict=True):
        if x == OPENS[0] and d <= 2:
            held = (c.cut(max(0, c.start - NAME_BYTES), c.start) + data[:i])[-NAME_BYTES:].rstrip()
            rank = next((r for r, n in enumerate(names) if d == 2 and held.endswith(b":") and held[:-1].rstrip().endswith(b'"' + n.encode() + b'"')), -1 if d == 2 else 0)
            if rank >= 0:
                out.append({"file": c.file, "at": c.start + i, "depth": d, "opens": True, "rank": rank})
    return out


def _rows(c: Chunk, begin: int, end: int, depth: int) -> Iterator[str]:
    """Elements, of the list between begin and end at a depth, whose separator (or the list's bracket) lies in this chunk."""
    data, before = c.cut(c.start, min(c.end, end + 1)), _backslashes(c, c.start)
    at, byte, d = structure(data, before, c.inside, c.depth)
    marks = at[((byte == COMMA) & (d == depth) | (c.start + at == begin)) & (c.start + at >= begin) & (c.start + at < end)]
    if not len(marks):
        return
    stop, ahead = None, min(AHEAD, max(1 << 12, (c.end - c.start) // 4))
    while stop is None:  # the last element may go on beyond the chunk
        after = at[(at > marks[-1]) & (((byte == COMMA) & (d == depth)) | ((byte == CLOSES[0]) & (d == depth - 1)))]
        if len(after):
            stop = int(after[0])
        elif c.start + len(data) > end or not (more := c.cut(c.start + len(data), c.start + len(data) + ahead)):
            raise ValueError(f"{c.file}: a list does not end")
        else:
            data, ahead = data + more, min(AHEAD, 2 * ahead)
            at, byte, d = structure(data, before, c.inside, c.depth)
    for lo, hi in zip(marks.tolist(), [*marks[1:].tolist(), stop], strict=True):
        text = data[lo + 1 : hi].decode("utf-8", "replace").strip()
        if text:
            yield text


def _each(spark: SparkSession, chunks: list[tuple], work, schema: str) -> DataFrame:
    """work of each chunk's arguments, a task each."""
    numbered = spark.range(len(chunks), numPartitions=max(1, min(len(chunks), MOST_TASKS)))
    sent = spark.sparkContext.broadcast(chunks)  # a few numbers a chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                rows = list(work(*sent.value[i]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return numbered.mapInArrow(run, schema)


def json_texts(spark: SparkSession, path: str, names: tuple[str, ...] = ("data", "annotations", "samples"), chunk: int = CHUNK, joined: bool = False) -> DataFrame:
    """(value): the rows, as JSON texts, of files that are a list of rows, or an object that holds one under one of the names (the first of them that is there).

    joined: a folder's files, one after another by name, are one document; so tasks can write it side by side.
    """
    ship(spark)
    sizes, parts = {f: size_of(f) for f in listed(spark, path)}, ()
    if joined:
        parts = tuple(sizes.items())
        sizes = {path: sum(sizes.values())}
    cuts = [Chunk(f, lo, min(lo + chunk, n), parts=parts) for f, n in sizes.items() for lo in range(0, n, chunk)]
    found = {(r.file, r.start): r for r in _each(spark, [(c,) for c in cuts], lambda c: [_effect(c)], "file string, start long, odd boolean, outside long, within long").collect()}  # a row a chunk
    begun, file, inside, depth = [], None, False, 0
    for c in cuts:
        if c.file != file:
            file, inside, depth = c.file, False, 0
        begun.append(Chunk(c.file, c.start, c.end, inside, depth, c.parts))
        r = found[c.file, c.start]
        inside, depth = inside != r.odd, depth + (r.within if inside else r.outside)
    marks = _each(spark, [(c, names) for c in begun], _lists, "file string, at long, depth long, opens boolean, rank long").collect()  # lists of a document's top levels
    lists = {}
    for f in sizes:
        opens = sorted((r.depth, r.rank, r.at) for r in marks if r.file == f and r.opens)
        if opens:
            deep, _, begin = opens[0]
            lists[f] = begin, min((r.at for r in marks if r.file == f and not r.opens and r.at > begin and r.depth == deep - 1), default=sizes[f]), deep
    work = [(c, *lists[c.file]) for c in begun if c.file in lists and c.end > lists[c.file][0] and c.start <= lists[c.file][1]]
    return _each(spark, work, lambda *a: ({"value": t} for t in _rows(*a)), "value string")


def parsed(values: DataFrame, row: Column) -> DataFrame:
    return values.select(row.alias("r")).where(F.col("r").isNotNull()).select("r.*")
