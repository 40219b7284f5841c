"""Shared by the operators of this package: tables, shared storage, Arrow and numpy helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tessera.shipping import ship
from tessera.storage import shared_dir

#: Rows in one Arrow batch; texts are long, so that batches stay at a few MB. (A limit of bytes costs time for each row of narrow tables.)
BATCH_ROWS = "1000"
#: Bytes of text that the vectorised helpers handle at once; a longer text is one chunk.
CHUNK_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The package on the executors, the shared folder, and Arrow batches of a few MB unless the session has a size of its own."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared_dir(spark)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run meanwhile go as soon as each has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors. sweep() or discard() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    _written.append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # what nothing deletes goes with the driver
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that operators of this process wrote, from number `since` on; call it when their results are stored."""
    while len(_written) > since:
        _delete(spark, _written.pop())


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in tables:
        if df._tessera_path in _written:
            _written.remove(df._tessera_path)
            _delete(df.sparkSession, df._tessera_path)


_left: list[str] = []


@contextmanager
def discard_later(spark: SparkSession) -> Iterator[None]:
    """A stage whose input is stored: deletes what the stage before it wrote on its way, and notes what this one writes."""
    while _left:
        _delete(spark, _left.pop())
    before = len(_written)
    yield
    _left.extend(_written[before:])
    del _written[before:]


#: So many rows at most of a join's small side are broadcast; more are joined by a shuffle.
SENT_ROWS = 1 << 20


def sent_side(df: DataFrame) -> DataFrame:
    """df, a written table of a few numbers a row, as a side of a join: broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text (null: empty) of df, whatever else it has."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings or binaries; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(col) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def columns_of(**kinds: str | DataType) -> StructType:
    """A schema from kinds by name; types of other columns come as they are, whatever their fields are called."""
    out = StructType()
    for name, kind in kinds.items():
        out.add(name, kind if isinstance(kind, DataType) else StructType.fromDDL(f"x {kind}")["x"].dataType)
    return out


def row_of(key: Column, text: Column) -> Column:
    """The row number of a key and a text (null: empty), which tells rows apart whether keys are null or repeat."""
    return F.xxhash64(key.cast("long"), F.coalesce(text, F.lit("")))


def rows_of(df: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, rest, text): row tells texts and keys apart, whether keys are null or repeat; rest: the key (doc_id) and what to carry.

    Rows that are equal in key and text share a row number.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    doc_id = F.col(key).cast("long")
    return df.select(
        row_of(F.col(key), F.col(text)).alias("row"),
        F.struct(
            doc_id.alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("own") if carry else F.lit(None).cast("boolean").alias("own"),
        ).alias("rest"),
        text_.alias("text"),
    )


# --- hashing of stretches of bytes or words -------------------------------------------------

_P = 0x9E3779B97F4A7C55
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Random 64-bit values of the bytes, from a fixed seed.
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 16)
        for k, base in (("up", _P), ("down", _INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """Polynomial hashes modulo 2**64 of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, _ = _power(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power(len(self.sums))
        return mixed((self.sums[end] - self.sums[start]) * down[start])


def _cell_values(cells: np.ndarray) -> np.ndarray:
    """A random value for each place * 256 + byte."""
    return mixed(cells.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))


#: Those of the first places, where most words end.
_CELLS = _cell_values(np.arange(64 << 8))

SLICE_BYTES = 1 << 20


def _slices(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words of about SLICE_BYTES."""
    part = (np.cumsum(size) - size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    return list(zip(cuts, cuts[1:], strict=False))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random value for each byte at each place, so that no structure of a word cancels."""
    size = ends - starts
    total = int(size.sum())
    if not total:
        return np.zeros(len(starts), np.uint64)
    if total > 2 * SLICE_BYTES and len(parts := _slices(size)) > 1:  # a very long text
        return np.concatenate([word_hashes(data, starts[i:j], ends[i:j]) for i, j in parts])
    first = np.cumsum(size) - size
    at = np.arange(total)
    cells = at - np.repeat(first, size)
    at += np.repeat(starts - first, size)
    cells <<= 8
    cells += np.take(data, at)
    values = np.take(_CELLS, cells) if size.max() <= len(_CELLS) >> 8 else _cell_values(cells)
    return mixed(np.add.reduceat(values, first) + size.astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


#: Space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_in(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words in the texts that offsets cut data into."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = np.empty(n + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inner = ~gap[1:-1]
    starts = np.flatnonzero(inner & (gap[:-2] | cut[:-1]))
    ends = np.flatnonzero(inner & (gap[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive keys."""
    a, span = keys, 1
    while span * 2 <= w:
        a = np.minimum(a[: len(a) - span], a[span:])
        span *= 2
    if span < w:
        n = len(keys) - w + 1
        a = np.minimum(a[:n], a[w - span : w - span + n])
    return a


def minimisers(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each w consecutive hashes: place of the leftmost least one, and whether the least occurs again there.

    Their upper 40 bits are compared.
    """
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    low = np.uint64((1 << 24) - 1)
    if n > 1 << 24:  # a text of over 16 million units: in overlapping pieces
        parts = [minimisers(hashes[i : i + (1 << 24)], w) for i in range(0, n - w + 1, (1 << 24) - w + 1)]
        step = (1 << 24) - w + 1
        return np.concatenate([p[0] + i * step for i, p in enumerate(parts)]), np.concatenate([p[1] for p in parts])
    high, at = hashes & ~low, np.arange(n, dtype=np.uint64)
    left = sliding_min(high | at, w) & low
    right = low - (sliding_min(high | (low - at), w) & low)
    return left.astype(np.int64), left != right


def runs_of(same_as_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; same_as_before[i]: item i goes on with the run of item i - 1."""
    starts = np.flatnonzero(~same_as_before)
    return starts, np.diff(np.append(starts, len(same_as_before)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(col: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of one field of a column of lists of structs, and the lists' offsets; nulls are empty."""
    lengths = np.asarray(col.value_lengths().fill_null(0), np.int64)
    flat = col.flatten()
    return flat.field(field).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths))
