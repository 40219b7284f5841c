"""Exact top-k search by inner product: tiled matrix products, a partial selection per tile, merged top lists.

Each component becomes floor(scale * x) as an integer-valued double, so that products are exact and ties are true ties,
which go to the smaller key. Up to BLOCK queries are broadcast and all rows stream past them. More are dealt to blocks, the rows to
shards, and every pair of a block and a shard is one cell of a grid, worked on in one job: a cell's tiles give one top list a query.
Lists are merged in two steps.

Defined results: rows with a null vector, a null or non-finite component, or a null key take no part; shorter vectors count as padded with zeros;
a query's own key is no candidate; rows that repeat a key are candidates each, but one query (of the smallest vector); without queries or rows the result is empty;
other columns are ignored. Vectors too large for exact products of doubles are multiplied as integers of any size; a score in a list that is no long raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare

#: Queries in a block, rows in a tile, and rows in a shard of the grid.
BLOCK, TILE, SHARD = 4096, 4096, 1 << 16
#: Lists that one first merge takes.
FAN = 64
LEAST, EXACT = -(1 << 62), 1 << 50
LISTS = "query_id long, vec_id long, score long"


def _matrix(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and integer vectors of the rows that take part."""
    keys, vectors = batch.column("key"), batch.column("vector")
    ok = keys.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    n = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    row = np.repeat(np.arange(len(n)), n)
    ok[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(n), int(n.max(initial=0))))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    live = np.isfinite(flat)
    out[row[live], place[live]] = np.floor(scale * flat[live])
    return keys.fill_null(0).to_numpy()[ok], out[ok]


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they fit, else as Python's integers."""
    width = max(q.shape[1], c.shape[1])
    q, c = _padded(q, width), _padded(c, width)
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(len(x), width)
    return whole(q).dot(whole(c).T)


def tile_best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and keys (queries x at most k) of a tile's best rows; LEAST where there are too few."""
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    large = np.zeros(len(ids), bool)
    if len(ids) and len(qids):
        width = max(q.shape[1], c.shape[1], 1)
        most = np.abs(q).max(axis=1, initial=0)
        if most.max() * np.abs(c).max(initial=0) * width >= EXACT:  # the rows, or else the queries, that are too large go apart
            large = np.abs(c).max(axis=1, initial=0) * np.median(most) * width >= EXACT
            if not large.any():
                apart = most * np.abs(c).max(initial=0) * width >= EXACT
                best = np.full((len(qids), min(k, len(ids))), LEAST, np.int64), np.zeros((len(qids), min(k, len(ids))), np.int64)
                for part, find in ((apart, _slow_best), (~apart, tile_best)):
                    if part.any():
                        found = find(qids[part], q[part], ids, c, k)
                        for out, x in zip(best, found, strict=True):
                            out[part] = x
                return best
    if large.any():
        slow = _slow_best(qids, q, ids[large], c[large], k)
        return _merged(slow, tile_best(qids, q, ids[~large], c[~large], k), k) if not large.all() else slow
    places = np.arange(len(ids))
    key = _products(q, c) * TILE + (TILE - 1 - places)
    own_lo, own_hi = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
    for r in np.flatnonzero(own_hi > own_lo):
        key[r, own_lo[r] : own_hi[r]] = LEAST
    if len(ids) > k:
        at = np.argpartition(key, len(ids) - k, axis=1)[:, len(ids) - k :]
        key = np.take_along_axis(key, at, 1)
    score = key // TILE
    place = TILE - 1 - key % TILE
    return np.where(key == LEAST, LEAST, score), np.where(key == LEAST, 0, ids[np.clip(place, 0, len(ids) - 1)])


def _slow_best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As tile_best, with integers of any size."""
    scores, keys = np.full((len(qids), min(k, len(ids))), LEAST, np.int64), np.zeros((len(qids), min(k, len(ids))), np.int64)
    for r, row in enumerate(_products(q, c)):
        best = sorted((-int(s), int(i)) for s, i in zip(row, ids, strict=True) if i != qids[r])[:k]
        if best and max(abs(s) for s, _ in best) >= 1 << 62:
            raise ValueError("a score is too large for a long")
        scores[r, : len(best)], keys[r, : len(best)] = [-s for s, _ in best], [i for _, i in best]
    return scores, keys


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _lists(qids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> dict[str, pa.Array]:
    live = best[0] != LEAST
    return {"query_id": pa.array(np.repeat(qids, live.sum(axis=1)), pa.int64()), "vec_id": pa.array(best[1][live], pa.int64()), "score": pa.array(best[0][live], pa.int64())}


def _streamed(qids: np.ndarray, q: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The top lists of queries over parts of rows, in tiles."""
    best = np.full((len(qids), 0), LEAST), np.zeros((len(qids), 0), np.int64)
    for ids, c in parts:
        for i in range(0, len(ids), TILE):
            best = _merged(best, tile_best(qids, q, ids[i : i + TILE], c[i : i + TILE], k), k)
    return best


def _queries(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One vector a key: the smallest, if a key repeats."""
    width = max((m.shape[1] for _, m in parts), default=0)
    keys, q = np.concatenate([x for x, _ in parts]), np.concatenate([_padded(m, width) for _, m in parts])
    order = np.lexsort((*q.T[::-1], keys)) if len(keys) else np.zeros(0, np.int64)
    keys, at = np.unique(keys[order], return_index=True)
    return keys, q[order][at]


def _search(block, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = block.value
        found = _lists(qids, _streamed(qids, q, (_matrix(b, scale) for b in batches), k))
        yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return run


def _cell(k: int, scale: float):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qids, q = _queries([_matrix(b, scale) for b in queries.to_batches()]) if len(queries) else (np.zeros(0, np.int64), np.zeros((0, 0)))
        found = _lists(qids, _streamed(qids, q, (_matrix(b, scale) for b in rows.to_batches()) if len(qids) else iter(()), k))
        shard = rows.column("shard")[0].as_py() if len(rows) else 0
        return pa.table(found | {"part": pa.array(np.full(len(found["score"]), shard % FAN), pa.int32())})

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product of each query row."""
    spark = rows.sparkSession
    prepare(spark)
    of = [F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")]
    all_rows, queries = rows.select(*of), rows.where(is_query).select(*of).where("key is not null and vector is not null")
    n = queries.count()
    if n <= BLOCK:
        found = queries.toArrow().combine_chunks()  # at most BLOCK rows
        block = spark.sparkContext.broadcast(_queries([_matrix(b, scale) for b in found.to_batches() or [pa.RecordBatch.from_pylist([], schema=found.schema)]]))
        lists = all_rows.mapInArrow(_search(block, k, scale), LISTS).withColumn("part", F.spark_partition_id() % FAN)
    else:
        blocks, shards = -(-n // BLOCK), -(-all_rows.count() // SHARD)
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        of_block = queries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
        of_shard = all_rows.withColumn("shard", F.pmod(F.xxhash64("key", "vector"), F.lit(shards)).cast("int")).withColumn("block", each(blocks))
        lists = of_block.groupBy("block", "shard").cogroup(of_shard.groupBy("block", "shard")).applyInArrow(_cell(k, scale), LISTS + ", part int")
    order = [F.col("score").desc(), F.col("vec_id")]
    first = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("r") <= k)
    last = first.drop("r").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("query_id", "rank", "vec_id", "score")
