"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints within `bits` differing bits share one of bits + 1 blocks. Each distinct fingerprint is rotated so that
every block leads once; those with one leading block form the trie below that block, where node pairs are traversed
together, differing bits add up, and a pair is pruned once they exceed the budget, or when both
nodes are already in one group. A bucket returns a spanning forest and not its pairs. Crowded buckets are split by a second
block of what is left.

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle are one shingle;
equal texts and repeated rows share a fingerprint; rows without a doc_id count for links only (a group of such rows alone has no component_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, texts_of, written
from tessera.llm.components import components

#: Shingles whose bits are counted at once.
SHINGLES = 1 << 15
#: Node pairs that are expanded at once, and rows of whole buckets that are joined at once.
PAIRS, ROWS = 1 << 18, 1 << 16
#: A bucket of more distinct fingerprints is split further.
CROWDED = 1 << 18


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space parts
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)] if len(words) >= size else [b" ".join(words)]
    return majority(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES):
        part = hashes[i : i + SHINGLES].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, size) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint as a long."""
    prepare(docs.sparkSession)
    return texts_of(docs, key, text).mapInArrow(_fingerprints(size), "doc_id long, print long")


def _rooted(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root (of each item, itself a root) after joining the groups of u and v."""
    while True:
        a, b = root[u], root[v]
        if not (differ := a != b).any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (deeper := root[root]).tobytes() != root.tobytes():
            root = deeper


def trie_groups(values: np.ndarray, bounds: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Roots of the groups of values (uint64) that links of at most `bits` differing bits make within a bucket.

    bounds cut values into buckets whose values share their upper `depth` bits and are sorted. Nodes are ranges.
    """
    n = len(values)
    root = np.arange(n)
    sizes = np.diff(bounds)
    lo, hi = bounds[:-1][sizes > 1], bounds[1:][sizes > 1]
    zeros: dict[int, np.ndarray] = {}
    todo = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while todo:
        depth, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > PAIRS:
            todo += [(depth, *(x[i : i + PAIRS] for x in (alo, ahi, blo, bhi, err))) for i in range(0, len(alo), PAIRS)]
            continue
        change = np.zeros(n, np.int64)
        change[1:] = root[1:] != root[:-1]
        change = np.cumsum(change)
        one = (root[alo] == root[blo]) & (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo])
        if one.any():
            alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if depth == 64:
            leaf[:] = True
        if leaf.any():
            u, v = alo[leaf], blo[leaf]
            near = np.bitwise_count(values[u] ^ values[v]) <= bits
            root = _rooted(root, u[near], v[near])
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if depth not in zeros:
            zeros[depth] = np.append(0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1) == 0))
        z = zeros[depth]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        other = alo != blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), tuple(x[other] for x in (amid, ahi, blo, bmid, err + 1))]
        new = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= bits) & ~((new[0] == new[2]) & (new[1] - new[0] == 1))
        todo.append((depth + 1, *(x[live].astype(x.dtype) for x in new)))
    return root


def _links(bits: int, width: int):
    def joined(block: np.ndarray, value: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((value, block))
        block, value, rep = block[order], value[order], rep[order]
        top = value >> np.uint64(64 - width)
        cut = np.flatnonzero((block[1:] != block[:-1]) | (top[1:] != top[:-1])) + 1
        root = trie_groups(value, np.concatenate([[0], cut, [len(value)]]), width, bits)
        moved = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for b in batches:
            block, value, rep = (b.column(c).to_numpy() for c in ("block", "value", "print"))
            held.append((block, value.view(np.uint64), rep))
            rows += len(block)
            if rows < ROWS:
                continue
            block, value, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            top = value >> np.uint64(64 - width)
            last = (block == block[-1]) & (top == top[-1])  # the bucket that may go on
            if not last.all():
                yield joined(block[~last], value[~last], rep[~last])
            held = [(block[last], value[last], rep[last])]
            rows = int(last.sum()) if not last.all() else 0
        if held:
            yield joined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _joined(rows: DataFrame, bits: int, width: int) -> DataFrame:
    dealt = rows.repartition("block", "top").sortWithinPartitions("block", "top")
    return dealt.select("print", "block", "value").mapInArrow(_links(bits, width), "u long, v long")


def _split(rows: DataFrame, bits: int, width: int) -> DataFrame:
    """Rows of crowded buckets in narrower ones: what is left of the fingerprint has bits + 1 blocks again, one of which is shared too."""
    left = 64 - width
    part = left // (bits + 1)
    mask = (1 << left) - 1
    low = F.col("value").bitwiseAND(F.lit(mask))
    turned = lambda j: F.call_function("shiftleft", low, j * part).bitwiseOR(
        F.when(j == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", low, left - j * part))
    ).bitwiseAND(F.lit(mask))
    each = F.explode(
        F.transform(
            F.array(*map(F.lit, range(bits + 1))),
            lambda j: F.struct(
                (F.col("block") * (bits + 1) + j).alias("block"), F.call_function("shiftleft", F.col("top"), F.lit(left)).bitwiseOR(turned(j)).alias("value"),
            ),
        )
    )
    return rows.select("print", each.alias("x")).select("print", "x.block", "x.value").withColumn("top", F.call_function("shiftrightunsigned", F.col("value"), F.lit(64 - width - part)))


def near_groups(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(doc_id, print, component_id) from (doc_id, print); component_id: the smallest doc_id reachable over links."""
    width = 64 // (bits + 1)
    prints = written(prints, "prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("rep"))
    blocks = F.explode(F.transform(F.array(*map(F.lit, range(bits + 1))), lambda i: F.struct(
        i.alias("block"), F.call_function("shiftleft", F.col("print"), i * width).bitwiseOR(
            F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("print"), 64 - i * width))).alias("value"))))
    rotated = distinct.select("print", blocks.alias("x")).select("print", "x.block", "x.value").withColumn("top", F.call_function("shiftrightunsigned", F.col("value"), F.lit(64 - width)))
    crowded = rotated.groupBy("block", "top").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("block", "top")
    links = _joined(rotated.join(crowded, ["block", "top"], "left_anti"), bits, width).unionAll(
        _joined(_split(rotated.join(crowded, ["block", "top"]), bits, width), bits, width + (64 - width) // (bits + 1))
    )
    groups = components(links).withColumnRenamed("node", "print")
    joined = distinct.join(groups, "print", "left").select("print", "rep", F.coalesce("component", "print").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.join(joined.join(least, "component").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def brute(rows: list[tuple[int, str | None]], size: int = 3, bits: int = 3) -> dict[int, tuple[str, int]]:
    """What digest() says, from all pairs; for tests."""
    ids = sorted(i for i, _ in rows)
    prints = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        parts = [b" ".join(words[j : j + size]) for j in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
        prints[i] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}
