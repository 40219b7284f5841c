"""Suffix-array dedup of bytes by prefix doubling: removes every byte of a `length`-byte string that also starts elsewhere.

Ranking all suffixes would shuffle many times the text. Each string of `length` bytes is represented by one of its places, its
minimiser: the least hash of `gram` bytes inside it. Equal strings have equal minimisers at equal places. From these places the ranks
grow by prefix doubling: Spark joins and recounts pairs of the ranks at a place and at an offset of
piece, 2 piece, ... bytes, and a place whose rank became unique goes, with all strings it represents. What is still shared at
`gram` bytes travels, as one packed run of strings, to the bucket of its rank, where ranks of pairs at offsets of `gram`, 2 `gram` ...
go up to `length`, equal ranks are sorted together, and neighbours are compared byte by byte.

Defined results: texts are UTF-8, null is empty and keeps nothing; a text of fewer than `length` bytes is kept; equal texts lose all
strings in every copy; overlapping matches in one document count; matches never cross documents; a doc_id may be null or repeat; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stretches, byte_values, chunks, columns_of, discard, lists, minimisers, mixed, prepare, raw, rows_of, runs_of, signed, written
from tessera.llm.spans import PACKED, Found, byte_windows, counted, covered, exact_bucket, salted, with_runs

RUN, BUCKET_ROWS = 400, 6000
#: Windows compared byte by byte at once.
COMPARE = 2048


def _places(length: int, gram: int, piece: int):
    """Runs of strings with one minimiser: the hashes of its pieces, document, first start, number, and 2 if it may occur in the run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = length - gram + 1
        for b in batches:
            data, offsets = raw(b.column("text"))
            ids = b.column("row").to_numpy()
            for lo, hi in chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                sizes = np.diff(at)
                if sizes.max(initial=0) < length:
                    continue
                sums = Stretches(byte_values(part))
                first = np.arange(len(part) - gram + 1)
                least, again = minimisers(sums.hash(first, first + gram), w)
                doc = np.repeat(np.arange(hi - lo), np.maximum(0, sizes - length + 1))
                at0 = np.arange(len(doc)) + (at[:-1] - (np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1)))[doc]
                place = least[at0]
                pieces = [signed(sums.hash(place + i, place + i + piece)) for i in range(0, gram, piece)]
                same = np.zeros(len(at0), bool)
                same[1:] = doc[1:] == doc[:-1]
                for h in pieces:
                    same[1:] &= h[1:] == h[:-1]
                begin, n = runs_of(same)
                twice = np.logical_or.reduceat(again[at0], begin) | (n > w)
                if n.max() > RUN:  # cut long runs
                    cut = (np.arange(len(at0)) - np.repeat(begin, n)) % RUN == 0
                    twice = np.repeat(twice, n)
                    begin, n = runs_of(~cut)
                    twice = twice[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(h[begin]) for h in pieces), pa.array(ids[lo + doc[begin]]), pa.array((at0[begin] - at[doc[begin]]).astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(twice.astype(np.int64) + 1),
                    ],
                    names=[*(f"p{i}" for i in range(len(pieces))), "row", "start", "n", "weight"],
                )

    return run


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(b.column("text"))
            spans = b.column("spans")
            cols, cuts = {f: lists(spans, f)[0] for f in ("key", "salt", "salts", "start", "n")}, lists(spans, "n")[1]
            each = np.diff(cuts)
            lo = np.repeat(offsets[:-1], each) + cols["start"]
            hi, whole = lo + cols["n"] + length - 1, data.tobytes()
            packed = [whole[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols["key"], pa.int64()), pa.array(cols["salt"], pa.int32()), pa.array(cols["salts"], pa.int32()),
                    pa.array(np.repeat(b.column("row").to_numpy(), each)), pa.array(cols["start"], pa.int32()), pa.array(cols["n"], pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                names=["key", "salt", "salts", "row", "start", "n", "packed"],
            )

    return run


def doubling_bucket(length: int, gram: int):
    """A bucket function of spans.counted: ranks by doubling from gram bytes on, then neighbours compared."""

    def bucket(rows: list[tuple], out: Found) -> None:
        where: dict[tuple[bytes, int, bool], list[tuple[int, int]]] = {}
        for doc, start, n, packed, salts in rows:
            where.setdefault((packed, n, salts > 1), []).append((doc, start))
        places = list(where.values())
        n = np.array([k[1] for k in where])
        data = np.frombuffer(b"".join(k[0] for k in where), np.uint8)
        base = np.append(0, np.cumsum([len(k[0]) for k in where]))[:-1]
        which = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        at = np.arange(len(which)) - first[which] + base[which]
        place = np.arange(len(data) - gram + 1)
        rank, size = Stretches(byte_values(data)).hash(place, place + gram), gram
        while size < length:  # pairs at growing offsets; the last offset makes it `length` bytes
            step = min(size, length - size)
            m = len(rank) - step
            rank = mixed(rank[:m] * np.uint64(0x9E3779B97F4A7C15) + mixed(rank[step:]))
            size += step
        rank = rank[at]
        order = np.argsort(rank, kind="stable")
        again = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
        a, b = at[order[again]], at[order[again + 1]]
        for i in range(0, len(a), COMPARE):
            cells = np.arange(length)
            if (data[a[i : i + COMPARE, None] + cells] != data[b[i : i + COMPARE, None] + cells]).any():
                return exact_bucket(byte_windows(length))(rows, out)  # two strings share a rank
        head = np.ones(len(order), bool)
        head[again + 1] = False
        group = np.cumsum(head) - 1
        copies = np.array([len(p) for p in places])
        times = np.bincount(group, copies[which[order]])
        flag = np.empty(len(order), bool)
        flag[order] = times[group] > 1
        several = np.array([k[2] for k in where])
        if several.any():
            heads = order[head]
            for g in np.flatnonzero(several[which[heads]]):
                i = heads[g]
                doc, start = places[which[i]][0]
                out.add(doc, start + int(i - first[which[i]]), 1, hashlib.blake2b(data[at[i] : at[i] + length].tobytes(), digest_size=16).digest(), int(times[g]))
        same = np.zeros(len(flag), bool)
        same[1:] = (flag[1:] == flag[:-1]) & (which[1:] == which[:-1])
        begin, size = runs_of(same)
        for i, m in zip(begin[flag[begin]].tolist(), size[flag[begin]].tolist(), strict=True):
            s = which[i]
            for doc, start in places[s]:
                out.add(doc, start + i - int(first[s]), m, None, 0)

    return bucket


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(b.column("text"))
            (starts, cuts), (ns, _) = lists(b.column("runs"), "start"), lists(b.column("runs"), "n")
            removed, spans, kept = [], [], []
            for i in range(len(offsets) - 1):
                text, lo, hi = data[offsets[i] : offsets[i + 1]], cuts[i], cuts[i + 1]
                if lo == hi:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text.tobytes())
                    continue
                gone = covered(len(text), starts[lo:hi], ns[lo:hi], length)
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["rest", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 64, piece: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes. gram: piece times a power of 2."""
    prepare(docs.sparkSession)
    texts = rows_of(docs, key, text)
    parts = [f"p{i}" for i in range(gram // piece)]
    rows = texts.select("row", "text").mapInArrow(_places(length, gram, piece), ", ".join(f"{p} long" for p in parts) + ", row long, start int, n int, weight long")
    rows = written(rows, "places")
    while len(parts) > 1:  # ranks of pairs at growing offsets: each rank now covers twice as many bytes
        pairs = [F.xxhash64(parts[i], parts[i + 1]).alias(f"p{i // 2}") for i in range(0, len(parts), 2)]
        parts = parts[: len(parts) // 2]
        ranked = rows.select(*pairs, "row", "start", "n", "weight")
        shared = ranked.groupBy("p0").agg(F.sum("weight").alias("rows")).where("rows > 1")
        kept = written(ranked.join(shared, "p0") if len(parts) == 1 else ranked.join(shared.select("p0"), "p0", "left_semi"), "ranks")
        discard(rows)
        rows = kept
    spans = salted(rows.select(F.col("p0").alias("key"), "row", "start", "n", "rows"), BUCKET_ROWS)
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("key", "salt", "salts", "start", "n")).alias("spans"))
    dealt = texts.repartition("row")  # the one exchange of texts, used twice
    packed = dealt.join(spans, "row").mapInArrow(_pack(length), PACKED)
    runs = counted(packed, doubling_bucket(length, gram), "strings")
    discard(rows)
    found = with_runs(dealt, runs)
    schema = columns_of(rest=dealt.schema["rest"].dataType, n_bytes="long", n_removed="long", n_spans="long", kept="binary")
    return found.mapInArrow(_kept(length), schema).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place of every text, ranked by the eight bytes that begin there."""
    for b in batches:
        data, offsets = raw(b.column("text"))
        ids = b.column("row").to_numpy()
        for lo, hi in chunks(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            n = np.maximum(0, np.diff(at) - 7)
            if not n.sum():
                continue
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = place + np.repeat(at[:-1], n)
            rank = np.zeros(len(place), np.uint64)
            for i in range(8):
                rank = rank << np.uint64(8) | part[begin + i].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], n)), pa.array(place.astype(np.int32)), pa.array(signed(rank))], names=["row", "pos", "rank"])


def prefix_doubling(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", sizes: list[int] | None = None) -> DataFrame:
    """(row, pos) of every place where a repeated string of `length` bytes starts, by prefix doubling over all places.

    Each round pairs the rank of a place with that at the growing offset, reranks the pairs, and drops places whose rank became unique; a
    place whose partner was dropped is unique too. Its tables are many times the text (README), which suffix_dedup() avoids by doubling
    minimiser places only; both find the same strings. sizes: gets the rows of each round.
    """
    prepare(docs.sparkSession)
    ranks = written(rows_of(docs, key, text).select("row", "text").mapInArrow(_first_ranks, "row long, pos int, rank long"), "doubling")
    size = 8
    while size < length:
        step = min(size, length - size)
        ahead = ranks.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, ["row", "pos"])
        shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next", F.xxhash64("rank", "next").alias("new"))
        new = written(pairs.join(shared, ["rank", "next"]).select("row", "pos", F.col("new").alias("rank")), "doubling")
        if sizes is not None:
            sizes.append(ranks.count())
        discard(ranks)
        ranks, size = new, size + step
    return ranks.select("row", "pos")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], length: int = 400) -> dict[int, tuple[int, int, int, str]]:
    """What digest(suffix_dedup()) says, straight from the definition; for tests."""
    texts = {i: (t or "").encode() for i, t in rows}
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for j in range(len(t) - length + 1):
            h = hashlib.blake2b(t[j : j + length], digest_size=16).digest()
            seen[h] = seen.get(h, 0) + 1
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[j : j + length], digest_size=16).digest()] > 1:
                gone[j : j + length] = True
        kept = bytes(x for x, g in zip(t, gone.tolist(), strict=True) if not g)
        out[i] = (len(t), int(gone.sum()), int(np.diff(np.append(0, gone.astype(int))).clip(0).sum()), hashlib.sha256(kept).hexdigest())
    return out
