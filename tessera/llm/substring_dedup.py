"""Substring dedup by super-k-mers: removes every word of a window of words that also starts elsewhere.

Words are maximal runs without white space. Consecutive windows of `length` words that share their minimiser
(the least hash of `k` consecutive words) form a super-k-mer and travel as one packed string to the
minimiser's bucket, where sorting counts the windows exactly. Before any string travels, minimisers are
counted by their hash alone: a window whose minimiser occurs once in the corpus can't repeat.

Defined results: a null or empty text has no words and keeps nothing; a text of fewer than `length` words has no window
and is kept; equal texts lose all windows in every copy, so do repeated rows; a doc_id may be null or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stretches, byte_values, chunks, columns_of, discard, lists, minimisers, prepare, raw, rows_of, runs_of, signed, words_in, written
from tessera.llm.spans import PACKED, counted, covered, exact_bucket, salted, with_runs, word_windows

#: The longest run of windows in one packed string.
RUN = 128
#: Rows of one bucket that one task counts; more are dealt to several salts.
BUCKET_ROWS = 1000


def _super_kmers(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = length - k + 1
        for b in batches:
            data, offsets = raw(b.column("text"))
            ids = b.column("row").to_numpy()
            for lo, hi in chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, doc = words_in(part, at)
                if len(starts) < length:
                    continue
                words = Stretches(byte_values(part)).hash(starts, ends)
                first = np.arange(len(words) - k + 1)
                grams = Stretches(words).hash(first, first + k)
                least, again = minimisers(grams, w)
                inside = doc[: len(least)] == doc[length - 1 :]
                at0 = np.flatnonzero(inside)
                if not len(at0):
                    continue
                h, d = grams[least[at0]], doc[at0]
                same = np.zeros(len(at0), bool)
                same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (at0[1:] == at0[:-1] + 1)
                begin, n = runs_of(same)
                twice = np.logical_or.reduceat(again[at0], begin) | (n > w)
                if n.max() > RUN:  # cut long runs
                    cut = np.zeros(len(at0), bool)
                    cut[begin] = True
                    cut[(np.arange(len(at0)) - np.repeat(begin, n)) % RUN == 0] = True
                    twice = np.repeat(twice, n)
                    begin, n = runs_of(~cut)
                    twice = twice[begin]
                base = np.searchsorted(doc, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h[begin])), pa.array(ids[lo + d[begin]]), pa.array((at0[begin] - base[d[begin]]).astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(twice.astype(np.int64) + 1),
                    ],
                    names=["key", "row", "start", "n", "weight"],
                )

    return run


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text").cast(pa.binary()).to_pylist(), b.column("row").to_pylist()
            spans = b.column("spans")
            cols, offsets = {f: lists(spans, f)[0] for f in ("key", "salt", "salts", "start", "n")}, lists(spans, "n")[1]
            packed = []
            for i, text in enumerate(texts):
                words = text.split()
                for j in range(offsets[i], offsets[i + 1]):
                    s = cols["start"][j]
                    packed.append(b" ".join(words[s : s + cols["n"][j] + length - 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols["key"], pa.int64()), pa.array(cols["salt"], pa.int32()), pa.array(cols["salts"], pa.int32()),
                    pa.array(np.repeat(np.asarray(ids, np.int64), np.diff(offsets))), pa.array(cols["start"], pa.int32()), pa.array(cols["n"], pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                names=["key", "salt", "salts", "row", "start", "n", "packed"],
            )

    return run


def _kept(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            (starts, offsets), (ns, _) = lists(b.column("runs"), "start"), lists(b.column("runs"), "n")
            total, removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                total.append(len(words))
                lo, hi = offsets[i], offsets[i + 1]
                if lo == hi:
                    removed.append(0)
                    kept.append(text if whole else b" ".join(words))
                    continue
                gone = covered(len(words), starts[lo:hi], ns[lo:hi], length)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["rest", "n_words", "n_removed", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, length: int = 35, k: int = 8, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Per document: doc_id, own (a struct of the columns named by carry), n_words, n_removed and the kept text.

    Kept words are joined by one space; with whole, a text that loses no word stays as it is.
    """
    prepare(docs.sparkSession)
    texts = rows_of(docs, key, text, carry)
    runs = written(texts.select("row", "text").mapInArrow(_super_kmers(length, k), "key long, row long, start int, n int, weight long"), "super-k-mers")
    again = runs.groupBy("key").agg(F.sum("weight").alias("rows")).where("rows > 1")
    spans = salted(runs.drop("weight").join(again, "key"), BUCKET_ROWS)
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("key", "salt", "salts", "start", "n")).alias("spans"))
    dealt = texts.repartition("row")  # the one exchange of texts, used twice
    packed = dealt.join(spans, "row").mapInArrow(_pack(length), PACKED)
    repeated = counted(packed, exact_bucket(word_windows(length)), "windows")
    discard(runs)
    found = with_runs(dealt, repeated)
    schema = columns_of(rest=dealt.schema["rest"].dataType, n_words="long", n_removed="long", kept="string")
    return found.mapInArrow(_kept(length, whole), schema).select("rest.*", "n_words", "n_removed", "kept")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], length: int = 35) -> dict[int, tuple[int, int, str]]:
    """What digest(substring_dedup()) says, straight from the definition; for tests."""
    words = {i: (t or "").encode().split() for i, t in rows}
    seen: dict[tuple, int] = {}
    for w in words.values():
        for j in range(len(w) - length + 1):
            x = tuple(w[j : j + length])
            seen[x] = seen.get(x, 0) + 1
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out
