"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

A first pass counts documents, terms and, for each term of the queries, the documents that hold it. A second pass goes over the documents
in shards (consecutive documents of a task, SHARD_TERMS terms at most unless one document has more). A shard's postings, of the queries' terms only, hold the
score that each occurrence adds; a term's largest is its impact. For each query, cursors on its terms' postings stand in order of their documents; the pivot is the
first at which the impacts of the cursors so far can reach the worst score of a full heap, and no document before the pivot's is
scored: cursors skip to it by binary search. A task keeps its heaps from shard to shard, so that the bar only rises.

Queries go by blocks of BLOCK items, each block sent to all tasks of both passes. Of every task come at most k rows a query,
which are merged in two steps. Terms are told apart by 64-bit hashes of their bytes and places.

Defined results: a null, empty or wordless text is no document of the statistics and never listed; an item without terms, or whose terms are nowhere, has no rows;
items that are equal in id and text are one, items that share an id alone are ranked each; a doc_id may repeat (each row is ranked) or be null
(after all others of its score); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, prepare, raw, word_hashes, words_in, written

#: Items that are sent at once, and terms of a shard.
BLOCK, SHARD_TERMS = 4096, 1 << 20
#: Lists that one first merge takes.
FAN = 64
UPPER = 10**9
#: ASCII other than letters and digits parts terms.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LISTS = "query int, doc_id long, score long"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes, as those of a text's terms."""
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]) if len(ends) else ends, ends)


class Lookup:
    """Numbers of the terms that are asked for, by their 64-bit hashes."""

    def __init__(self, words: list[str]):
        h = hashes(words)
        order = np.argsort(h, kind="stable")
        if len(h) and (np.diff(h[order]) == 0).any():
            raise ValueError("two terms of the queries share a hash")
        self.hash, self.number = h[order], order

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.number[at], -1)


def _postings(data: np.ndarray, offsets: np.ndarray, lookup: Lookup) -> Iterator[tuple[np.ndarray, ...]]:
    """By chunks of texts: (terms of each text; then for each text and asked term that it holds, sorted by both: text, term, occurrences)."""
    for lo, hi in chunks(offsets, 1 << 20):
        part = data[offsets[lo] : offsets[hi]]
        low = np.where((part >= 65) & (part <= 90), part | 32, part)
        starts, ends, doc = words_in(low, offsets[lo : hi + 1] - offsets[lo], GAP)
        n = np.bincount(doc, minlength=hi - lo)
        term = lookup.find(word_hashes(low, starts, ends))
        hit = np.flatnonzero(term >= 0)
        kinds = max(1, len(lookup.hash))
        pairs, tf = np.unique(doc[hit] * kinds + term[hit], return_counts=True)
        text, term = pairs // kinds, pairs % kinds
        yield lo, n, text + lo, term, tf


def _counted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = sent.value
        documents, total, df = 0, 0, np.zeros(len(lookup.hash), np.int64)
        for b in batches:
            for _, n, _, term, _ in _postings(*raw(b.column("text")), lookup):
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
                df += np.bincount(term, minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(held, [-1, -2]).astype(np.int64), "n": np.append(df[held], [documents, total])})

    return run


class Shard:
    """Postings of a shard by term: places of documents in ascending order, what each adds for one occurrence of the term in a query, and the most that any adds."""

    def __init__(self, text: np.ndarray, term: np.ndarray, added: np.ndarray):
        order = np.argsort(term, kind="stable")
        text, added, term = text[order], added[order], term[order]
        numbers, first = np.unique(term, return_index=True)
        cuts = np.append(first, len(term)).tolist()
        self.of = {t: (text[a:b].tolist(), added[a:b].tolist(), int(added[a:b].max())) for t, a, b in zip(numbers.tolist(), cuts, cuts[1:], strict=False)}


def wand(shard: Shard, query: list[tuple[int, int]], ids: list[int], heap: list[tuple[int, int]], k: int) -> None:
    """Adds to the heap of (score, -id) what a shard has among the k best; query: (term, occurrences); ids: by place."""
    cursors = []
    for t, times in query:
        if t in shard.of:
            places, added, most = shard.of[t]
            cursors.append([places[0], 0, places, added, times, most * times])
    while cursors:
        cursors.sort(key=_place)
        if len(heap) == k:
            bar, reach, pivot = heap[0][0], 0, -1
            for c in cursors:
                reach += c[5]
                if reach >= bar:
                    pivot = c[0]
                    break
            if pivot < 0:
                return
        else:
            pivot = cursors[0][0]
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                score += c[3][c[1]] * c[4]
            if score > 0 and (len(heap) < k or (score, -ids[pivot]) > heap[0]):
                (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (score, -ids[pivot]))
            target = pivot + 1
        else:
            target = pivot
        spent = False
        for c in cursors:
            if c[0] >= target:
                break
            places = c[2]
            i = c[1] + 1
            if i < len(places) and places[i] < target:
                i = bisect_left(places, target, i)
            c[1] = i
            if i < len(places):
                c[0] = places[i]
            else:
                c[0], spent = -1, True
        if spent:
            cursors = [c for c in cursors if c[0] >= 0]


def _place(c: list) -> int:
    return c[0]


class Queries:
    """A block's queries (number, [(term, occurrences)]), and of each term its weight; m of a document of n terms is 25 + 75 n documents / total."""

    def __init__(self, lookup: Lookup, weights: np.ndarray, queries: list[tuple[int, list[tuple[int, int]]]], documents: int, total: int, k: int):
        self.lookup, self.weights, self.queries, self.documents, self.total, self.k = lookup, weights, queries, documents, total, k

    def added(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.documents) // self.total
        return self.weights[term] * ((UPPER * tf) // (1000 * tf + 8 * m))


def _searched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        heaps: list[list] = [[] for _ in q.queries]
        held: list[tuple] = []
        ids: list[int] = []
        size = 0

        def settle() -> None:
            nonlocal held, ids, size
            if held:
                shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for (_, query), heap in zip(q.queries, heaps, strict=True):
                    wand(shard, query, ids, heap, q.k)
            held, ids, size = [], [], 0

        for b in batches:
            keys = b.column("doc_id").fill_null(LAST).to_numpy()
            for lo, n, text, term, tf in _postings(*raw(b.column("text")), q.lookup):
                held.append((text - lo + len(ids), term, q.added(n[text - lo], term, tf)))
                ids += keys[lo : lo + len(n)].tolist()
                size += int(n.sum())
                if size >= SHARD_TERMS:
                    settle()
        settle()
        rows = [(number, -i, s) for (number, _), heap in zip(q.queries, heaps, strict=True) for s, i in heap]
        found = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(found, names=["query", "doc_id", "score"])

    return run


#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    items = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    blocks = -(-items.count() // BLOCK) or 1
    dealt = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "items")
    out, type_ = None, dealt.schema["item_id"].dataType.simpleString()
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_id", "text").collect()  # about BLOCK rows
        bags = [Counter(terms(r.text)) for r in rows]
        words = sorted(set().union(*bags)) if bags else []
        lookup = Lookup(words)
        counts = texts.select("text").mapInArrow(_counted(spark.sparkContext.broadcast(lookup)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r.term: r.n for r in counts.collect()}  # a row for each term of the block
        documents, total = df.get(-1, 0), df.get(-2, 0)
        number = {w: i for i, w in enumerate(words)}
        queries = [(i, [(number[w], c) for w, c in bag.items() if number[w] in df]) for i, bag in enumerate(bags)]
        weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(words))], np.int64)
        sent = spark.sparkContext.broadcast(Queries(lookup, weights, queries, documents, max(total, 1), k))
        lists = texts.mapInArrow(_searched(sent), LISTS).withColumn("part", F.spark_partition_id() % FAN)
        order = [F.col("score").desc(), F.col("doc_id")]
        first = lists.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k)
        best = first.drop("r").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"query int, item_id {type_}")
        best = best.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")  # names: about BLOCK rows
        out = best if out is None else out.unionAll(best)
    return out


def brute(docs: list[tuple[int | None, str | None]], items: list[tuple[int, str | None]], k: int = 10) -> list[tuple]:
    """What search() returns, straight from the definition; for tests."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // total
            s = sum(c * weight(n, df[w]) * ((UPPER * b[w]) // (1000 * b[w] + 8 * m)) for w, c in Counter(terms(text)).items() if w in b)
            if s > 0:
                found.append((-s, LAST if i is None else i))
        out += [(item, r + 1, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out
