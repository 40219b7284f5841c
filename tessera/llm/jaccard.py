"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least 4/5: SimHash tries, and an exact join for what they miss.

Fingerprints of the sets within a few bits meet in the tries of operator 7 (simhash). Each set is held against the first of its
group on the whole sets. No budget of bits finds all pairs of that similarity, so the rest is found by a prefix filter: in
any one order of all shingles, two sets x and y of that similarity share one of the first |x| - ceil(0.8 |x|) + 1 shingles
of x and of y. Only sets of different groups meet there, and none is left out; candidates are confirmed on the whole sets. The order is that of the
hashes, with common shingles last, the most common at the very end: which are common is estimated from a fixed share of the rows, so that the
threshold does not rise with the table, and changes the work but not the result.
Equal sets are one. In each of ROUNDS, all sets that share a shingle are compared with LEADERS of them only; at the end those that
are still in different groups are with each other.

Defined results: words are as in simhash; a null or empty text has no shingle, and all such texts are equal; fewer words than a shingle are one
shingle; shingles are told apart by 64-bit hashes; rows that are equal in key and text share a row number; rows without a doc_id are members like any other, and a group of such rows alone has no component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import chunks, discard, mixed, prepare, raw, row_of, sent_side, texts_of, word_hashes, words_in, written
from tessera.llm.components import components
from tessera.operators.selection import first_n

#: The sample, a share of the rows and so many at least; in how many of its texts a common shingle is; and the most shingles that are told to be common, which bounds what is sent.
SHARE, SAMPLE_ROWS, COMMON, MOST_COMMON = 1 / 8, 4000, 3, 1 << 20
#: Rounds with so many leading sets of each shingle before all pairs that are left.
ROUNDS, LEADERS = 2, 4
#: Words of 64 bits in a sketch: bit i is the parity of the set's shingles that fall on i, so that as many bits as differ, shingles differ at least.
#: Sets of over LONG shingles have a wide one too.
SKETCH, WIDE, LONG = 16, 256, 800
_P, _SEED = np.uint64(0x9E3779B97F4A7C55), np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = raw(col)
    for lo, hi in chunks(offsets):
        part, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        low = np.where((part >= 65) & (part <= 90), part | 32, part)
        starts, ends, doc = words_in(low, cut)
        words = word_hashes(low, starts, ends)
        edge = np.searchsorted(doc, np.arange(hi - lo + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n = max(1, b - a - size + 1) if b > a else 0
            sums = np.full(n, _SEED)
            for j in range(min(size, b - a)):
                sums = sums * _P + words[a + j : a + j + n]
            yield np.unique(mixed(sums))


def _digest(tokens: np.ndarray) -> int:
    return int(mixed(np.append(mixed(tokens + _SEED), np.uint64(len(tokens))).sum(keepdims=True)).view(np.int64)[0])


def _sketch(tokens: np.ndarray, words: int) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(each: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in each])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)))


def _prefixes(size: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = sent.value
        for b in batches:
            sets, sizes, prints, parts, sketches, wide = [], [], [], [], [], []
            for tokens in shingle_sets(b.column("text"), size):
                n = len(tokens)
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    often = common[at] == tokens
                    tokens_ = np.concatenate([tokens[~often], tokens[often][np.argsort(times[at[often]], kind="stable")]])
                else:
                    tokens_ = tokens
                sets.append(_digest(tokens))
                sizes.append(n)
                prints.append(simhash.majority(tokens))
                sketches.append(_sketch(tokens, SKETCH))
                wide.append(_sketch(tokens, WIDE) if n > LONG else np.zeros(0, np.uint64))
                parts.append(tokens_[: n - -(-4 * n // 5) + 1])
            of_rows = [
                b.column("doc_id"), b.column("row"), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(np.array(prints, np.uint64).view(np.int64)), *map(_lists, (parts, sketches, wide)),
            ]
            yield pa.RecordBatch.from_arrays(of_rows, names=["doc_id", "row", "set", "n", "print", "prefix", "sketch", "wide"])

    return run


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = list(shingle_sets(b.column("text"), size))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in each], pa.int64()), _lists(each)], names=["set", "tokens"])

    return run


def _apart(entries: DataFrame, turn: int) -> DataFrame:
    """Entries of shingles that sets of several groups hold, and whether each leads: LEADERS of a shingle do each turn, first those in which the fewest shingles come before it, which have the least of their own."""
    w = Window.partitionBy("token")
    ranked = entries.select("*", F.row_number().over(w.orderBy("pos", "set")).alias("_r"), F.min("group").over(w).alias("_a"), F.max("group").over(w).alias("_b")).where("_a <> _b")
    return ranked.withColumn("leads", F.col("_r").between(turn * LEADERS + 1, (turn + 1) * LEADERS)).drop("_r", "_a", "_b")


def _by_sketch(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches allow the similarity."""
    for c in ("sketch", "wide"):
        u, v = (sketches.select(F.col("set").alias(k), F.col("n").alias(f"n_{k}"), F.col(c).alias(f"of_{k}")) for k in "uv")
        differ = F.aggregate(F.zip_with("of_u", "of_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))  # 0 if either set has none
        pairs = pairs.join(u, "u").join(v, "v").where(9 * differ <= F.col("n_u") + F.col("n_v")).select("u", "v")
    return pairs


def _candidates(entries: DataFrame, others: DataFrame, sketches: DataFrame, which: str) -> DataFrame:
    """Distinct pairs (u, v), u < v, that which allows, and whose sizes, places of a shared shingle and sketches allow the similarity."""
    entries = entries.drop("leads")
    other = others.select("token", *(F.col(c).alias(f"{c}_") for c in entries.columns if c != "token"))
    rest = F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_"))
    near = (5 * F.col("n") >= 4 * F.col("n_")) & (5 * F.col("n_") >= 4 * F.col("n")) & (9 * rest >= 4 * (F.col("n") + F.col("n_")))
    return _by_sketch(entries.join(other, "token").where(F.expr(which) & near).select(F.least("set", "set_").alias("u"), F.greatest("set", "set_").alias("v")).distinct(), sketches)


def _confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (u, v) of sets with a similarity of 4/5 or more, from the whole sets; texts: of all rows."""
    pairs = written(pairs, "pairs")
    used = written(pairs.select(F.explode(F.array("u", "v")).alias("set")).distinct().join(sets.select("set", "row"), "set").select("row"), "used")
    whole = written(texts.join(sent_side(used), "row", "left_semi").dropDuplicates(["row"]).select("text").mapInArrow(_tokens(size), "set long, tokens array<long>"), "sets")
    u, v = (whole.select(F.col("set").alias(k), F.col("tokens").alias(f"of_{k}")) for k in "uv")
    shared = F.size(F.array_intersect("of_u", "of_v"))
    links = written(pairs.join(u, "u").join(v, "v").where(9 * shared >= 4 * (F.size("of_u") + F.size("of_v"))).select("u", "v"), "links")
    discard(pairs, used, whole)
    return links


def near_groups(docs: DataFrame, size: int = 5, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, component, component_id); component: one long a group over pairs of similarity 4/5 or more; component_id: its smallest doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    texts = texts_of(docs, key, text).select("doc_id", row_of(F.col("doc_id"), F.col("text")).alias("row"), "text")
    share = min(1.0, max(SHARE, SAMPLE_ROWS / max(docs.count(), 1)))
    some = texts.where(F.pmod("row", F.lit(1 << 20)) < int(share * (1 << 20))).select("text").mapInArrow(_tokens(size), "set long, tokens array<long>")
    often = written(some.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") >= COMMON), "common")
    most = first_n(often, [-F.col("times"), F.col("token")], MOST_COMMON, ["token"]).select("token", "times").toArrow()  # at most MOST_COMMON rows
    discard(often)
    common, times = most.column("token").to_numpy().view(np.uint64), most.column("times").to_numpy()
    order = np.argsort(common)
    sent = spark.sparkContext.broadcast((common[order], np.minimum(times[order], (1 << 31) - 1).astype(np.int32)))
    rows = written(texts.mapInArrow(_prefixes(size, sent), "doc_id long, row long, set long, n long, print long, prefix array<long>, sketch array<long>, wide array<long>"), "shingles")
    members = written(rows.select("doc_id", "row", "set"), "members")
    sets = written(rows.groupBy("set").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "print", "prefix", "sketch", "wide"))), "distinct")
    discard(rows)
    sketches = sets.select("set", "n", "sketch", "wide")

    # what the tries of fingerprints link: each set with the first of its group
    tries = simhash.near_groups(sets.select(F.col("set").alias("doc_id"), "print"), bits).where("doc_id <> component_id")
    links = _confirmed(_by_sketch(tries.select(F.least("doc_id", "component_id").alias("u"), F.greatest("doc_id", "component_id").alias("v")), sketches), sets, texts, size)
    groups = written(components(links).withColumnRenamed("node", "set"), "groups")

    # the rest: sets of different groups that share a shingle of their prefixes, first with a few sets of each shingle, other ones each round
    known = sets.select("set", "n", "prefix").join(sent_side(groups), "set", "left")
    entries = known.select(
        "set", F.coalesce("component", "set").alias("group"), "n", F.posexplode("prefix").alias("pos", "token"),
    ).select("token", "set", "group", F.col("n").cast("int").alias("n"), "pos")
    live = written(_apart(entries, 0), "candidates")
    for i in range(1, ROUNDS + 1):
        found = _confirmed(_candidates(live, live.where("leads"), sketches, "group <> group_"), sets, texts, size)
        links = written(links.unionAll(found), "links")
        groups = written(components(links).withColumnRenamed("node", "set"), "groups")
        named = live.drop("group", "leads").join(sent_side(groups), "set", "left").select("token", "set", F.coalesce("component", "set").alias("group"), "n", "pos")
        left = written(_apart(named, i), "candidates")
        discard(live)
        live = left
    links = links.unionAll(_confirmed(_candidates(live, live, sketches, "set < set_ and group <> group_"), sets, texts, size))
    discard(live)
    groups = components(links).withColumnRenamed("node", "set")
    joined = written(sets.select("set", "rep").join(groups, "set", "left").select("set", "rep", F.coalesce("component", "set").alias("component")), "joined")
    discard(sets)
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return members.join(joined.join(least, "component").select("set", "component", "component_id"), "set").select("doc_id", "row", "component", "component_id")


def brute(rows: list[tuple[int, str | None]], size: int = 5) -> dict[int, int]:
    """The component_id of each key, from all pairs; for tests."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                n = len(sets[a] & sets[b])
                if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
