"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, sharpened by exact n-gram counts, and a unigram base.

The model's P(token | context) has two parts. A maximum-entropy model gives P_me: a token's classes are the digits of its frequency rank, so that
P_me(token | context) is a product of softmaxes, one for each digit given those before it, each over sums of weight rows that hashed features select: the word before, the two before (n-grams), and
the one before the last (a skip). Tokens beyond the vocabulary share a rare class, within which each has its smoothed unigram share. Exact counts sharpen it where the corpus
has seen the context:
P = (c(context, token) + mu P') / (c(context) + mu), mu = a c(context) ** b, first for one token of context with P' = P_me, then for two with P' = the first; each sums to one for each context. Vocabulary, depth and slots follow the exact token counts of
all training documents (shape()). Training runs in ROUNDS slices; in each, one slice of the training
documents takes gradient steps in parallel, so that every training document is learnt from once; the tasks' updates are averaged in a tree.
Scoring works on sparse rows gathered into numpy batches.

Counts are gathered by blocks of documents (BLOCK_BYTES of text each, dealt by key and text): a block asks once for its
distinct tokens, bigrams and trigrams, whose hashes go, sorted and packed, to shards by hash range, which answer each block with the corpus counts in its order. No
task or broadcast holds all n-grams: shards grow in number with the corpus. Tokens are told apart by 64-bit hashes of their bytes and places, n-grams by as many bits as leave one false match in some 2 ** 12.

Defined results: a null or empty text is one end token; without training documents every token has probability one in the base and in
the model; equal texts score alike; a doc_id may be null or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, discard, mixed, prepare, raw, signed, word_hashes, words_in, written
from tessera.operators.selection import first_n

BLOCK_BYTES = 8 << 20
#: Children of a class, and the most slots and levels of a model, which bound what is sent to every executor (7 MB of weights, and 40 MB of words at the greatest depth).
SIDE, MOST_SLOTS, MOST_DEPTH = 20, 1 << 14, 5
#: By the size of n-grams, how much shorter contexts weigh against counts (a, b); n-grams of a shard.
PRIORS, SHARD = {2: (1.0, 0.8), 3: (0.5, 0.8)}, 1 << 22
#: Of n-grams that are counted.
SIZES = (1, *PRIORS)
ROUNDS, STEP, FAN = 8, 0.3, 16
TOKENS = 1 << 13
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shape(tokens: int, types: int) -> tuple[int, int]:
    """Words of the vocabulary and slots for so many training tokens of so many kinds."""
    return min(types, max(SIDE, round(types**0.6)), SIDE**MOST_DEPTH), min(MOST_SLOTS, 1 << max(10, tokens.bit_length() // 2 + 4))


class Tokens:
    """Of texts: each token's hash, its two predecessors, its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = np.where((data >= 65) & (data <= 90), data | 32, data)
        starts, ends, doc = words_in(low, offsets)
        n = len(offsets) - 1
        words = word_hashes(low, starts, ends)
        at = np.searchsorted(doc, np.arange(n), "right")
        self.token, self.doc = np.insert(words, at, END), np.insert(doc, at, np.arange(n))
        m = len(self.token)
        self.before, self.second = np.full(m, START), np.full(m, START)
        same = self.doc[1:] == self.doc[:-1]
        self.before[1:][same] = self.token[:-1][same]
        same = self.doc[2:] == self.doc[:-2]
        self.second[2:][same] = self.token[:-2][same]


class Model:
    """weights[l]: slot x child of the l-th digit's classes; bias[l]: class x child. vocabulary: sorted hashes; rank: of each.

    A token's l-th class is rank % SIDE ** l, its child there the next digit; at the top, child SIDE stands for all rare tokens.
    tokens, counts: the most frequent tokens; total: occurrences of all training tokens.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: float, words: int, slots: int):
        order = np.lexsort((tokens, -counts))[:words]
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        rank = np.arange(len(order))
        by_hash = np.argsort(tokens[order])
        self.vocabulary, self.rank = tokens[order][by_hash], rank[by_hash]
        share = counts[order] / max(total, 1.0)
        self.bias, self.weights = [], []
        while not self.bias or SIDE ** len(self.bias) < len(order):
            step = SIDE ** len(self.bias)
            mass = np.zeros((step, SIDE + (step == 1)))
            np.add.at(mass, (rank % step, rank // step % SIDE), share)
            if step == 1:
                mass[0, SIDE] = max(1e-6, 1 - share.sum())
            with np.errstate(divide="ignore", invalid="ignore"):
                bias = np.log(mass / mass.sum(axis=1, keepdims=True))
            self.bias.append(np.where(np.isnan(bias), 0, bias).astype(np.float32))  # a class without words
            self.weights.append(np.zeros((slots, mass.shape[1]), np.float32))

    def ranked(self, token: np.ndarray) -> np.ndarray:
        """Rank in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(token), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, token), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == token, self.rank[at], -1)

    @staticmethod
    def features(t: Tokens, lo: int, hi: int) -> list[np.ndarray]:
        a, b = t.before[lo:hi], t.second[lo:hi]
        return [a * np.uint64(0x9E3779B97F4A7C15), (a * np.uint64(3) + b) * np.uint64(0xC2B2AE3D27D4EB4F), (b + np.uint64(1)) * np.uint64(0x165667B19E3779F9)]

    def slots(self, feature: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        x = feature + np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.uint16)

    def forward(self, features: list[np.ndarray], rank: np.ndarray, all_children: bool = True):
        """Log-probabilities (natural; of the rare class only for rare tokens), and for each level, if asked for: slots of its rows, the child that each took, and probabilities of all."""
        out, levels = np.zeros(len(rank)), []
        for level, (weights, bias) in enumerate(zip(self.weights, self.bias, strict=True)):
            step = SIDE**level
            live = np.flatnonzero(rank >= 0) if level else np.arange(len(rank))
            at = rank[live]
            of = at % step
            child = np.where(at < 0, SIDE, at // step % SIDE)
            slots = [self.slots(np.take(f, live) if level else f, of + step) for f in features]
            z = np.take(weights, slots[0], axis=0)
            for s in slots[1:]:
                z += np.take(weights, s, axis=0)
            z += np.take(bias, of, axis=0) if level else bias
            taken, p, total = _softmax(z, child)
            out[live] += taken - np.log(total)
            if all_children:
                p /= total[:, None]
                levels.append((slots, child, p))
        return out, levels

    def gradients(self, features: list[np.ndarray], rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, slots, rows) of minus the log-likelihood's gradient; rows of one slot are summed, whichever features select it."""
        for level, (slots, child, p) in enumerate(self.forward(features, rank)[1]):
            n = len(p)
            if not n:
                continue
            p[np.arange(n), child] -= 1
            s = np.concatenate(slots)
            order = np.argsort(s, kind="stable")
            s = np.take(s, order)
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            yield level, s[first], _sums(p, np.take(np.tile(np.arange(n), len(slots)), order), first)

    def step(self, features: list[np.ndarray], rank: np.ndarray, sums: list[np.ndarray]) -> None:
        """One gradient step on a batch of tokens."""
        for level, s, g in self.gradients(features, rank):
            seen = np.take(sums[level], s, axis=0)
            seen += g * g
            _put(sums[level], s, seen)
            g *= STEP
            g /= np.sqrt(seen, out=seen)
            _put(self.weights[level], s, np.take(self.weights[level], s, axis=0) - g)


def _softmax(z: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's z of its child, and exponentials and their sums, of z less its row's greatest where they would leave the range of numbers."""
    at = np.arange(len(z)), child
    taken, ones = z[at], np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        p = np.exp(z)
    total = p @ ones
    if len(z) and not (total.min() > 1e-20 and total.max() < 1e30):
        z -= z.max(axis=1, keepdims=True)
        taken, p = z[at], np.exp(z)
        total = p @ ones
    return taken, p, total


#: Places of a run that are added side by side for all runs; what a longer one has beyond them is added by itself.
SIDE_BY_SIDE = 24


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows[order] that begin at first: the k-th rows of all runs that have one are added at once (reduceat takes several times as long)."""
    n = np.diff(np.append(first, len(order)))
    out = np.take(rows, np.take(order, first), axis=0)
    many = np.flatnonzero(n > 1)
    many = many[np.argsort((SIDE_BY_SIDE + 1 - np.minimum(n[many], SIDE_BY_SIDE + 1)).astype(np.uint8), kind="stable")]  # the longest come first
    begin, left = first[many], np.searchsorted(-np.minimum(n[many], SIDE_BY_SIDE + 1), -np.arange(1, SIDE_BY_SIDE + 1), "left")  # left[k - 1]: runs of more than k rows
    sums = np.take(out, many, axis=0)
    for k, m in enumerate(left[:-1].tolist(), 1):
        if not m:
            break
        sums[:m] += np.take(rows, np.take(order, begin[:m] + k), axis=0)
    for i in range(left[-1]):
        rest = np.take(rows, order[begin[i] + SIDE_BY_SIDE : begin[i] + n[many[i]]], axis=0)
        sums[i] += np.ones(len(rest), rest.dtype) @ rest
    _put(out, many, sums)
    return out


def _put(rows: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
    """rows[at] = new, each row moved as one item."""
    whole = np.dtype((np.void, rows.itemsize * rows.shape[1]))
    rows.view(whole)[at, 0] = new.view(whole)[:, 0]


def _gradients(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        before = [w.copy() for w in model.weights]
        sums, n = [np.full(w.shape, 1.0, np.float32) for w in before], 0
        for b in batches:
            data, offsets = raw(b.column("text"))
            for lo, hi in chunks(offsets):
                t = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                distinct, at = np.unique(t.token, return_inverse=True)
                rank = model.ranked(distinct)[at]
                for i in range(0, len(rank), TOKENS):
                    model.step(model.features(t, i, min(i + TOKENS, len(rank))), rank[i : i + TOKENS], sums)
                n += len(rank)
        change = [(a - b).astype(np.float16) for a, b in zip(model.weights, before, strict=True)]
        model.weights = before  # a worker may see this object again
        if n:
            yield pa.RecordBatch.from_pydict({"tokens": [n], "change": [b"".join(c.tobytes() for c in change)]})

    return run


def _mean(changes: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens of all, and their mean change, weighted by tokens."""
    n = sum(m for m, _ in changes)
    return n, sum(np.float32(m / n) * np.frombuffer(x, np.float16).astype(np.float32) for m, x in changes)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    for b in batches:
        held += zip(b.column("tokens").to_pylist(), b.column("change").to_pylist(), strict=True)
        if len(held) > 1:
            n, change = _mean(held)
            held = [(n, change.astype(np.float16).tobytes())]
    if held:
        yield pa.RecordBatch.from_pydict({"tokens": [held[0][0]], "change": [held[0][1]]})


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """A model from the training rows (doc_id, text) and the counts (token, count) of all their tokens."""
    spark = texts.sparkSession
    totals = counts.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    words, slots = shape(*totals)
    seen = counts.where("count > 0")
    most = first_n(seen, [-F.col("count"), F.col("token")], words, ["token"]).select("token", "count").toArrow()  # a model's vocabulary, which an exact selection finds
    tokens = most.column("token").to_numpy().view(np.uint64)
    model = Model(tokens, most.column("count").to_numpy().astype(float), float(totals[0]), words, slots)
    for i in range(ROUNDS if len(tokens) else 0):
        sent = spark.sparkContext.broadcast(model)
        part = texts.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("slice")), F.lit(ROUNDS)) == i).select("text")
        changes = part.mapInArrow(_gradients(sent), "tokens long, change binary")
        tasks = changes.rdd.getNumPartitions()
        while tasks > 1:
            tasks = -(-tasks // FAN)
            changes = changes.repartition(tasks).mapInArrow(_added, "tokens long, change binary")
        changes = written(changes, "change")
        found = changes.collect()  # one row of a fixed size
        discard(changes)
        if found:
            _, change = _mean([(r.tokens, r.change) for r in found])
            for w in model.weights:
                w += change[: w.size].reshape(w.shape)
                change = change[w.size :]
        sent.destroy()
    return model


def packed(x: np.ndarray) -> bytes:
    """Numbers whose upper bytes are mostly alike, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(b: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    cells = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(cells.reshape(size, n).T).reshape(-1).view(kind)


def grams(t: Tokens, size: int, bits: int) -> np.ndarray:
    """Hashes of the n-grams that end with each token; of one token, its own, whatever bits are asked for."""
    if size == 1:
        return t.token
    x = mixed(t.before * np.uint64(0xA24BAED4963EE407) + t.token)
    return (x if size == 2 else mixed(x + t.second * np.uint64(0x9FB21C651E98DF25))) >> np.uint64(64 - bits)


def _cuts(sorted_: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where shards begin among sorted n-grams."""
    return np.append(np.searchsorted(sorted_, np.array([(i << bits) // shards for i in range(shards)], np.uint64)), len(sorted_))


ASKED = "block long, gram int, shard int, size int, keys binary, counts binary"


def _asked(bits: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        """By size and shard, a block's distinct n-grams and how often its training texts hold each."""
        data, offsets = raw(table.column("text"))
        trains = table.column("train").to_numpy().astype(bool)
        keys, of_key, rows = {k: [] for k in SIZES}, [], []
        for lo, hi in chunks(offsets):
            t = Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            of_key.append(trains[lo:hi][t.doc])
            for k, held in keys.items():
                held.append(grams(t, k, bits))
        learns = np.concatenate(of_key)
        for k in SIZES:
            each, times = _times(np.concatenate(keys.pop(k)), learns)
            cuts = _cuts(each, bits if k > 1 else 64, shards).tolist()
            rows += [(k, i, hi - lo, packed(np.diff(each[lo:hi], prepend=np.uint64(0))), packed(times[lo:hi])) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        out = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["gram", "shard", "size", "keys", "counts"])
        return out.add_column(0, "block", [np.full(len(out), table.column("block")[0].as_py())])

    return run


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Whether a number differs from the one before it."""
    out = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=out[1:])
    return out


def _times(keys: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how many of each learn. (Two sorts of numbers take a third of the time of one that keeps their places.)"""
    learnt = np.sort(keys[learns])
    first = np.flatnonzero(_starts(learnt))
    keys.sort()
    each = keys[_starts(keys)]
    times = np.zeros(len(each), np.uint32)
    times[np.searchsorted(each, learnt[first])] = np.diff(np.append(first, len(learnt)))
    return each, times


def _distinct(keys: np.ndarray):
    """Distinct keys, sorted, and a function that deals values of theirs to all keys."""
    order = np.argsort(keys)
    sorted_ = np.take(keys, order)
    starts = _starts(sorted_)
    n = np.diff(np.append(np.flatnonzero(starts), len(keys)))

    def dealt(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), values.dtype)
        out[order] = np.repeat(values, n)
        return out

    return sorted_[starts], dealt


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's distinct n-grams, their corpus counts, and which of them each n-gram of its blocks is."""
    sizes = table.column("size").to_pylist()
    keys = np.concatenate([np.cumsum(unpacked(x.as_py(), n, np.uint64), dtype=np.uint64) for x, n in zip(table.column("keys"), sizes, strict=True)])
    own = np.concatenate([unpacked(x.as_py(), n, np.uint32) for x, n in zip(table.column("counts"), sizes, strict=True)])
    each, at = np.unique(keys, return_inverse=True)
    return each, np.bincount(at, own).astype(np.uint64), at


def _counted(table: pa.Table) -> pa.Table:
    """A shard's tokens and their corpus counts."""
    tokens, counts, _ = _totals(table)
    return pa.table({"token": signed(tokens), "count": signed(counts)})


def _answered(table: pa.Table) -> pa.Table:
    """A shard's answer to each block: the corpus counts of its n-grams, in the block's order."""
    _, counts, at = _totals(table)
    total, sizes = counts[at], table.column("size").to_pylist()
    ends = np.cumsum(sizes).tolist()
    return pa.table({"block": table.column("block"), "gram": table.column("gram"), "shard": table.column("shard"), "size": table.column("size"), "counts": pa.array([packed(total[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def _scored(sent, bits: int, train_tokens: int, rare: float):
    """rare: what a rare token's count, plus one half, is divided by to give its share of the rare class."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model = sent.value
        data, offsets = raw(texts.column("text"))
        n = len(offsets) - 1
        parts = [(lo, hi, Tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in chunks(offsets)]
        of_gram = {}
        for k in SIZES:
            told = answers.filter(pc.equal(answers.column("gram"), k)).sort_by("shard")
            times = np.concatenate([unpacked(x.as_py(), m.as_py(), np.uint64) for x, m in zip(told.column("counts"), told.column("size"), strict=True)]).astype(np.int64)
            each, dealt = _distinct(np.concatenate([grams(t, k, bits) for *_, t in parts]))
            of_gram[k] = dealt(times)
            if k == 1:
                ranks, ends = dealt(model.ranked(each).astype(np.int32)), times[np.searchsorted(each, END)]
        out, begin = {k: np.zeros(n, np.int64) for k in ("n_tokens", "n_known")} | {k: np.zeros(n) for k in ("base", "model")}, 0
        for lo, hi, t in parts:
            here = slice(begin, begin + len(t.token))
            c, rank, m = of_gram[1][here], ranks[here], hi - lo
            logs = np.log10(c + 0.5)
            p = np.zeros(len(rank))
            if len(model.vocabulary):
                for i in range(0, len(rank), TOKENS):
                    p[i : i + TOKENS] = model.forward(model.features(t, i, min(i + TOKENS, len(rank))), rank[i : i + TOKENS], False)[0]
            p = np.exp(p) * np.where(rank < 0, (c + 0.5) / rare, 1)
            shorter, begins = c, np.append(True, t.doc[1:] != t.doc[:-1])
            for k, (a, b) in PRIORS.items():
                context = np.where(begins, ends, np.append(0, shorter[:-1]))  # a context is the shorter n-gram that ends with the token before
                mu = a * np.maximum(context, 1.0) ** b
                shorter = of_gram[k][here]
                p = (shorter + mu * p) / (context + mu)
            begin += len(c)
            for k, x in (("n_tokens", None), ("n_known", c > 0), ("base", logs), ("model", np.log10(p))):
                out[k][lo:hi] = np.bincount(t.doc, x, m)
        train = np.full(n, train_tokens)
        return pa.table({"doc_id": texts.column("doc_id"), "train": texts.column("train"), "train_tokens": train, **{k: pa.array(v) for k, v in out.items()}})

    return run


def score(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; trains: which rows to learn from."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(trains, F.lit(False)).alias("train"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits, shards = -(-size // BLOCK_BYTES) or 1, min(64, max(32, size.bit_length() + 12)), -(-size // (4 * SHARD)) or 1  # a token has some five bytes
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")
    asked = written(blocked.groupBy("block").applyInArrow(_asked(bits, shards), ASKED), "asked")
    of_token = asked.where("gram = 1").select("shard", "size", "keys", "counts").repartition(shards, "shard")
    counts = written(of_token.groupBy("shard").applyInArrow(_counted, "token long, count long"), "counts")
    told = None
    for k in SIZES:
        of_gram = asked.where(F.col("gram") == k).select("block", "gram", "shard", "size", "keys", "counts").repartition(shards, "shard")
        part = written(of_gram.groupBy("shard").applyInArrow(_answered, "block long, gram int, shard int, size int, counts binary"), "grams")
        told = part if told is None else told.unionAll(part)
    discard(asked)
    model = train(texts.where("train").select("doc_id", "text"), counts)
    words = spark.createDataFrame(pa.table({"token": signed(model.vocabulary)})).withColumn("known", F.lit(1))
    rare, live = F.col("known").isNull(), F.col("count") > 0
    totals = counts.join(F.broadcast(words), "token", "left").agg(  # words: the vocabulary, of bounded size
        F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count_if(live).alias("types"), F.coalesce(F.sum(F.when(rare, F.col("count"))), F.lit(0)).alias("rare_tokens"), F.count_if(rare & live).alias("rare_types"),
    ).first()
    sent = spark.sparkContext.broadcast(model)
    schema = "doc_id long, train boolean, train_tokens long, n_tokens long, n_known long, base double, model double"
    run = _scored(sent, bits, totals.tokens, totals.rare_tokens + 0.5 * (totals.rare_types + 1))
    out = blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(totals.tokens + 0.5 * (totals.types + 1)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", base.alias("base_score"), F.col("model").alias("score"))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1
