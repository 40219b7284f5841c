"""Language ID of words in code-switched text: a linear-chain conditional random field, read by forward-backward.

A word's features are its byte n-grams, those that hold the space before or after it being its affixes, and
its entry in a lexicon of the training words. Transitions between the languages of neighbouring words are learned too, from
chains that join stretches of differently labelled documents. Forward-backward runs over all words of a text as one chain: in blocks of CHAIN words
side by side, between which the products of each block's transfer matrices carry the messages. A document's language is the one with the highest
mean marginal over its words with letters, which is its score.

The model is fitted on the driver on a bounded sample of labelled rows: about SAMPLE_ROWS rows in all, as many of each
language as there are, each with one stretch of SAMPLE_CHARS characters from a place given by the hash of key and text.
Prediction reads every whole text.

Defined results: `und` with score 0 for a null text, one without letters, or if nothing is labelled; equal texts get equal
answers; ties go to the language that sorts first; keys may be null or repeat; an empty table gives an empty result; other columns are ignored
or, on demand, handed through whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, Stretches, byte_values, chunks, columns_of, prepare, raw, words_in

SAMPLE_ROWS, SAMPLE_CHARS = 2000, 2000
#: Hashed weights; words of the lexicon; lengths of byte n-grams.
SLOTS, LEXICON, GRAMS = 1 << 18, 20_000, (1, 2, 3, 4)
#: Words of a training chain and of a block of a text; chains and rounds of training; step size; penalty.
CHAIN, CHAINS, EPOCHS, BATCH, STEP, PENALTY = 64, 3000, 4, 200, 0.3, 1e-5
LETTER = re.compile(r"[^\W\d_]")


class Features:
    """Of the words in a buffer of lower-case UTF-8 texts that each end in a space: n-gram slots by byte, words as ranges of bytes, lexicon slots."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.doc = words_in(data, offsets)
        text = np.full(len(data) + 8, 0x20, np.uint8)
        text[1 : len(data) + 1] = np.where(SPACE[data], 0x20, data)
        cells, n = text.astype(np.uint64), len(data) + 1
        self.slots, value = {}, np.zeros(n, np.uint64)
        for size in range(1, max(GRAMS) + 1):
            value = value | (cells[size - 1 : n + size - 1] << np.uint64(8 * (size - 1)))
            if size in GRAMS:
                h = (value + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)
                self.slots[size] = (h >> np.uint64(46)).astype(np.int64)
        self.words = Stretches(byte_values(data)).hash(self.starts, self.ends)
        letter = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
        total = np.append(0, np.cumsum(letter))
        self.letters = total[self.ends] > total[self.starts]

    def ranges(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in text, one byte on) of the n-grams that belong to each word, its spaces included."""
        if size == 1:
            return self.starts + 1, self.ends + 1
        return self.starts, np.maximum(self.starts, self.ends + 3 - size)


class Crf:
    """weights: slot x language; lexicon: sorted word hashes, with weights; moves: from x to."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights, self.entries = np.zeros((SLOTS, k), np.float32), np.zeros((len(lexicon) + 1, k), np.float32)
        self.moves, self.first = np.zeros((k, k)), np.zeros(k)

    def entry(self, f: Features) -> np.ndarray:
        """Each word's row of entries; the last row if it isn't in the lexicon."""
        if not len(self.lexicon):
            return np.zeros(len(f.words), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, f.words), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == f.words, at, len(self.lexicon))

    def emissions(self, f: Features) -> np.ndarray:
        out = self.entries[self.entry(f)].astype(np.float64)
        for size, slot in f.slots.items():
            total = np.zeros((len(slot) + 1, out.shape[1]))
            np.cumsum(self.weights[slot], axis=0, dtype=np.float64, out=total[1:])
            lo, hi = f.ranges(size)
            out += total[np.minimum(hi, len(slot))] - total[np.minimum(lo, len(slot))]
        out[~f.letters] = 0
        return out

    def marginals(self, e: np.ndarray, n: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of padded chains (chains x places x languages) of n words: word marginals, and summed ones of neighbours.

        start: the messages that reach the first words (default: those of a text's beginning); end: those that reach the last ones from behind.
        """
        s, t, k = e.shape
        e = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(self.moves)
        alpha, beta, scale = np.zeros((s, t, k)), np.ones((s, t, k)), np.ones((s, t))
        alpha[:, 0] = e[:, 0] * (np.exp(self.first) if start is None else start)
        for i in range(t):
            if i:
                alpha[:, i] = (alpha[:, i - 1] @ move) * e[:, i]
            scale[:, i] = alpha[:, i].sum(axis=1)
            alpha[:, i] /= scale[:, i, None]
        last = np.ones((s, k)) if end is None else end
        beta[:, t - 1] = last
        for i in range(t - 2, -1, -1):
            beta[:, i] = ((beta[:, i + 1] * e[:, i + 1]) @ move.T) / scale[:, i + 1, None]
            over = i + 1 >= n
            beta[over, i] = last[over]
        pair = np.zeros((k, k))
        for i in range(t - 1) if start is None else ():
            live = i + 1 < n
            if live.any():
                right = e[live, i + 1] * beta[live, i + 1] / scale[live, i + 1, None]
                pair += (alpha[live, i].T @ right) * move
        both = alpha * beta
        return both / both.sum(axis=2, keepdims=True), pair

    def transfers(self, e: np.ndarray, n: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of each padded block: the matrix from the language of the word before it to that of its last word, up to a factor.

        begins: blocks with which a text begins; what is before them does not matter.
        """
        s, t, k = e.shape
        e = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(self.moves)
        out = np.where(begins[:, None, None], np.exp(self.first), move) * e[:, 0, None]
        for i in range(1, t):
            longer = (out @ move) * e[:, i, None]
            longer /= longer.max(axis=(1, 2), keepdims=True)
            out = np.where((i < n)[:, None, None], longer, out)
        return out

    def messages(self, transfers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reaches the first and last word of each block from the blocks around it; text: of each block, in order."""
        s, k = len(text), len(self.languages)
        start, end, move = np.tile(np.exp(self.first), (s, 1)), np.ones((s, k)), np.exp(self.moves)
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        size = np.diff(np.append(first, s))
        last = first + size - 1
        ahead, back = np.full((len(first), k), 1 / k), np.ones((len(first), k))
        for j in range(1, int(size.max())):
            live = size > j
            first, last, size, ahead, back = first[live], last[live], size[live], ahead[live], back[live]
            ahead = np.einsum("bi,bij->bj", ahead, transfers[first + j - 1])
            ahead /= ahead.sum(axis=1, keepdims=True)
            start[first + j] = ahead @ move
            back = np.einsum("bij,bj->bi", transfers[last - j + 1], back)
            back /= back.sum(axis=1, keepdims=True)
            end[last - j] = back
        return start, end


def chains_of(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of blocks: up to CHAIN words of one document each."""
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    starts = np.flatnonzero(inside % CHAIN == 0)
    return starts, np.diff(np.append(starts, n))


def _padded(e: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains as rows; place: which word each cell holds (padding: the last word)."""
    place = starts[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
    out = e[place]
    out[np.arange(n.max()) >= n[:, None]] = 0
    return out, place


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Crf:
    """A field from (text, language) pairs."""
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in rows})
    of: dict[str, list[list[bytes]]] = {y: [] for y in languages}
    for t, y in rows:
        if w := t.lower().encode().split():
            of[y].append(w)
    languages = [y for y in languages if of[y]]
    if not languages:
        return Crf([], np.zeros(0, np.uint64))
    texts, labels = [], []
    for _ in range(CHAINS):
        words: list[bytes] = []
        while len(words) < CHAIN:
            y = int(rng.integers(len(languages)))
            w = of[languages[y]][int(rng.integers(len(of[languages[y]])))]
            size = int(rng.integers(4, CHAIN))
            at = int(rng.integers(max(1, len(w) - size)))
            take = w[at : at + size][: CHAIN - len(words)]
            words += take
            labels += [y] * len(take)
        texts.append(b" ".join(words) + b" ")
    count = Counter(w for t in texts for w in t.split())
    common = [w for w, c in count.most_common(LEXICON) if c > 1]
    buffer = np.frombuffer(b"".join(common), np.uint8)
    ends = np.cumsum([len(w) for w in common], dtype=np.int64)
    model = Crf(languages, np.unique(Stretches(byte_values(buffer)).hash(ends - [len(w) for w in common], ends)) if common else np.zeros(0, np.uint64))
    k, y = len(languages), np.array(labels).reshape(CHAINS, CHAIN)
    sums = [np.full(x.shape, 1e-2) for x in (model.weights, model.entries, model.moves, model.first)]

    def step(i: int, at: np.ndarray, g: np.ndarray) -> None:
        sums[i] += g * g
        at -= (STEP * g / np.sqrt(sums[i])).astype(at.dtype)

    for _ in range(EPOCHS):
        order = rng.permutation(CHAINS)
        for lo in range(0, CHAINS, BATCH):
            pick = order[lo : lo + BATCH]
            parts = [texts[i] for i in pick]
            data = np.frombuffer(b"".join(parts), np.uint8)
            f = Features(data, np.append(0, np.cumsum([len(p) for p in parts])))
            want, n = y[pick], np.full(len(pick), CHAIN)
            p, pair = model.marginals(model.emissions(f).reshape(len(pick), CHAIN, k), n)
            gap = p.copy()
            np.put_along_axis(gap, want[:, :, None], np.take_along_axis(gap, want[:, :, None], 2) - 1, 2)
            seen = np.zeros((k, k))
            np.add.at(seen, (want[:, :-1].ravel(), want[:, 1:].ravel()), 1)
            scale = 1 / len(pick)
            step(2, model.moves, (pair - seen) * scale + PENALTY * model.moves)
            step(3, model.first, gap[:, 0].sum(axis=0) * scale)
            g = gap.reshape(-1, k) * f.letters[:, None]
            at = model.entry(f)
            step(1, model.entries, np.stack([np.bincount(at, g[:, j], len(model.entries)) for j in range(k)], 1) * scale + PENALTY * model.entries)
            total = np.zeros_like(model.weights, dtype=np.float64)
            for size, slot in f.slots.items():
                a, b = f.ranges(size)
                a, b = np.minimum(a, len(slot)), np.minimum(b, len(slot))
                who = np.repeat(np.arange(len(a)), b - a)
                cell = slot[np.repeat(a, b - a) + np.arange(len(who)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
                for j in range(k):
                    total[:, j] += np.bincount(cell, g[who, j], SLOTS)
            step(0, model.weights, total * scale + PENALTY * model.weights)
            model.entries[-1] = 0
    return model


def _columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    texts = texts.to_pylist()
    low = pa.array([t.lower() + " " for t in texts], pa.large_string())
    data, offsets = raw(low)
    return data, offsets, [bool(LETTER.search(t)) for t in texts]


def _marginals(model: Crf, data: np.ndarray, offsets: np.ndarray) -> tuple[Features, np.ndarray]:
    """Of every word: forward-backward over each whole text."""
    f = Features(data, offsets)
    if not len(f.words):
        return f, np.zeros((0, len(model.languages)))
    starts, n = chains_of(f.doc)
    text = f.doc[starts]
    e = model.emissions(f)
    begins = np.append(True, text[1:] != text[:-1])
    parts = range(0, len(starts), 512)
    transfers = np.concatenate([model.transfers(_padded(e, starts[i : i + 512], n[i : i + 512])[0], n[i : i + 512], begins[i : i + 512]) for i in parts])
    before, behind = model.messages(transfers, text)
    out = np.zeros_like(e)
    for lo in parts:
        s, m = starts[lo : lo + 512], n[lo : lo + 512]
        cells, place = _padded(e, s, m)
        p, _ = model.marginals(cells, m, before[lo : lo + 512], behind[lo : lo + 512])
        live = np.arange(m.max()) < m[:, None]
        out[place[live]] = p[live]
    return f, out


def _predict(sent, at: int | None):
    """at: the place of the text in rest, or None for a column of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.languages)
        for b in batches:
            texts = b.column("text") if at is None else b.column("rest").field(at).fill_null("")
            data, offsets, lettered = _columns(texts)
            answer, score = ["und"] * len(lettered), np.zeros(len(lettered))
            for lo, hi in chunks(offsets) if k else ():
                f, p = _marginals(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p = p[f.letters]
                doc = f.doc[f.letters]
                total = np.stack([np.bincount(doc, p[:, j], hi - lo) for j in range(k)], 1)
                words = np.bincount(doc, minlength=hi - lo)
                best = total.argmax(axis=1)
                for i in range(hi - lo):
                    if lettered[lo + i] and words[i]:
                        answer[lo + i] = model.languages[best[i]]
                        score[lo + i] = min(1.0, total[i, best[i]] / words[i])
            out = {c: b.column(c) for c in ("doc_id", "rest") if c in b.schema.names} | {"lang_pred": pa.array(answer, pa.string()), "score": pa.array(score)}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _label(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            data, offsets, _ = _columns(b.column("text"))
            ids = b.column("doc_id")
            for lo, hi in chunks(offsets) if model.languages else ():
                f, p = _marginals(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if not len(p):
                    continue
                y = p.argmax(axis=1)
                begin = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (f.doc[1:] != f.doc[:-1])))
                base = np.searchsorted(f.doc, f.doc[begin])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(lo + f.doc[begin])), pa.array((begin - base).astype(np.int32)),
                        pa.array(np.diff(np.append(begin, len(y))).astype(np.int32)), pa.array([model.languages[i] for i in y[begin]], pa.string()),
                    ],
                    names=["doc_id", "start", "n", "lang"],
                )

    return run


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang"):
    """A broadcast Crf from the rows with a text and a label."""
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("label is not null and text rlike '[\\\\p{L}]'")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.sparkContext.broadcast(Crf([], np.zeros(0, np.uint64)))
    each = -(-SAMPLE_ROWS // len(counts))
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("label") == y, int(min(1.0, each / n) * (1 << 20))).otherwise(share)
    at = F.pmod(F.col("hash"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    rows = rows.withColumn("hash", F.xxhash64("key", "text")).where(F.pmod("hash", F.lit(1 << 20)) < share)
    sample = rows.groupBy("label", "hash").agg(F.min(F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS))).alias("text"))  # rows that repeat count once
    return spark.sparkContext.broadcast(fit([(r.text, r.label) for r in sorted(sample.collect())]))


def predict(docs: DataFrame, sent, key: str = "doc_id", text: str = "text", carry: bool = True) -> DataFrame:
    """(doc_id, rest, lang_pred, score) of every text; rest: the whole row as a struct, unless carry is false."""
    doc_id = F.col(key).cast("long").alias("doc_id")
    if not carry:
        return docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_predict(sent, None), "doc_id long, lang_pred string, score double")
    rows = docs.select(doc_id, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest"))
    schema = columns_of(doc_id="long", rest=rows.schema["rest"].dataType, lang_pred="string", score="double")
    return rows.mapInArrow(_predict(sent, docs.columns.index(text)), schema)


def label_words(docs: DataFrame, sent, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n, lang): runs of n words in one language, from word `start` of the text."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(_label(sent), "doc_id long, start int, n int, lang string")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1
