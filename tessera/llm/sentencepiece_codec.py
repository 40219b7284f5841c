"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, in one pass, every piece that ends at each place (its output links); each relaxes the best way there.
For a model of merges (BPE) a way is allowed if merging would leave each two neighbouring pieces of it apart: of all ways to a place
exactly one is, which is what replaying the merges by score gives, so that ids equal those of the sentencepiece
library. For a model of scores (unigram) the best way has the highest total, ties to the longer last piece. A character that no
piece reaches becomes its UTF-8 bytes. Pieces never hold another character before a word mark, so that the pieces
of a text are those of its words, which are cached. Decoding gives the text back exactly.

Defined results: a null text is encoded as an empty one, which has no pieces; a word mark that stands in the text itself is encoded as bytes
(the library would read it as a space); equal texts and repeated rows get equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import columns_of, prepare, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Letters; superscript digits are none.
LETTER = re.compile(r"[^\W\d_¹²³]")
#: Bytes of words and ids in a worker's cache, the longest word that is kept, and pairs of pieces that are kept.
CACHE_BYTES, CACHE_CHARS, CACHE_PAIRS = 96 << 20, 48, 400_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 256 << 10
#: Below the least score, for a character in bytes.
PENALTY = 10.0


class Codec:
    """pieces: (text, score) by id, text None for controls; first_byte: id of byte 0 of the 256 byte pieces; merges: whether scores rank merges."""

    def __init__(self, pieces: list[tuple[str | None, float]], first_byte: int, merges: bool = False):
        self.pieces, self.first_byte, self.merges = pieces, first_byte, merges

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        m = SentencePieceProcessor(model_file=path)
        kind = sentencepiece_model_pb2.ModelProto.FromString(m.serialized_model_proto()).trainer_spec.model_type
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        return cls([(None if s else m.id_to_piece(i), m.get_score(i)) for i, s in enumerate(special)], m.piece_to_id("<0x00>"), kind == 2)

    def ready(self) -> Codec:
        """Builds the automaton; workers that encode call it once."""
        if hasattr(self, "automaton"):
            return self
        self.rank = {p: s for p, s in self.pieces if p}
        self.automaton = ahocorasick.Automaton()
        for i, (p, s) in enumerate(self.pieces):
            if p and (not self.merges or self.merged(p) == [p]):  # a piece that merges never make is never found
                self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.floor = min(s for p, s in self.pieces if p) - PENALTY
        # parts of a text can be encoded one by one where no piece spans the place between them
        pairs = {x for p, _ in self.pieces if p for x in zip(p, p[1:], strict=False)}
        whole = any(b == MARK != a for a, b in pairs)
        mixed = any(MARK not in (a, b) and bool(LETTER.match(a)) != bool(LETTER.match(b)) for a, b in pairs)
        self.word = re.compile(r"(?s).+" if whole else "(?s) *[^ ]+| +" if mixed else r"(?s) *[^\W\d_¹²³]+| *(?:[\W\d_¹²³](?<! ))+| +")
        self.known = {p for p, _ in self.pieces if p and len(p) == 1}
        self.cache: dict[str, bytes] = {}
        self.cached, self.pairs = 0, {}
        return self

    def table(self) -> Codec:
        """What decoding needs: the bytes of every piece."""
        if not hasattr(self, "size"):
            raw = [b"" if p is None else p.replace(MARK, " ").encode() for p, _ in self.pieces]
            for b in range(256):
                raw[self.first_byte + b] = bytes([b])
            self.size = np.array([len(x) for x in raw])
            self.at = np.cumsum(self.size) - self.size
            self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        return self

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "first_byte": self.first_byte, "merges": self.merges}

    def _bytes(self, text: str) -> list[int]:
        return [self.first_byte + b for b in text.encode()]

    def merged(self, text: str) -> list[str]:
        """The pieces that replaying merges leaves: always the neighbours whose union scores highest, the leftmost of equals."""
        rank, parts = self.rank, list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        todo = [(-rank[x + y], i, x + y) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in rank]
        heapq.heapify(todo)
        while todo:
            _, i, union = heapq.heappop(todo)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(union) or parts[i] + parts[j] != union:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = union, ""
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if union + parts[k] in rank:
                    heapq.heappush(todo, (-rank[union + parts[k]], i, union + parts[k]))
            h = before[i]
            if h >= 0 and parts[h] + union in rank:
                heapq.heappush(todo, (-rank[parts[h] + union], h, parts[h] + union))
        return [p for p in parts if p]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces as they are when they are neighbours."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            x, y = self.pieces[left][0], self.pieces[right][0]
            found = self.merged(x + y) == [x, y]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def viterbi(self, word: str) -> list[int]:
        return self._by_merges(word) if self.merges else self._by_score(word)

    def _by_merges(self, word: str) -> list[int]:
        """back[e]: the last piece of the one allowed way to e: (length, id), id -1 for a character in bytes."""
        n, pairs = len(word), self.pairs
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        if not self.known.issuperset(word):
            for i, c in enumerate(word):
                if c not in self.known:
                    back[i + 1] = 1, -1
        for end, (length, _, i) in self.automaton.iter(word):  # at one end, the longest first
            if back[end + 1] is None:
                start = end + 1 - length
                if start:
                    if (last := back[start]) is None:
                        continue
                    if last[1] >= 0:
                        ok = pairs.get(last[1] << 32 | i)
                        if not (self.apart(last[1], i) if ok is None else ok):
                            continue
                back[end + 1] = length, i
        return self._ids(word, back)

    def _by_score(self, word: str) -> list[int]:
        n, floor = len(word), self.floor
        spelt = self.known.issuperset(word)
        best = [0.0] + [-math.inf] * n
        back: list[tuple[int, int]] = [(1, -1)] * (n + 1)
        done = 0
        for end, (length, score, i) in self.automaton.iter(word):  # at one end, the longest first
            while not spelt and done <= end:
                done += 1
                best[done] = best[done - 1] + floor
            if best[end + 1 - length] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[end + 1 - length] + score, (length, i)
        return self._ids(word, back)

    def _ids(self, word: str, back: list) -> list[int]:
        out: list[int] = []
        n = len(word)
        while n:
            length, i = back[n]
            if i < 0:
                out.extend(reversed(self._bytes(word[n - 1])))
            else:
                out.append(i)
            n -= length
        out.reverse()
        return out

    def packed(self, text: str) -> bytes:
        """The text's ids as 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                out.append(struct.pack("3i", *self._bytes(MARK)))
            words = self.word.findall(part)
            ids = list(map(self.cache.get, words))
            if None in ids:
                ids = [self._new(w) if x is None else x for w, x in zip(words, ids, strict=True)]
            out += ids
        return b"".join(out)

    def _new(self, word: str) -> bytes:
        """Ids of a word that was not in the cache."""
        found = self.viterbi(word.replace(" ", MARK))
        ids = struct.pack(f"{len(found)}i", *found)
        if len(word) <= CACHE_CHARS:
            self.cached += 2 * len(word) + len(ids) + 200  # about what Python keeps for both
            if self.cached > CACHE_BYTES:
                self.cache.clear()
                self.cached = 0
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of lists of ids that lie one after another."""
        self.table()
        begin, size = self.at[ids], self.size[ids]
        ends = np.cumsum(size)
        data = self.bytes[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edge = np.append(0, ends)[offsets].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(edge, edge[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode(errors="replace")


_READY: dict[str, Codec] = {}


def _codec(sent, encodes: bool) -> Codec:
    """The codec of this worker, kept between tasks; sent: its name and broadcast. Only encoding needs the automaton."""
    name, value = sent
    if name not in _READY:
        _READY.clear()
        _READY[name] = value.value
    return _READY[name].ready() if encodes else _READY[name]


def _in_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def _encoded(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the offsets of each text's."""
    each = [codec.packed(t.as_py()) for t in texts]
    return np.frombuffer(b"".join(each), np.int32), np.append(0, np.cumsum([len(x) // 4 for x in each]))


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _texts(codec: Codec, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.array([t.decode(errors="replace") for t in codec.decode_all(ids, offsets)], pa.string())


def _work(sent, encodes: bool, decodes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, encodes)
        for b in batches:
            for lo, hi in _in_slices(b.column("text")) if encodes else [(0, len(b))]:
                part = b.slice(lo, hi - lo)
                if encodes:
                    ids, offsets = _encoded(codec, part.column("text"))
                    lists = _lists(ids, offsets)
                else:
                    lists = part.column("ids")
                    offsets = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64)))
                    ids = lists.flatten().to_numpy()
                out = {c: part.column(c) for c in ("doc_id", "own") if c in part.schema.names} | {"ids": lists} | ({"text": _texts(codec, ids, offsets)} if decodes else {})
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def send(spark: SparkSession, path: str = MODEL):
    """The codec on all executors: one vocabulary, whose size doesn't depend on the data."""
    prepare(spark)
    return uuid.uuid4().hex, spark.sparkContext.broadcast(Codec.load(path))


def encode(docs: DataFrame, sent, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the text's piece ids."""
    return texts_of(docs, key, text).mapInArrow(_work(sent, True, False), "doc_id long, ids array<int>")


def decode(ids: DataFrame, sent) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""
    return ids.select("doc_id", "ids").mapInArrow(_work(sent, False, True), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, sent, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """decode(encode()) in one pass of one Python worker a task; with carry, own: a struct of these columns."""
    own = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("own")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([own] if carry else []))
    kept = {"own": rows.schema["own"].dataType} if carry else {}
    return rows.mapInArrow(_work(sent, True, True), columns_of(doc_id="long", **kept, ids="array<int>", text="string"))


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
