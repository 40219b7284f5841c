"""Cross-tokenizer alignment by segments: each distinct segment is tokenised and aligned once, documents are composed of them.

A text (with a space before it) is cut before runs of white space, where neither vocabulary can hold a token across the cut: the character before is no white space, the
one after is one of those before which no entry of either vocabulary has anything but white space (Cutter checks all entries; for the
vocabularies at hand these are space, tab and line feed, but not carriage return). The first tokeniser also parts words there
by its pattern, which looks at nothing before a cut and, beyond one, at nothing but whether white space goes on. Both tokenisers therefore give a document the tokens of its segments, one after another,
and both end a token at each cut, so that groups and links never cross one.

Documents are dealt to blocks by key and text; a block asks for each of its distinct segments once, with how often it holds it. Segments are summed over
the corpus (map-side first), tokenised and aligned, each once, and their links counted by pairs of ids. What a block needs of its segments comes back
to it by an equi-join, packed, by the place of each among the block's segments in order, and its documents are composed there. A segment that does not give back its own bytes empties every document
that holds it: the blocks with such segments are read once more, and their documents' segments taken from the counts.

Defined results: null and empty texts, and texts whose tokens' bytes differ, have no tokens (zeros, an empty digest); a doc_id may be null or repeat; rows that repeat count each;
a text without white space is one segment, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, discard, prepare, raw, sent_side, written

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 16 << 20
#: Answers that are packed at once.
PACKED_ROWS = 1 << 19
#: Bytes of texts that a worker handles at once (a longer text alone).
SLICE_BYTES = 1 << 20
MARK, DUMMY = "▁", " "
SPACES = " \t\n\r\x0b\x0c"
#: White space that is one byte, and that is more, as big-endian numbers of its UTF-8 bytes.
WHITE = np.array([b < 128 and chr(b).isspace() for b in range(256)])
WIDE = np.array([int.from_bytes(chr(c).encode(), "big") for c in range(128, 1 << 16) if chr(c).isspace()])


def byte_alphabet() -> dict[str, int]:
    """Byte-level entries write printable Latin-1 bytes as themselves and the others, in order, as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenisers, the bytes of their entries, and where texts may be cut."""

    def __init__(self, a_bytes: bytes, b_bytes: bytes):
        self.files = a_bytes, b_bytes
        self.loaded = False

    @staticmethod
    def read(a_file: str = A_FILE, b_file: str = B_FILE) -> Aligner:
        with open(a_file, "rb") as a, open(b_file, "rb") as b:
            return Aligner(a.read(), b.read())

    def __getstate__(self) -> dict:
        return {"files": self.files, "loaded": False}

    def ready(self) -> Aligner:
        """Loads what the files hold, once in a process."""
        if self.loaded:
            return self
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = self.files
        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_alphabet()
        n = self.a.get_vocab_size(with_added_tokens=True)
        added = {t["id"]: t["content"] for t in json.loads(a).get("added_tokens", [])}
        self.a_entries = [added[i].encode() if i in added else bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(n)]
        self.b_entries = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in e], np.int64) for e in (self.a_entries, self.b_entries))
        self.cut = self._cuts()
        self.mark = self.b.piece_to_id(MARK)
        self.loaded = True
        return self

    def _cuts(self) -> np.ndarray:
        """By byte, whether a text may be cut before it: white space that no entry has after anything else, and that no piece joins to a leading mark."""
        texts = [x.decode("utf-8", "replace") for x in (*self.a_entries, *self.b_entries)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        inner = {c for t in texts for c in SPACES if re.search(rf"\S{c}", t)}
        marked = {c for p in pieces for c in p[1:] if p[0] == MARK and c in SPACES}
        return np.array([b < 128 and chr(b) in SPACES and chr(b) not in inner | marked for b in range(256)])

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The segments of texts, with a space before each that is not empty, and the text of each."""
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], 32)
        begins = offsets[full] + np.arange(len(full))
        at = np.flatnonzero(self.cut[data])
        at = at[at > 0]
        before = data[at - 1]
        ok = ~WHITE[before]
        high = np.flatnonzero(before >= 128)
        if len(high):
            code = sum(data[np.maximum(at[high] - i, 0)].astype(np.int64) << (8 * (i - 1)) for i in (1, 2, 3))
            ok[high] = ~(np.isin(code, WIDE) | np.isin(code & 0xFFFF, WIDE))
        cuts = np.union1d(begins, at[ok])
        ends = np.append(cuts, len(data))
        found = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends), pa.py_buffer(data))
        return found, full[np.searchsorted(begins, cuts, "right") - 1]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenisers. The second adds a space to what it is given: it gets the segment without its own, or the mark goes."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        own = [s[:1] == " " for s in segments]
        b = self.b.encode([s[1:] if o else s for s, o in zip(segments, own, strict=True)], num_threads=1)
        for i, o in enumerate(own):
            if not o:
                b[i] = b[i][1:] if b[i][:1] == [self.mark] else [-1]
            elif segments[i] == " ":
                b[i] = [self.mark]  # of an empty text the library makes no token
        return a, b

    def bytes_of(self, ids: list[int], entries: list[bytes]) -> bytes | None:
        return b"".join([entries[i] for i in ids]) if -1 not in ids else None

    def align(self, segments: list[str]) -> dict[str, list]:
        """For each segment: whether both give back its bytes, numbers of tokens, groups and links, the groups' digest text, and links as two lists of ids."""
        out = {k: [] for k in ("fits", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b")}
        for s, a, b in zip(segments, *self.encode(segments), strict=True):
            want = s.encode()
            if self.bytes_of(a, self.a_entries) != want or self.bytes_of(b, self.b_entries) != want:
                row = False, 0, 0, 0, 0, "", [], []
            else:
                row = True, len(a), len(b), *self._aligned(a, b)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    def _aligned(self, a: list[int], b: list[int]) -> tuple[int, int, str, list[int], list[int]]:
        """Walks both tokenisations along the bytes: each step ends the token that ends first, or both."""
        links_a, links_b, groups = [], [], []
        i = j = end_a = end_b = first_a = first_b = 0
        sizes_a, sizes_b = self.a_size, self.b_size
        if a:
            end_a, end_b = int(sizes_a[a[0]]), int(sizes_b[b[0]])
        while i < len(a) and j < len(b):
            links_a.append(a[i])
            links_b.append(b[j])
            ends_a, ends_b = end_a <= end_b, end_b <= end_a
            if ends_a and ends_b:
                groups.append(",".join(map(str, a[first_a : i + 1])) + "|" + ",".join(map(str, b[first_b : j + 1])))
                first_a, first_b = i + 1, j + 1
            if ends_a:
                i += 1
                end_a += int(sizes_a[a[i]]) if i < len(a) else 0
            if ends_b:
                j += 1
                end_b += int(sizes_b[b[j]]) if j < len(b) else 0
        return len(groups), len(links_a), ";".join(groups), links_a, links_b


def _cut(aligner: Aligner, texts: pa.ChunkedArray) -> tuple[pa.Array, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The distinct segments of a block's texts in order of their bytes, and by slices of texts (from, to, each segment's place in that order, its text)."""
    data, offsets = raw(texts)
    found, parts = [pa.array([], pa.large_string())], []
    for lo, hi in chunks(offsets, SLICE_BYTES):
        segments, text = aligner.segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        d = segments.dictionary_encode()
        found.append(d.dictionary)
        parts.append((lo, hi, d, text))
    all_ = pa.concat_arrays(found).unique()
    all_ = all_.take(pc.array_sort_indices(all_))
    place = lambda d: pc.index_in(d.dictionary, value_set=all_).to_numpy(zero_copy_only=False)[d.indices.to_numpy(zero_copy_only=False)]
    return all_, [(lo, hi, place(d), text) for lo, hi, d, text in parts]


def _asked(sent):
    def run(table: pa.Table) -> pa.Table:
        """A block's distinct segments in order, and how often it holds each."""
        segments, parts = _cut(sent.value.ready(), table.column("text"))
        n = sum((np.bincount(at, minlength=len(segments)) for *_, at, _ in parts), np.zeros(len(segments), np.int64))
        block = np.full(len(segments), table.column("block")[0].as_py())
        return pa.table({"block": block, "place": np.arange(len(segments), dtype=np.int32), "segment": segments.cast(pa.string()), "n": n})

    return run


def _counted(segments: pa.Array) -> pa.Table:
    d = segments.dictionary_encode()
    n = np.bincount(d.indices.to_numpy(zero_copy_only=False), minlength=len(d.dictionary))
    return pa.table({"segment": d.dictionary, "n": pa.array(n.astype(np.int64))})


def _emptied(sent):
    def run(table: pa.Table, bad: pa.Table) -> pa.Table:
        """Segments of the documents that hold a bad one, and how often they do, as negative numbers."""
        aligner, wrong = sent.value.ready(), bad.column("segment").cast(pa.large_string())
        parts = [_counted(pa.array([], pa.large_string()))]
        data, offsets = raw(table.column("text"))
        for lo, hi in chunks(offsets, SLICE_BYTES):
            segments, text = aligner.segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lost = np.zeros(hi - lo, bool)
            lost[text[pc.is_in(segments, value_set=wrong).to_numpy(zero_copy_only=False)]] = True
            parts.append(_counted(segments.filter(pa.array(lost[text]))))
        found = pa.concat_tables(parts)
        return pa.table({"segment": found.column("segment").cast(pa.string()), "n": pc.negate(found.column("n"))})

    return run


ALIGNED = "segment string, n long, fits boolean, n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>"


def _alignments(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sent.value.ready()
        kinds = {"fits": pa.bool_(), "groups": pa.string(), "link_a": pa.list_(pa.int32()), "link_b": pa.list_(pa.int32())}
        for b in batches:
            found = aligner.align(b.column("segment").to_pylist())
            yield pa.RecordBatch.from_pydict({"segment": b.column("segment"), "n": b.column("n")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()})

    return run


STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
COMPOSED = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", groups_sha256 string"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (block, place, ...) as compressed tables, one row a block: rows of their own would be three times as large."""
    held: list[pa.RecordBatch] = []

    def settle() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("place", "ascending")]).combine_chunks()
        block = t.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        parts = []
        for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t.slice(lo, hi - lo))
            parts.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_pydict({"block": block[starts], "part": pa.array(parts, pa.binary())})

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= PACKED_ROWS:
            yield settle()
            held.clear()
    if sum(x.num_rows for x in held):
        yield settle()


def _composed(sent):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({"doc_id": pa.array([], pa.int64()), **{s: pa.array([], pa.int64()) for s in STATS}, "groups_sha256": pa.array([], pa.string())})
        segments, parts = _cut(sent.value.ready(), docs.column("text"))
        told = [pa.ipc.open_stream(x.as_py()).read_all() for x in answers.column("part")]
        stats, fits, groups = np.zeros((len(STATS), len(segments)), np.int64), np.zeros(len(segments), bool), [""] * len(segments)
        for t in told:
            at = t.column("place").to_numpy()
            stats[:, at] = [t.column(s).to_numpy() for s in STATS]
            fits[at] = t.column("fits").to_numpy()
            for i, g in zip(at.tolist(), t.column("groups").to_pylist(), strict=True):
                groups[i] = g
        sums, digests = [np.zeros((len(STATS), 0), np.int64)], []
        for lo, hi, at, text in parts:
            cuts = np.searchsorted(text, np.arange(hi - lo + 1))
            starts, ends = cuts[:-1], cuts[1:]
            bad = np.append(0, np.cumsum(~fits[at]))
            ok = (bad[ends] == bad[starts]) & (ends > starts)
            total = np.concatenate([np.zeros((len(STATS), 1), np.int64), np.cumsum(stats[:, at], axis=1)], axis=1)
            sums.append(np.where(ok, total[:, ends] - total[:, starts], 0))
            of_text = [groups[i] for i in at.tolist()]
            digests += [hashlib.sha256(";".join(of_text[i:j]).encode()).hexdigest() if o else "" for i, j, o in zip(starts.tolist(), ends.tolist(), ok.tolist(), strict=True)]
        return pa.table({"doc_id": docs.column("doc_id"), **dict(zip(STATS, map(pa.array, np.concatenate(sums, axis=1)), strict=True)), "groups_sha256": pa.array(digests, pa.string())})

    return run


def alignments(docs: DataFrame, sent, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocked documents, what each block asks for, segments with their alignments and corpus counts, counts of id pairs)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")
    asked = written(blocked.groupBy("block").applyInArrow(_asked(sent), "block long, place int, segment string, n long"), "asked")
    summed = asked.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = written(summed.mapInArrow(_alignments(sent), ALIGNED), "aligned")
    bad = aligned.where("not fits").select("segment")
    if not bad.isEmpty():
        wrong = asked.join(bad, "segment").select("block", "segment")
        lost = blocked.join(wrong.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(wrong.groupBy("block")).applyInArrow(_emptied(sent), "segment string, n long")
        lost = written(lost.groupBy("segment").agg(F.sum("n").alias("lost")), "lost")
        whole = written(aligned.join(lost, "segment", "left").withColumn("n", F.col("n") + F.coalesce("lost", F.lit(0))).drop("lost"), "aligned")
        discard(aligned, lost)
        aligned = whole
    links = aligned.where("fits and n > 0").select("n", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("n", "l.*")
    pairs = written(links.groupBy("link_a", "link_b").agg(F.sum("n").alias("count")), "pairs")
    return blocked, asked, aligned, pairs


def align(docs: DataFrame, sent, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    prepare(spark)
    blocked, asked, aligned, pairs = alignments(docs, sent, key, text)
    best = pairs.groupBy("link_b").agg(F.max("count").alias("best"))
    ranked = written(pairs.join(F.broadcast(best), "link_b").select("link_a", "link_b", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best")), "ranked-pairs")  # best: a row for each id of the vocabulary
    links = aligned.where("fits").select("segment", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("segment", "l.*")
    sums = links.join(sent_side(ranked), ["link_a", "link_b"], "left").groupBy("segment").agg(F.coalesce(F.sum("is_best"), F.lit(0)).alias("n_best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"))
    told = written(aligned.drop("n", "link_a", "link_b").join(sums, "segment", "left").na.fill(0, ["n_best", "count_sum"]), "told")
    discard(aligned, ranked, pairs)
    rows = asked.select("block", "place", "segment").join(told, "segment").drop("segment")
    answers = written(rows.mapInArrow(_packed, "block long, part binary"), "answers")
    discard(asked, told)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_composed(sent), COMPOSED)


def send(spark, a_file: str = A_FILE, b_file: str = B_FILE):
    """Both vocabularies for the executors, read on the driver."""
    return spark.sparkContext.broadcast(Aligner.read(a_file, b_file))


def brute(docs: list[tuple[int | None, str | None]], a_file: str = A_FILE, b_file: str = B_FILE) -> list[tuple]:
    """What align() returns, from whole texts and all pairs of tokens; for tests."""
    x = Aligner.read(a_file, b_file).ready()
    per, counts = [], {}
    for i, t in docs:
        a = x.a.encode(DUMMY + t, add_special_tokens=False).ids if t else []
        b = x.b.encode(t) if t else []
        if not t or x.bytes_of(a, x.a_entries) != (DUMMY + t).encode() or x.bytes_of(b, x.b_entries) != (DUMMY + t).encode():
            a, b = [], []
        ends_a, ends_b = np.cumsum(x.a_size[a]).tolist() if a else [], np.cumsum(x.b_size[b]).tolist() if b else []
        both = sorted(set(ends_a) & set(ends_b))
        group = lambda ids, ends: [",".join(str(t) for t, e in zip(ids, ends, strict=True) if lo < e <= hi) for lo, hi in zip([0, *both], both, strict=False)]
        text = ";".join(f"{p}|{q}" for p, q in zip(group(a, ends_a), group(b, ends_b), strict=True))
        from_b, to_b = np.array([0, *ends_b[:-1]]), np.array(ends_b)
        links = [(s, b[j]) for s, e, f in zip(a, ends_a, [0, *ends_a], strict=False) for j in np.flatnonzero((f < to_b) & (from_b < e))]
        for p in links:
            counts[p] = counts.get(p, 0) + 1
        per.append((i, a, b, both, links, text))
    best: dict[int, int] = {}
    for (_, t), c in counts.items():
        best[t] = max(best.get(t, 0), c)
    return [
        (i, len(a), len(b), len(both), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "")
        for i, a, b, both, links, text in per
    ]
