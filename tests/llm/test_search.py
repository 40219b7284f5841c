"""Decontamination, top-k search, licence scans, SentencePiece and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, license_scan, sentencepiece_codec, simhash, substring_dedup, topk
from tessera.llm.queries import QUERIES


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    passage = odd_rows[12][1].split()[25:70]
    rows = [
        (1, " ".join(passage)), (2, " ".join(passage[:10])), (3, "Two words"), (4, ""), (5, None),
        (6, "nothing of this is anywhere in the texts of any row here"), (7, "ONE"), (None, "two WORDS"), (1, " ".join(passage)),
    ]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, words string")


def test_decontamination(odd_docs, odd_rows, items):
    got = decontamination.digest(*decontamination.decontaminate(odd_docs, items)).collect()
    named = [(i, t) for i, t in (tuple(r)[:2] for r in items.collect())]
    want = decontamination.brute([(k, t) for k, (_, t) in enumerate(odd_rows)], [(i, t) for i, t in named if i is not None])
    assert Counter(tuple(r) for r in got) == Counter((odd_rows[k][0], *v) for k, v in want.items())
    assert sum(v[4] for v in want.values()) >= 6


def test_decontamination_of_empty_tables(odd_docs, items, no_docs):
    assert decontamination.digest(*decontamination.decontaminate(no_docs, items)).count() == 0
    assert decontamination.digest(*decontamination.decontaminate(odd_docs, items.limit(0))).where("contaminated or n_items > 0").count() == 0


def test_decontamination_finds_every_shared_window(spark):
    rng = random.Random(1)
    word = lambda: f"x{rng.randrange(6)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(60)]
    its = [(i, " ".join(word() for _ in range(rng.randrange(1, 13)))) for i in range(20)]
    got = decontamination.digest(*decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(its, "item_id long, text string"))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == decontamination.brute(docs, its)


def test_decontamination_of_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([("gsm-1", "two"), ("gsm-10", "one"), (None, "one")], "item_id string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.digest(*decontamination.decontaminate(docs, items)).collect()}
    assert got == decontamination.brute([(1, "one two"), (2, "nothing")], [("gsm-1", "two"), ("gsm-10", "one")])
    assert {r.item_id for r in decontamination.decontaminate(docs, items)[1].collect() if r.item_id} == {"gsm-1", "gsm-10"}


def test_decontamination_of_a_long_text_that_is_all_hits(spark):
    """Twice the words take less than three times the time, after a first run."""
    import time

    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(60000)]

    def took(n):
        text, began = " ".join(words[:n]), time.perf_counter()
        r = decontamination.digest(*decontamination.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string"))).first()
        assert r.n_words == r.n_hit == n and r.n_items == 1
        return time.perf_counter() - began

    took(1000)
    short, long = took(30000), took(60000)
    assert long < 3 * short


@pytest.mark.parametrize(("block", "tile"), [(4096, 4096), (3, 7)])
def test_top_k(spark, monkeypatch, block, tile):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "SHARD", 4 * tile)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(90)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(20)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (None, [1.0] * 6), (310, []), (320, [2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    ok = {i: np.pad(np.floor(256 * np.array(v)), (0, 6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in ok:
        if q % 10 == 0:
            best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_large_vectors_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1e5 if i % 7 == 0 else 1)]) for i in range(60)] + [(100, [3e8, 1.0, 0.0, 0.0]), (101, [-2e4, 9e7, 0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for q in (i for i, _ in rows if i % 5 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_refuses_scores_that_are_no_longs(spark):
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_licence_scan(spark, odd_docs, no_docs):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [
        (1, f"intro\n{mit}\nend"), (2, mit.upper().replace(",", " ,")), (3, "Released under the MIT License."), (4, "nothing"), (5, None),
        (6, " ".join(mit.split()[:60])), (7, "x\n\nReleased under\nthe MIT License.\n\ny"),
    ]
    got = {(r.doc_id, r.license): round(r.dice, 3) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == got[2, "MIT"] == got[3, "notice:MIT"] == got[7, "notice:MIT"] == 1 and not any(d in (4, 5, 6) for d, _ in got)
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0


def test_licence_bounds_prune_nothing_that_matches():
    rng = random.Random(2)
    words = "one two three four five six seven".split()
    templates = {"a": "one two three four five six", "b": "two three two three one", "c": "six five four three two one one"}
    s = license_scan.Scanner(templates, 0.8)
    found = 0
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(rng.randrange(1, 25)))
        if rng.random() < 0.5:
            body = rng.choice(list(templates.values())).split()
            body[rng.randrange(len(body))] = rng.choice(words)
            text += " ".join(body) + rng.choice(["", " three four", "\n"])
        got = s.scan(text)
        assert got == license_scan.brute(text, templates), text
        found += bool(got)
    assert found > 50


def test_licence_in_paragraphs_and_in_long_lines(spark):
    mit = license_scan.TEMPLATES["MIT"]
    cut = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    assert cut.count("\n\n") == 2
    rows = [
        (1, f"# tool\n\nsome code here\n\nCopyright (c) 2020\n\n{cut}\n\n" + " ".join(f"word{i}" for i in range(300))),
        (2, "This project is Released under the MIT License and see the file for details " + " ".join(f"word{i}" for i in range(90))),
    ]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"].dice > 0.99 and got[1, "MIT"].n_candidates == 0 and got[1, "MIT"].n_windows > 0
    assert got[2, "notice:MIT"].dice == 1 and got[2, "notice:MIT"].n_candidates == 0


def best_total(codec, text):
    """Best total score by trying all pieces at all places."""
    codec.ready()
    scores = {p: s for p, s in codec.pieces if p}
    best = [0.0] + [-1e30] * len(text)
    for e in range(1, len(text) + 1):
        best[e] = best[e - 1] + codec.floor
        for a in range(max(0, e - 20), e):
            if text[a:e] in scores:
                best[e] = max(best[e], best[a] + scores[text[a:e]])
    return best[-1]


def test_sentencepiece_is_viterbi_and_round_trips(spark, odd_docs, odd_rows, no_docs):
    codec = sentencepiece_codec.Codec([("▁a", -2.0), ("▁", -1.0), ("a", -1.0), ("ab", -1.5), ("b", -1.2), ("bc", -0.5), ("▁ab", -2.5), ("c", -3.0), ("abc", -2.0), *((None, 0.0),) * 256], 9).ready()
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("abc ▁é") for _ in range(rng.randrange(0, 14)))
        assert codec.decode(codec.encode(text)) == text
        word = "▁" + "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 10)))
        ids = codec.viterbi(word)
        total, i = 0.0, 0
        while i < len(ids):
            if ids[i] >= 9:
                total, i = total + codec.floor, i + 2  # é is two bytes
            else:
                total, i = total + codec.pieces[ids[i]][1], i + 1
        assert total == pytest.approx(best_total(codec, word))
    sent = sentencepiece_codec.send(spark)
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd_docs, sent), sent).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t or "") for i, t in odd_rows)
    assert sentencepiece_codec.digest(sentencepiece_codec.encode(no_docs, sent).withColumn("text", F.lit(""))).count() == 0


def test_sentencepiece_ids_are_the_librarys(spark, small):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec.load().ready().table()
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeiou the  in\n\té日ab1ing., xyzTHE\u200b🙂") for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["", " ", "  ", "a" * 300, "the" * 200, "\n\n", "x" * 70_000]
    for text in texts:
        assert codec.encode(text) == library.encode(text), text
        assert codec.decode(codec.encode(text)) == text
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (list(r.ids), r.text) for r in sentencepiece_codec.round_trip(docs, sentencepiece_codec.send(spark)).collect()}
    assert got == {r.doc_id: (library.encode(r.text or ""), r.text or "") for r in docs.collect()}


def test_sentencepiece_merges_of_a_toy_model():
    rng = random.Random(5)
    for _ in range(30):
        pieces = list(dict.fromkeys(["a", "b", "c"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(14)]))
        codec = sentencepiece_codec.Codec([(p, -float(i)) for i, p in enumerate(rng.sample(pieces, len(pieces)))] + [(None, 0.0)] * 256, len(pieces), True).ready()
        for _ in range(60):
            word = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 20)))
            want = [i for p in codec.merged(word) for i in ([next(k for k, (x, _) in enumerate(codec.pieces) if x == p)] if p in codec.rank else codec._bytes(p))]
            assert codec.viterbi(word) == want


def test_pipeline_stages(spark, small, odd_docs, no_docs):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    for docs in (odd_docs.select(*columns, "key", "row"), no_docs.select(*columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            n = out.count()
            assert n <= docs.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name


STAGES = dict(corpus_pipeline.STAGES)


def test_pipeline_tells_rows_apart_by_id_and_text(spark, small, odd_docs):
    columns = ("doc_id", "text", "lang", "source", "n_chars", "_no_text", "own", "row")
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(300)}" for _ in range(80)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, texts[3] + " end"), (4, None), (5, ""), (6, texts[4]), (6, texts[4])]
    docs = spark.createDataFrame(
        [(i, t, None, None, None if t is None else len(t), 1, "o", k) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, _no_text int, own string, row int",
    ).repartition(4)
    kept = STAGES["simhash_near_dedup"](spark, docs, small)
    assert kept.columns == list(columns)
    # different texts of one id stay, copies go whatever their ids, of a group the smallest id stays and null comes last
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3] + " end"), (4, None), (6, texts[4])])
    out = STAGES["substring_dedup"](spark, docs, small).collect()
    assert Counter((r.doc_id, r.text, r.n_chars, r.own, r.row) for r in out) == Counter([(1, texts[1], len(texts[1]), "o", 1), (3, "end", 3, "o", 6), (4, None, None, "o", 7), (5, "", 0, "o", 8)])


def test_pipeline_drops_contaminated_rows_without_ids(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("text is not null").first().text
    rows = [(None, f"intro words {item} more"), (None, "clean words only here"), (7, f"x {item}"), (7, "another clean text with the id of a contaminated one"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES["benchmark_decontamination"](spark, docs, small)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[1], rows[3], rows[4]])


def test_pipeline_keeps_columns_of_any_name(spark, small):
    docs = spark.createDataFrame([(1, "some words of a text", 3, "en", "a.b", "x")], "doc_id long, text string, n_chars long, lang string, `a.b` string, ids string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).select("`a.b`").collect()[0][0] == "a.b", name
    out = STAGES["sentencepiece"](spark, docs, small)
    assert set(out.columns) == {"doc_id", "text", "n_chars", "lang", "a.b", "ids", "n_tokens"} and out.first().text == "some words of a text"


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    groups = simhash.brute(list(rows.items()))
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    removed = {i: v[1] for i, v in substring_dedup.brute(list(rows.items())).items()}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    clean = decontamination.brute(list(rows.items()), items)
    whole = {i for i in rows if not removed[i] and not clean[i][4]}
    assert whole <= set(out) and all(out[i].text == rows[i] for i in whole)  # clean documents are untouched
    assert not any(clean[i][4] for i in set(out) if not removed[i])
    assert set(out) <= set(rows) and all(r.n_tokens == len(r.ids) for r in out.values())


def test_every_query_runs(spark, small):
    for name in ("op2_sentencepiece", "op6_license_scan", "op5_exact_top_k"):
        assert QUERIES[name](spark, small).count() >= 0


def test_sweep_deletes_intermediate_tables(spark, tmp_path):
    from tessera.llm import common

    common.sweep(spark)
    df = common.written(spark.range(3).toDF("x"), "test")
    path = common._written[-1]
    assert df.count() == 3
    common.sweep(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) and not common._written
