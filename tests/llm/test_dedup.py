"""Dedup operators against brute force, with odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard, simhash, spans, substring_dedup, suffix_dedup
from tessera.llm.components import components
from tests.llm.conftest import prose


def by_row(rows):
    """Brute-force answers by row: rows keep their place as a key, since ids may be null or repeat."""
    return [(k, t) for k, (_, t) in enumerate(rows)]


def counted(want, rows):
    return Counter((rows[k][0], *v) for k, v in want.items())


@pytest.mark.parametrize("most", [3, 1000])
def test_substring_dedup(spark, odd_docs, odd_rows, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "BUCKET_ROWS", most)
    got = substring_dedup.digest(substring_dedup.substring_dedup(odd_docs)).collect()
    want = substring_dedup.brute(by_row(odd_rows))
    assert Counter(tuple(r) for r in got) == counted(want, odd_rows)
    assert sum(v[1] for v in want.values()) > 500


def test_substring_dedup_keeps_untouched_texts_whole(odd_docs):
    rows = substring_dedup.substring_dedup(odd_docs, carry=("lang", "rest"), whole=True).where("n_removed = 0 and doc_id = 4").collect()
    assert [(r.kept, set(r.own.asDict())) for r in rows] == [("Two words", {"lang", "rest"})]


@pytest.mark.parametrize("most", [3, 6000])
def test_suffix_dedup(spark, odd_docs, odd_rows, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", most)
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(odd_docs)).collect()
    want = suffix_dedup.brute(by_row(odd_rows))
    assert Counter(tuple(r) for r in got) == counted(want, odd_rows)
    assert sum(v[1] for v in want.values()) > 3000


def test_suffix_dedup_of_short_strings(odd_docs, odd_rows):
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(odd_docs, length=30, gram=8, piece=2)).collect()
    assert Counter(tuple(r) for r in got) == counted(suffix_dedup.brute(by_row(odd_rows), 30), odd_rows)


def test_prefix_doubling_over_all_places_agrees(spark, odd_rows):
    texts = sorted({t for _, t in odd_rows if t})[:25]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.row: r.doc_id for r in docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id").collect()}
    gone = {i: set() for i in range(len(texts))}
    for r in suffix_dedup.prefix_doubling(docs, length=50).collect():
        gone[rows[r.row]].update(range(r.pos, r.pos + 50))
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, length=50, gram=16, piece=4)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: len(x) for i, x in gone.items()} and any(gone.values())


def test_doubling_bucket_agrees_with_sorted_strings():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        text = bytes(rng.integers(97, 99, 60 + int(rng.integers(30)), dtype=np.uint8))
        rows.append((i, 0, len(text) - 19, text, 1 + i % 2))
    found = []
    for bucket in (suffix_dedup.doubling_bucket(20, 8), spans.exact_bucket(spans.byte_windows(20))):
        out = spans.Found()
        bucket(rows, out)
        flags = {(d, s + j) for d, s, n, w in zip(*out.cols[:4], strict=True) if w is None for j in range(n)}
        found.append((flags, Counter(t for w, t in zip(out.cols[3], out.cols[4], strict=True) if w is not None)))
    assert found[0] == found[1] and found[0][0]


def test_simhash(spark, odd_docs, odd_rows):
    got = simhash.digest(simhash.near_groups(simhash.fingerprints(odd_docs))).collect()
    want = simhash.brute(by_row(odd_rows))
    prints = Counter((odd_rows[k][0], v[0]) for k, v in want.items())
    assert Counter((r.doc_id, r.fingerprint) for r in got) == prints
    groups = {}
    for k, (p, c) in want.items():
        groups.setdefault(c, set()).update(([odd_rows[k][0]] if odd_rows[k][0] is not None else []))
    least = {v[0]: min(groups[v[1]], default=None) for v in want.values()}
    assert all(r.component_id == least[r.fingerprint] for r in got)


@pytest.mark.parametrize("crowded", [20, 1 << 18])
def test_trie_links_all_near_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(40):
            x = int(s)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(enumerate(signed)), "doc_id long, print long")).collect()}
    root = list(range(len(values)))
    changed = True
    a = np.array(values, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    while changed:
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(a))]
        changed, root = new != root, new
    assert [got[i] for i in range(len(a))] == root


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1001, 1400))


def test_empty_tables(no_docs):
    assert substring_dedup.digest(substring_dedup.substring_dedup(no_docs)).count() == 0
    assert suffix_dedup.digest(suffix_dedup.suffix_dedup(no_docs)).count() == 0
    assert simhash.digest(simhash.near_groups(simhash.fingerprints(no_docs))).select(F.col("component_id")).count() == 0


def test_pipeline_stage_links_all_of_jaccard_four_fifths(spark, odd_rows):
    rng = random.Random(8)
    base = [prose(rng, rng.randrange(60, 110)).split() for _ in range(12)]
    near = [[f"x{rng.randrange(99)}" if k in at else w for k, w in enumerate(b)] for b in base for at in (set(rng.sample(range(len(b)), n)) for n in (1, 1, 2, 3))]
    texts = [t for i, t in odd_rows if i is not None] + [" ".join(w) for w in base + near] + [" ".join(base[0][:4]), "Four small words here", "four small WORDS here"]
    rows = list(enumerate(texts))
    want = jaccard.brute(rows)
    simhash_ = simhash.brute(rows)
    assert len({i for i in want if simhash_[i][1] == i and want[i] != i}) > 3  # three bits lose these
    docs = spark.createDataFrame(rows + [(None, texts[7])], "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.near_groups(docs).where("doc_id is not null").collect()} == want
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs.where("doc_id is not null"), "").collect()) == sorted(set(want.values()))


def test_pairs_of_near_dedup_grow_with_the_rows(spark, monkeypatch):
    """Texts that share a long passage, too rare for a sample of a few rows, and are far from similar: they don't meet by its shingles."""
    met = []
    by_sketch = jaccard._by_sketch
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(jaccard, "_by_sketch", lambda pairs, sketches: met.append(pairs.count()) or by_sketch(pairs, sketches))
    rng = random.Random(11)
    passages = [prose(rng, 60, 1 << 30) for _ in range(8)]
    rows = [(i, passages[i % 8] + " " + prose(rng, 40, 1 << 30)) for i in range(480)] + [(480, passages[0])]
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 481
    assert sum(met) < 481
