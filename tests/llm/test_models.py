"""Models: proper probabilities, held-out accuracy, brute force for what is counted."""

import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extraction, language_id, lm_scoring
from tessera.llm.common import raw


def test_lm_base_score_is_exact(odd_docs, odd_rows):
    got = lm_scoring.score(odd_docs, ~lm_scoring.held_out()).collect()
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for _, t in odd_rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in odd_rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for (i, _), ws, h in zip(odd_rows, tokens, held, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def contexts(before, second, n):
    t = object.__new__(lm_scoring.Tokens)
    t.before, t.second = np.full(n, before, np.uint64), np.full(n, second, np.uint64)
    return t


def random_model(words=2000, slots=1 << 12, seed=1):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 1 << 62, words + 50, dtype=np.uint64)
    counts = np.arange(len(tokens), 0, -1).astype(float)
    model = lm_scoring.Model(tokens, counts, counts.sum(), words, slots)
    model.weights = [rng.normal(size=w.shape).astype(np.float32) for w in model.weights]
    return model, tokens, rng


@pytest.mark.parametrize("words", [1, 15, 16, 17, 300, 2000])
def test_lm_probabilities_sum_to_one(words):
    model, tokens, _ = random_model(words)
    ranks = np.append(np.arange(words), -1)
    t = contexts(tokens[3], tokens[9], len(ranks))
    assert np.exp(model.forward(model.features(t, 0, len(ranks)), ranks)[0]).sum() == pytest.approx(1, abs=1e-4)


def test_lm_gradients_are_those_of_the_likelihood():
    """Against differences of the log-likelihood, for every level and feature, with contexts and slots that repeat."""
    model, tokens, rng = random_model(400, 1 << 4)
    model.weights = [w.astype(np.float64) for w in model.weights]
    ranks = rng.integers(-1, 400, 30)
    t = contexts(0, 0, 30)
    t.before, t.second = tokens[rng.integers(0, 4, 30)], tokens[rng.integers(0, 4, 30)]
    f = model.features(t, 0, 30)
    want = [np.zeros_like(w) for w in model.weights]
    for level, slot, rows in model.gradients(f, ranks):
        want[level][slot] += rows
    for level, w in enumerate(model.weights):
        for cell in zip(rng.integers(0, w.shape[0], 25), rng.integers(0, w.shape[1], 25), strict=True):
            old = w[cell]
            ends = []
            for d in (1e-5, -1e-5):
                w[cell] = old + d
                ends.append(-model.forward(f, ranks)[0].sum())
            w[cell] = old
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(want[level][cell], abs=1e-4)


def test_lm_gradients_name_a_slot_once():
    """One update a level and batch, whichever features select a slot; sums of runs are those of numpy."""
    model, tokens, rng = random_model(400, 1 << 4)
    t = contexts(0, 0, 50)
    t.before, t.second = tokens[rng.integers(0, 4, 50)], tokens[rng.integers(0, 4, 50)]
    found = list(model.gradients(model.features(t, 0, 50), rng.integers(-1, 400, 50)))
    assert [level for level, *_ in found] == list(range(len(model.weights))) and all(len(set(s.tolist())) == len(s) for _, s, _ in found)
    for runs in ([1], [7, 1, 1, 64, 2, 3, 33], [1, 1, 1]):
        rows, order = rng.normal(size=(sum(runs), 3)), rng.permutation(sum(runs))
        first = np.cumsum([0, *runs[:-1]])
        assert np.allclose(lm_scoring._sums(rows, order, first), np.add.reduceat(rows[order], first, axis=0))


def test_lm_rows_of_a_block_do_not_grow_with_its_tokens():
    """A block asks for its tokens as for its n-grams, packed: a row a size and shard, whose counts are those of the training texts."""
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(k, k + 500)) for k in (0, 100)]
    table = pa.table({"block": [7, 7], "text": texts, "train": [True, False]})
    asked = lm_scoring._asked(40, 3)(table)
    assert asked.num_rows == 9 and asked.schema.names == ["block", "gram", "shard", "size", "keys", "counts"]
    assert sum(r["size"] for r in asked.to_pylist() if r["gram"] == 1) == 601
    counted = pa.concat_tables([lm_scoring._counted(asked.filter([r["gram"] == 1 and r["shard"] == i for r in asked.to_pylist()])) for i in range(3)])
    t = lm_scoring.Tokens(*raw(pa.array(texts)))
    want = Counter(dict.fromkeys(t.token.tolist(), 0)) | Counter(t.token[t.doc == 0].tolist())
    assert dict(zip(counted.column("token").to_numpy().view(np.uint64).tolist(), counted.column("count").to_pylist(), strict=True)) == {w: want[w] for w in t.token.tolist()}


def test_lm_softmax_of_very_large_and_very_small_numbers():
    z = np.array([[0, 1, -np.inf], [500, 499, 0], [-900, -901, -np.inf]], np.float32)
    child = np.array([1, 0, 0])
    taken, p, total = lm_scoring._softmax(z.copy(), child)
    want = np.exp(z - z.max(axis=1, keepdims=True).astype(float))
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(p / total[:, None], want, atol=1e-6) and np.allclose(taken - np.log(total), np.log(want[np.arange(3), child]), atol=1e-5)


def test_word_hashes_of_long_words():
    """Values of the first places come from a table; a word has the same hash beside one that goes beyond it."""
    from tessera.llm.common import word_hashes

    long, short = b"x" * 70, b"some words here"
    both = np.frombuffer(short + b" " + long, np.uint8)
    starts, ends = np.array([0, 5, 11, 16]), np.array([4, 10, 15, 86])
    assert (word_hashes(both, starts, ends)[:3] == word_hashes(both, starts[:3], ends[:3])).all()
    assert word_hashes(both, starts, ends)[3] != word_hashes(both, starts[3:], ends[3:] - 1)[0]


def test_lm_score_against_brute_force(spark, odd_docs, odd_rows, monkeypatch):
    """The whole score from its definition: counts by hand, P_me from a model without updates, which is its priors."""
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "SHARD", 2000)
    got = lm_scoring.score(odd_docs, ~lm_scoring.held_out()).collect()
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for _, t in odd_rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in odd_rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for ws, h in zip(texts, held, strict=True):
        padded = ["s", "s", *ws]
        for i in range(2, len(padded) if not h else 0):
            c1[padded[i]] += 1
            c2[padded[i - 1], padded[i]] += 1
            c3[padded[i - 2], padded[i - 1], padded[i]] += 1
    n, kinds, docs = sum(c1.values()), len(c1), held.count(False)
    words, _ = lm_scoring.shape(n, kinds)
    least = sorted(c1.values(), reverse=True)[:words][-1]
    sure, cut = [w for w in c1 if c1[w] > least], [w for w in c1 if c1[w] == least]
    inside = words - len(sure)  # of the words that tie for the last places, which ones are in is the hash's matter
    rare_mass = n - sum(c1[w] for w in sure) - inside * least

    def p_me(w, known):
        return c1[w] / n if known else max(1e-6, rare_mass / n) * (c1[w] + 0.5) / (rare_mass + 0.5 * (kinds - words + 1))

    def total(ws, tied):
        out, padded = 0.0, ["s", "s", *ws]
        for i in range(2, len(padded)):
            x, y, w = padded[i - 2 : i + 1]
            p = p_me(w, c1[w] > least or (w in cut and tied))
            for hits, ctx, (a, b) in ((c2[y, w], docs if y == "s" else c1[y], lm_scoring.PRIORS[2]), (c3[x, y, w], docs if y == "s" else c2[x, y], lm_scoring.PRIORS[3])):
                mu = a * max(ctx, 1) ** b
                p = (hits + mu * p) / (ctx + mu)
            out += math.log10(p)
        return out

    by_text = {}
    for (i, t), ws in zip(odd_rows, texts, strict=True):
        by_text.setdefault(i, []).append(sorted((total(ws, True), total(ws, False))))
    for r in got:
        assert any(lo - 1e-3 <= r.score <= hi + 1e-3 for lo, hi in by_text[r.doc_id]), (r, by_text[r.doc_id])


def test_lm_beats_a_discounted_bigram(spark, small):
    """Held-out bits a token at sf0.01: below the 11.7 of an absolute-discounting bigram over the same training tokens; the base has 13.7."""
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    r = lm_scoring.score(docs, ~lm_scoring.held_out()).where("held_out").agg(F.sum("n_tokens"), F.sum("score")).first()
    assert -r[1] / r[0] / math.log10(2) < 11.5


def test_lm_packed_numbers():
    for kind, x in ((np.uint64, [0, 1, 1 << 63, 7]), (np.uint32, []), (np.uint32, list(range(1000)))):
        x = np.array(x, kind)
        assert (lm_scoring.unpacked(lm_scoring.packed(x), len(x), kind) == x).all()


def test_lm_learns_and_empty_tables(spark, small, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = lm_scoring.score(docs, ~lm_scoring.held_out()).collect()
    for held in (True, False):
        assert sum(r.score for r in got if r.held_out == held) > sum(r.base_score for r in got if r.held_out == held)
    assert lm_scoring.score(no_docs, ~lm_scoring.held_out()).count() == 0
    none = lm_scoring.score(docs, F.lit(False)).collect()
    assert all(abs(r.base_score) < 1e-6 and abs(r.score) < 1e-6 for r in none)


def test_lm_learns_from_every_training_document(spark):
    import pyarrow as pa

    texts = [f"only{i} same words here" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    t = lm_scoring.Tokens(*raw(pa.array(texts)))
    tokens, n = np.unique(t.token, return_counts=True)
    counts = spark.createDataFrame(list(zip(tokens.view(np.int64).tolist(), n.tolist(), strict=True)), "token long, count long")
    model = lm_scoring.train(docs, counts)
    for text in texts:
        t = lm_scoring.Tokens(*raw(pa.array([text])))
        assert all(model.weights[0][model.slots(f[1:2], 1)].any() for f in model.features(t, 0, len(t.token))[:1]), text


def test_lm_vocabulary_is_of_all_training_documents():
    small, large = lm_scoring.shape(10_000, 500), lm_scoring.shape(10**9, 10**6)
    assert small[0] < 3000 < large[0] and small[1] < large[1] <= lm_scoring.MOST_SLOTS


def test_lm_tells_structured_words_apart(spark):
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ k] for x in thue) for k in (0, 1))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in lm_scoring.score(docs, F.col("doc_id") == 1).collect()}
    assert got == {1: 2, 2: 1}


def test_lm_tokens_are_cut_and_lowered():
    import pyarrow as pa

    t = lm_scoring.Tokens(*raw(pa.array(["A b", None, "a b É", " "])))
    assert np.bincount(t.doc).tolist() == [3, 1, 3, 1]
    assert t.token[0] != t.token[1] and t.token[2] == lm_scoring.END and t.before[0] == lm_scoring.START


def test_language_id_held_out(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    rows = language_id.predict(docs.where(language_id.held_out()), model).select("lang_pred", "rest.lang", "score").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    by_lang = {r.lang: r.t for r in docs.where("n_chars > 1500").groupBy("lang").agg(F.min_by(F.substring("text", 100, 400), "doc_id").alias("t")).collect()}
    mixed = spark.createDataFrame([(1, by_lang["de"] + " " + by_lang["fr"])], "doc_id long, text string")
    runs = {r.lang: r.n for r in language_id.label_words(mixed, model).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert min(runs.get("de", 0), runs.get("fr", 0)) / sum(runs.values()) > 0.3


def brute_marginals(first, moves, e):
    """Word marginals from all label sequences."""
    n, k = e.shape
    out = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        p = math.exp(first[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        out[np.arange(n), y] += p
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("chain", [1, 2, 3, 64])
def test_language_marginals_are_those_of_all_sequences(monkeypatch, chain):
    monkeypatch.setattr(language_id, "CHAIN", chain)
    rng = np.random.default_rng(chain)
    texts = [" ".join(rng.choice(["ab", "cd", "xy", "q"]) for _ in range(n)) + " " for n in (1, 7, 3, 6, 2)]
    model = language_id.Crf(["a", "b", "c"], np.zeros(0, np.uint64))
    model.weights[:] = rng.normal(size=model.weights.shape)
    model.moves, model.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    f, got = language_id._marginals(model, data, np.append(0, np.cumsum([len(t) for t in texts])))
    e = model.emissions(f)
    for d in range(len(texts)):
        at = f.doc == d
        assert got[at] == pytest.approx(brute_marginals(model.first, model.moves, e[at]), abs=1e-9)


def test_html_viterbi_and_marginals_are_those_of_all_sequences():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 8):
        field = html_extraction.Field()
        field.moves, field.first, e = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(n, 2))
        assert field.marginals(e)[0] == pytest.approx(brute_marginals(field.first, field.moves, e), abs=1e-9)
        score = lambda y: field.first[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert tuple(field.viterbi(e).tolist()) == max(itertools.product((0, 1), repeat=n), key=score)


def test_language_id_odd_rows(spark, odd_docs, odd_rows, no_docs):
    model = language_id.train(odd_docs.where(~language_id.held_out()))
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == len(odd_rows)
    assert all((r.lang_pred == "und") == (not language_id.LETTER.search(r.rest.text or "")) for r in rows)
    again = {(r.doc_id, r.rest.text): (r.lang_pred, round(r.score, 9)) for r in language_id.predict(odd_docs.coalesce(1), model).collect()}
    assert all(again[r.doc_id, r.rest.text] == (r.lang_pred, round(r.score, 9)) for r in rows)  # however rows are batched
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.train(no_docs)).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


def test_html_blocks():
    page = "<title>t</title><style>p{}</style><script>var a='</p>';</script><!-- c --><p><b>One&amp;two<br>three  four</b><p>fi<i>v</i>e &copy;<div>six</div>&am"
    assert [b.text for b in html_extraction.blocks(page)] == ["One&two three four", "five ©", "six", "&am"]
    assert html_extraction.blocks("") == [] and html_extraction.blocks("<p") == []


@pytest.mark.parametrize(("page", "want"), [
    ("<p>An icon <svg/> sits here</p><p>next</p>", ["An icon sits here", "next"]),
    ("<p>a <iframe src='x'/> b</p><p>c<svg><text>no</text></svg></p>", ["a b", "c"]),
    ("<p>if <math><mi>x</mi>=<mn>2</mn></math> then <object>no viewer</object></p>", ["if x=2 then no viewer"]),
    ("<p data-x=it's>one</p><p title=\"a > b\" data-y=don't>two</p>", ["one", "two"]),
    ("<p class=a/b>one<p id='x>two</p><p>three", ["one", "two", "three"]),
    ("<noscript><p>one</p>", ["one"]),
    ("<div><b>one</div><p>two</b></p>", ["one", "two"]),
])
def test_html_odd_markup(page, want):
    assert [b.text for b in html_extraction.blocks(page)] == want


def test_html_inline_tags_close_no_blocks():
    found = html_extraction.blocks("<span><article><p>one</span> more</p><p>two</p></article></span>")
    assert [(b.text, [t for t, _ in b.path]) for b in found] == [("one more", ["span", "article", "p"]), ("two", ["span", "article", "p"])]


def test_html_depth_costs_no_more():
    for part in ("<div>x", "<span>x", "<p><b>x", "</b></i>x<i>", "<li><a>x"):
        took = []
        for n in (4000, 16000):
            began = time.perf_counter()
            assert html_extraction.blocks(part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.2, part


@pytest.fixture(scope="module")
def field():
    return html_extraction.fit()


def test_html_held_out_pages(field):
    make, wrong, n = html_extraction.Pages(123), 0, 0
    for _ in range(150):
        found, y = html_extraction.labelled(*make.page())
        if found:
            p = field.viterbi(field.emissions(html_extraction.features(found, field.cues)))
            wrong, n = wrong + int((p != y).sum()), n + len(y)
    assert wrong / n < 0.01


def test_html_short_articles(field):
    for text in ("One sentence is all there is.", "Rain fell on the town and the river rose by noon."):
        page = f"<html><head><title>x</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><article><p>{text}</p></article><footer><p>All rights reserved</p></footer></body></html>"
        assert html_extraction.extract(page, field) == text
        assert html_extraction.extract(f"<article><p>{text}</p></article>", field) == text


def test_html_layouts_that_are_not_generated(field):
    """Hand-written layouts: what is kept and what goes."""
    story = [
        "The council met on Tuesday to discuss the new bridge over the river.",
        "Several residents spoke against the plan, which would cost four million over three years.", "A vote is expected before the end of the month.",
    ]
    body = "".join(f"<p>{x}</p>" for x in story)
    pages = [
        f"<body><div id='top-nav'><a href=/>Home</a> <a href=/a>About</a></div><div class='layout'><div class='main-content'><h1>Bridge plan</h1>{body}</div><div class='sidebar'><h3>Popular</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></div></div><div id='footer'>Copyright 2020</div></body>",
        f"<body><header><h2><a href='/'>The Daily</a></h2></header><main><article><h1>Bridge plan</h1>{body}<section class='comments'><h3>Comments</h3><div class='comment'><b>Ann</b><p>I like it.</p></div></section></article></main><footer>Contact us</footer></body>",
        f"<body><div class='cookie-notice'>We use cookies to improve your experience. <button>Accept</button></div><section class='post-body'><h1>Bridge plan</h1>{body}</section><aside><p>Subscribe to our newsletter</p></aside></body>",
    ]
    for page in pages:
        assert html_extraction.extract(page, field).split("\n\n") == ["Bridge plan", *story]


def test_html_of_tables(spark, small, field):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = html_extraction.digest(html_extraction.main_text(pages)).collect()
    want = {r.page_id: "\n\n".join(b.text for b in html_extraction.blocks(r.html) if any(t == "article" for t, _ in b.path)) for r in pages.collect()}
    assert sum(r.text == want[r.page_id] for r in got) / len(got) > 0.98
    odd = spark.createDataFrame(
        [(None, None, None, 1), (1, "u", "", 2), (1, "u", "<html><body><article><p>" + "word " * 50_000 + "end.</p></article>", 3)],
        "page_id long, url string, html string, text int",
    )
    assert sorted(r.n_chars for r in html_extraction.digest(html_extraction.main_text(odd)).collect()) == [0, 0, 250_004]
    assert html_extraction.digest(html_extraction.main_text(pages.limit(0))).count() == 0
