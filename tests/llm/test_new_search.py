"""Token alignment, ranked lexical search and URL filters."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical_search, token_alignment, url_filter


def fresh(aligner=[]):  # noqa: B006
    aligner[:] = aligner or [token_alignment.Aligner.read().ready()]
    return aligner[0]


def bytes_and_offsets(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(b) for b in data])).astype(np.int64)


ALPHABET = list(" \t\n\r\x0b   \x1c\x85\u00a0\u3000ab.,'s{}();<>\\éà日5🤗")


def test_segments_tokenise_as_whole_texts():
    x, rng = fresh(), random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["it's  don't 'll x", "<|endoftext|> </s> <0x0A> <unk>", "x\r\n y", "\nstart", " ", "\n", "  two"]
    for t in texts:
        segments = x.segments(*bytes_and_offsets([t]))[0].to_pylist()
        assert "".join(segments) == " " + t
        a, b = x.encode(segments)
        assert sum(a, []) == x.a.encode(" " + t, add_special_tokens=False).ids and sum(b, []) == x.b.encode(t), repr(t)


def test_carriage_returns_are_no_cuts_as_the_second_vocabulary_joins_them():
    x = fresh()
    assert x.segments(*bytes_and_offsets(["a;\r\nb c"]))[0].to_pylist() == [" a;\r\nb", " c"]
    assert b";\r" in x.b_entries and not x.cut[13] and x.cut[32] and x.cut[10]


def test_alignment_against_brute_force(spark, odd_docs, odd_rows, no_docs):
    more = [(900, "mark ▁ here and more"), (901, "more and here"), (902, "▁"), (903, "a  b\r\n c\n\nd\u00a0e f " * 40), (904, "\n\n x")]
    rows = odd_rows + more
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    got = token_alignment.align(docs, token_alignment.send(spark))
    assert Counter(tuple(r) for r in got.collect()) == Counter(token_alignment.brute(rows))
    assert got.where("doc_id in (900, 902)").agg(F.sum("n_a"), F.max("groups_sha256")).first()[:] == (0, "")
    assert got.where("n_best < n_links and n_best > 0 and n_groups < n_a").count() > 0
    assert token_alignment.align(no_docs, token_alignment.send(spark)).count() == 0


def test_alignment_in_several_blocks(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 2000)
    got = token_alignment.align(odd_docs, token_alignment.send(spark)).collect()
    assert Counter(tuple(r) for r in got) == Counter(token_alignment.brute(odd_rows))


@pytest.mark.parametrize(("block", "shard"), [(4096, 1 << 20), (2, 50)])
def test_search_against_brute_force(spark, odd_docs, odd_rows, no_docs, monkeypatch, block, shard):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SHARD_TERMS", shard)
    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}" for _ in range(30)]
    items = [(1, " ".join(words)), (2, "same SAME w1"), (3, ""), (4, None), (5, "nowhere-at-all"), (6, odd_rows[7][1]), (7, "é日本語 日本語"), (2, "same SAME w1"), (2, "one two")]
    df = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, score string, rank int")
    got = lexical_search.search(odd_docs, df, k=7)
    want = lexical_search.brute(odd_rows, [i for i in items if i[1] is not None], k=7)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want) and len(want) > 20
    assert lexical_search.search(no_docs, df).count() == 0 and lexical_search.search(odd_docs, df.limit(0)).count() == 0


def test_search_keeps_item_ids_as_they_are(spark, odd_docs):
    got = lexical_search.search(odd_docs, spark.createDataFrame([("gsm-1", "one"), (None, "two words")], "item_id string, text string")).collect()
    assert {r.item_id for r in got} == {"gsm-1", None}


def test_wand_skips_what_cannot_reach_the_heap():
    """A bar that only one rare term reaches: documents without it are passed over, unread."""
    class Read(list):
        seen = 0

        def __getitem__(self, i):
            Read.seen += isinstance(i, int)
            return list.__getitem__(self, i)

    n = 10000
    text, term = np.append(np.arange(n), [50, 9000]), np.append(np.zeros(n, np.int64), [1, 1])
    shard = lexical_search.Shard(text, term, np.append(np.ones(n, np.int64), [100, 90]))
    shard.of = {t: (Read(p), Read(a), m) for t, (p, a, m) in shard.of.items()}
    heap = [(95, -20000)]
    lexical_search.wand(shard, [(0, 1), (1, 1)], list(range(n)), heap, 1)
    assert heap == [(101, -50)] and Read.seen < 60


def test_wand_against_all_scores():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 60)
        cells = sorted({(rng.randrange(n), rng.randrange(6)) for _ in range(rng.randrange(1, 150))})
        added = [rng.choice([0, 1, 2, 5, 9]) for _ in cells]
        query = [(t, rng.randrange(1, 3)) for t in range(6) if rng.random() < 0.7]
        ids = [rng.randrange(30) for _ in range(n)]
        heap = []
        lexical_search.wand(lexical_search.Shard(*map(np.array, (*zip(*cells), added))), query, ids, heap, 4)
        total = Counter()
        for (d, t), a in zip(cells, added):
            total[d] += a * dict(query).get(t, 0)
        assert sorted(heap, reverse=True) == sorted(((s, -ids[d]) for d, s in total.items() if s > 0), reverse=True)[:4]


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def judged(spark, pages, labels, rules=RULES, **more):
    p = spark.createDataFrame([(*r, "x", 2) for r in pages], "page_id long, url string, rule string, n int")
    of = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, bad boolean, host string")
    rules = url_filter.rules_table(spark, rules) if rules else spark.createDataFrame([], "rule string, verdict string")
    return url_filter.judge(p, of, rules, **more)


def test_rules_of_urls(spark):
    cases = {
        "http://a.b.NET/x": ("a.b.net", "/x", "net/", "block"), "https://net/": ("net", "/", "net/", "block"), "https://net": ("net", "", None, "allow"), "http://notnet/": ("notnet", "/", None, "allow"),
        "http://M.Example.net/en/1?q=://z": ("m.example.net", "/en/1", "example.net/en/", "allow"), "http://example.net/En/1": ("example.net", "/En/1", "net/", "block"),
        "x://example.com/de/#f": ("example.com", "/de/", "example.com/de/", "block"), "x://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "x://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
        "x://a.org?/fr/": ("a.org", "", None, "allow"), "no scheme.net/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "http://a.net:80/": ("a.net:80", "/", None, "allow"), "http://\u0130.org/fr/": ("\u0130.org", "/fr/", "org/fr/", "allow"), "http://a.net./": ("a.net.", "/", None, "allow"),
        "u://net/a\nb?c": ("net", "/a\nb", "net/", "block"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
    }
    got = judged(spark, [*enumerate(cases), (None, "http://a.net/"), (0, "http://a.b.NET/x")], []).collect()
    want = [(i, *v) for i, v in enumerate(cases.values())] + [(None, "a.net", "/", "net/", "block"), (0, *cases["http://a.b.NET/x"])]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)


def test_longest_rule_wins_and_odd_rules(spark):
    rules = (("b.net/", "block"), ("net/en", "allow"), ("net/en", "block"), ("/x", "block"), ("c.org", "block"), ("c.org/ok", "allow"), ("d.org", "maybe"))
    got = {r.page_id: (r.rule, r.verdict) for r in judged(spark, [(1, "x://b.net/en"), (2, "x://c.net/en"), (3, "x:///x"), (4, "x://a.c.org"), (5, "x://c.org/ok/1"), (6, "x://d.org/")], [], rules).collect()}
    assert got == {1: ("b.net/", "block"), 2: ("net/en", "block"), 3: (None, "allow"), 4: ("c.org", "block"), 5: ("c.org/ok", "allow"), 6: (None, "allow")}


def test_reputation(spark):
    """A bad host of a clean domain is blocked on enough labels only; a new host of a bad domain follows the domain."""
    pages, labels = [], []

    def add(host, n, bad):
        for i in range(n):
            labels.append((len(pages), i < bad))
            pages.append((len(pages), f"http://{host}/{i}"))

    for h in range(30):
        add(f"h{h}.good.org", 20, h % 2)
    add("evil.good.org", 40, 38)
    add("once.good.org", 1, 1)
    for h in range(12):
        add(f"h{h}.spam.co.uk", 15, 14 if h % 4 else 15)
    pages.append((len(pages), "http://new.spam.co.uk/"))
    pages.append((len(pages), "http://new.fine.org/"))
    got = judged(spark, pages, [*labels, *labels[:50], (None, True), (10**6, True), (3, None)], ()).groupBy("host").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("most"), F.first("n_labels").alias("n"), F.first("bound").alias("bound"))
    by = {r.host: r for r in got.collect()}
    assert all(r.verdict == r.most for r in by.values())
    blocked = {h for h, r in by.items() if r.verdict == "block"}
    assert blocked == {"evil.good.org", "new.spam.co.uk", *(f"h{h}.spam.co.uk" for h in range(12))}
    assert by["h0.good.org"].n == 20 and by["once.good.org"].bound < by["evil.good.org"].bound


def test_reputation_is_the_shrunk_rate(spark):
    """The bounds of all hosts against the definition."""
    rng, hosts = random.Random(6), []
    for d in ("a.com", "b.com", "c.org", "d.co.uk", "10.0.0.1", "[::1]"):
        hosts += [(f"h{i}.{d}" if d[0].isalpha() else d, n := rng.randrange(0, 30), rng.randrange(n + 1)) for i in range(5 if d[0].isalpha() else 1)]
    got = {r.host: r.bound for r in url_filter.reputations(spark.createDataFrame(hosts, "host string, n long, y long")).collect()}

    def shrunk(rows):  # (n, y, m)
        over, pairs = sum((y - n * m) ** 2 - n * m * (1 - m) for n, y, m in rows), sum(n * (n - 1) * m * (1 - m) for n, _, m in rows)
        k = 1 / min(0.25, max(0.001, round(over / pairs if pairs > 0 else 0, 6))) - 1
        return [((k * m + y) / (k + n), k + n) for n, y, m in rows]

    dom = {h: h if not h[0] == "h" else ".".join(h.split(".")[1:]) for h, _, _ in hosts}
    suf = {d: "" if d[0] in "1[" else d[2:] for d in dom.values()}
    add = lambda f: {g: (sum(n for h, n, _ in hosts if f(h) == g), sum(y for h, _, y in hosts if f(h) == g)) for g in {f(h) for h, _, _ in hosts}}
    by_d, by_s = add(lambda h: dom[h]), add(lambda h: suf[dom[h]])
    p = sum(y for _, _, y in hosts) / sum(n for _, n, _ in hosts)
    s = dict(zip(by_s, (r for r, _ in shrunk([(*v, p) for v in by_s.values()]))))
    d = dict(zip(by_d, (r for r, _ in shrunk([(*v, s[suf[k]]) for k, v in by_d.items()]))))
    for (h, *_), (m, w) in zip(hosts, shrunk([(n, y, d[dom[h]]) for h, n, y in hosts])):
        assert got[h] == pytest.approx(m - 1.645 * (m * (1 - m) / (w + 1)) ** 0.5, abs=1e-9)


def test_url_filter_of_empty_tables(spark):
    assert judged(spark, [], [(1, True)]).count() == 0
    assert judged(spark, [(1, "http://a.net/"), (2, "http://a.org/")], []).where("verdict = 'block'").count() == 1


def test_url_filter_runs_without_python(spark, small):
    from tessera.llm.queries import op13_url_filter

    plan = op13_url_filter(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
