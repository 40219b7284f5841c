"""Interval joins, exact selection, pack plans, greedy parts and resampling against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, intervals, packing, packing_plan, selection


def _intervals(rng, n):
    kinds = [lambda: 0.0, lambda: rng.random(), lambda: rng.randrange(1, 50) * 1.0, lambda: 10.0 ** rng.randrange(0, 6)]
    out = [(i, rng.choice("ab"), a := round(rng.uniform(-200, 200), 2), a + rng.choice(kinds)()) for i in range(n)]
    return [*out, (n, "a", None, 3.0), (n + 1, "b", 5.0, 4.0), (n + 2, None, 0.0, 9.0), (n + 3, "a", -0.0, 0.0)]


@pytest.mark.parametrize("on", [[], ["k"]])
def test_overlaps_against_all_pairs(spark, on):
    rng = random.Random(3)
    a, b = _intervals(rng, 150), _intervals(rng, 120)
    schema = "i long, k string, s double, e double"
    got = intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), on, ("s", "e"), ("s", "e"))
    ok = lambda r: r[2] is not None and r[2] <= r[3]
    want = [(x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and (not on or (x[1] is not None and x[1] == y[1])) and x[2] <= y[3] and y[2] <= x[3]]
    assert Counter((r.l.i, r.r.i) for r in got.collect()) == Counter(want) and len(want) > 1000
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert intervals.overlapping(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), on, ("s", "e"), ("s", "e")).count() == 0


@pytest.mark.parametrize("pairs", [1 << 22, 1000, 20])
def test_overlaps_by_as_many_tasks_as_pairs_need(spark, monkeypatch, pairs):
    """Bins of many pairs are dealt to shares, whichever side is larger; tasks follow the pairs, not the bytes of the sides; a pair of lesser levels is no candidate of a higher one."""
    monkeypatch.setattr(intervals, "PAIRS", pairs)
    a = [(i, 0.5, 0.5 + (i % 3)) for i in range(150)] + [(i, 100.0 * i, 100.0 * i + 50) for i in range(150, 160)]
    b = [(i, 0.75, 0.75) for i in range(40)] + [(i, 15000.0 + i / 100, 15100.0) for i in range(40, 300)]
    left, right = (spark.createDataFrame(x, "i long, s double, e double") for x in (a, b))
    got = intervals.overlapping(left, right, [], ("s", "e"), ("s", "e"))
    want = Counter((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
    assert Counter((r.l.i, r.r.i) for r in got.collect()) == want and len(want) > 4000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("RepartitionByExpression" in plan) == (pairs < 1 << 22) and ("_l_share" in plan) == (pairs < 1 << 22) and "whose" in plan


def test_points_with_their_first_window(spark):
    points = spark.createDataFrame([("v", 1.0), ("v", 5.0), ("w", 1.0), (None, 1.0), ("v", 1.0)], "v string, t double")
    windows = spark.createDataFrame([("v", 0.0, 2.0, 7), ("v", 1.0, 3.0, 2), ("w", 2.0, 9.0, 1)], "v string, a double, b double, n int")
    got = {(r.v, r.t): r.window.n if r.window else None for r in intervals.holding(points, windows, ["v"], "t", ("a", "b"), ["n"]).collect()}
    assert got == {("v", 1.0): 2, ("v", 5.0): None, ("w", 1.0): None, (None, 1.0): None}


@pytest.mark.parametrize("few", [1 << 16, 10, 0])
def test_selection_is_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "PARTS", 7)
    rng = random.Random(few)
    values = [0.0, -1.5, 1e300, -1e300, float("inf"), float("-inf"), 3.0, 3.0 + 2**-50]
    rows = [(i, rng.choice([*values, rng.gauss(0, 1)]), rng.randrange(4) * 1.0) for i in range(400)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "i long, x double, y double").repartition(5)
    want = sorted((r for r in rows if r[0] < 900), key=lambda r: (r[1], r[2], r[0]))
    for n in (0, 1, 37, 200, 399, 400, 1000):
        got = selection.first_n(df, [F.col("x"), F.col("y")], n, ["i"]).collect()
        assert sorted(r.i for r in got) == sorted(r[0] for r in want[:n]), n


def test_plans_fill_packs_as_the_greedy_rule_does():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randrange(1, 60)
        lengths = [rng.choice([0, 1, rng.randrange(capacity + 5), capacity]) for _ in range(rng.randrange(60))]
        want = [Counter(lengths[i] for i in pack) for pack in packing.knapsacks(lengths, capacity)]
        packs: dict[int, Counter] = {}
        for s in packing_plan.plan(Counter(lengths), capacity):
            for at in range(s.begin, s.end):
                packs.setdefault(s.pack + (at - s.begin) // s.each, Counter())[s.length] += 1
        assert [packs[p] for p in sorted(packs)] == want


@pytest.mark.parametrize("salt", [1 << 20, 3])
def test_packed_table(spark, monkeypatch, salt):
    monkeypatch.setattr(packing_plan, "SALT_ROWS", salt)
    rng = random.Random(6)
    rows = [(i, rng.choice([4, 4, 4, rng.randrange(30)])) for i in range(200)] + [(999, None), (998, -1), (997, 1000), (5, 7)]
    got = packing_plan.packed_table(spark.createDataFrame(rows, "k long, n int"), "k", "n", 25).collect()
    assert Counter((r.k, r.n) for r in got) == Counter((k, n) for k, n in rows if n is not None and 0 <= n <= 25)
    for p in {r.pack for r in got}:
        own = sorted((r for r in got if r.pack == p), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and [r.offset for r in own] == [sum(x.n for x in own[:i]) for i in range(len(own))] and sum(r.n for r in own) <= 25
    empty = packing_plan.packed_table(spark.createDataFrame([], "k long, n int"), "k", "n", 25)
    assert empty.count() == 0


def test_packed_rows(spark):
    rows = [(i, list(range(100 * i, 100 * i + n)), [-i] * n) for i, n in enumerate([3, 2, 1, 5])]
    got = {r.pack: r for r in packing_plan.packed_rows(spark.createDataFrame(rows, "k long, ids array<int>, labels array<int>"), "k", "ids", "labels", 6, 0).collect()}
    assert got[0].input_ids == [300, 301, 302, 303, 304, 200] and got[0].position_ids == [0, 1, 2, 3, 4, 0] and got[0].attention == [1] * 5 + [2] and got[0].labels == [-3] * 5 + [-2]
    assert got[1].input_ids == [0, 1, 2, 100, 101, 0] and got[1].labels == [0, 0, 0, -1, -1, -100] and got[1].attention == [1, 1, 1, 2, 2, 0]


def test_greedy_parts():
    assert packing.greedy([5, 4, 3, 3, 3], 2) == [[0, 3], [1, 2, 4]] and packing.greedy([], 2) == [[], []] and packing.greedy([1, 1, 1], 2) == [[0, 2], [1]]
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.randrange(1, 40) for _ in range(24)]
        for equal in (False, True):
            sums, want, bias = [0] * 4, [[] for _ in range(4)], (sum(lengths) + 1) * equal
            for i, n in enumerate(lengths):
                j = sums.index(min(sums))
                want[j].append(i)
                sums[j] += n + bias
            assert packing.greedy(lengths, 4, equal) == want
    with pytest.raises(ValueError, match="multiple"):
        packing.greedy([1, 2, 3], 2, equal=True)


def test_differencing_of_documents(spark, small):
    """A recorded result: least and greatest sums of the parts of each batch, which differ by less than the longest document."""
    from tessera.catalog import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "n_chars")
    got = QUERIES["balance_sequences"](spark, small).join(docs, "doc_id").groupBy("batch", "part").agg(F.sum("n_chars").alias("s")).groupBy("batch").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n")).collect()
    assert [(r.batch, r.lo, r.hi, r.n) for r in got] == BALANCED


BALANCED = [(0, 60635, 60637, 8)]


def test_resampling_is_the_same_on_any_partitioning(spark):
    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], rng.gauss(3, 2)) for i in range(600)] + [(1000, "c", 5.0), (1001, "a", None)]
    df = spark.createDataFrame(rows, "i long, k string, v double")
    one, many = (sorted(map(tuple, aggregates.poisson_bootstrap(df.repartition(n), ["k"], F.col("i"), "v", 400).collect())) for n in (1, 7))
    assert [r[0] for r in one] == ["a", "b", "c"] and all(x[1:] == pytest.approx(y[1:]) for x, y in zip(one, many, strict=True))
    assert one[0][2] == pytest.approx(2 / 300**0.5, rel=0.2) and one[2][1:] == pytest.approx((5.0, 0.0))


def test_bootstrap_against_resampling(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 3) for _ in range(12)]
    row = aggregates.bootstrap_of(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v", 3).first()
    draws = [[rng.choice(values) for _ in range(3)] for _ in range(40000)]
    for f, mean, std in ((max, row.best, row.best_std), (min, row.worst, row.worst_std), (lambda d: sum(d) / 3, row.mean, row.mean_std)):
        x = [f(d) for d in draws]
        m = sum(x) / len(x)
        assert m == pytest.approx(mean, abs=0.06) and (sum((y - m) ** 2 for y in x) / len(x)) ** 0.5 == pytest.approx(std, abs=0.06)
