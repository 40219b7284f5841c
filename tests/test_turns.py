"""Estimators over turns: copies of rows count once and get what their first row gets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import advantages as A
from tessera.operators import turns as U

SCHEMA = "group string, traj string, turn int, position long, step double, answer double, outcome double, state double, valid boolean, rewards array<double>, values array<double>, mask array<double>, advantage double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for g in ("a", "b", "c", None):
        for t in range(1 if g == "c" else 4):
            for u in range(rng.randrange(1, 5)):
                n = rng.randrange(1, 4)
                out.append((g, f"t{t}", u, len(out), rng.random(), rng.choice([0.0, 1.0]), rng.random(), rng.random(), rng.random() < 0.85, [rng.random() for _ in range(n)], [rng.random() for _ in range(n)], [float(rng.random() < 0.8) for _ in range(n)], -7.0))
    return out


def added(spark, name, data, **options):
    out = A.advantage(name, spark.createDataFrame(data, SCHEMA), **options)
    new = [c for c in ("advantage", "advantages", "returns", "traj_score", "turn_reward", "signal_valid", "reward", "update_valid") if c in out.columns]
    return {r.position: tuple(tuple(x) if isinstance(x, list) else x for x in (r[c] for c in new)) for r in out.collect()}


CASES = {
    "trajectory": {"score": "outcome"}, "trajectory_sum": {"answer": "answer", "valid": "valid"}, "component": {"answer": "answer", "valid": "valid"}, "mixed": {}, "step_gae": {"gamma": 0.9, "lam": 0.8},
    "two_level_gae": {"gamma": 0.9, "lam": 0.8},
}


def near(a, b):
    return all(x == y or (isinstance(x, tuple) and x == pytest.approx(y, abs=1e-9)) or x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(CASES))
def test_copies_change_nothing(spark, rows, name):
    """Copies come later with other values, as padding leaves them; they and their first rows get the same."""
    before = added(spark, name, rows, **CASES[name])
    assert sorted(before) == [r[3] for r in rows]
    copies = [(*r[:3], r[3] + 1000 * k, 99.0, 99.0, 99.0, 99.0, False, [9.0], [9.0], [1.0], -7.0) for r in rows[::3] for k in (1, 2)]
    after = added(spark, name, copies[::-1] + rows, **CASES[name])
    assert len(after) == len(rows) + len(copies)
    assert all(near(after[p], before[p % 1000]) for p in after)


@pytest.mark.parametrize("name", sorted(CASES))
def test_empty_tables_and_odd_scores(spark, rows, name):
    assert added(spark, name, [], **CASES[name]) == {}
    odd = [(*r[:4], *(x if i % 4 else bad for i, x in enumerate(r[4:8])), *r[8:]) for r, bad in zip(rows, [None, math.nan, math.inf, -math.inf] * 20, strict=False)]
    plain = [(*r[:4], *(x if i % 4 else 0.0 for i, x in enumerate(r[4:8])), *r[8:]) for r in rows]
    a, b = added(spark, name, odd, **CASES[name]), added(spark, name, plain, **CASES[name])
    assert all(near(a[p], b[p]) for p in b)


def test_trajectory_sum_by_hand(spark):
    data = [("a", t, u, i, s, 0.0, 0.0, 0.0, v, None, None, None, None) for i, (t, u, s, v) in enumerate([("x", 0, 1.0, True), ("x", 0, 50.0, True), ("x", 1, 2.0, True), ("y", 0, 5.0, True), ("z", 0, 100.0, False)])]
    got = {r.position: r for r in A.advantage("trajectory_sum", spark.createDataFrame(data, SCHEMA), valid="valid", by_std=False).collect()}
    assert [got[i].traj_score for i in range(5)] == [3, 3, 3, 5, 0] and [got[i].advantage for i in range(5)] == [-1, -1, -1, 1, 0]
    assert [got[i].turn_reward for i in range(5)] == [1, 1, 2, 5, 100] and [got[i].traj_valid for i in range(5)] == [True] * 4 + [False]


def test_credit_runs_back_and_is_void_before_an_invalid_turn(spark):
    data = [("a", "x", u, u, 0.0, 1.0, 0.0, 0.0, u != 1, None, None, None, None) for u in range(4)]
    got = sorted(U.credits(spark.createDataFrame(data, SCHEMA), valid="valid", beta=0.5).collect(), key=lambda r: r.turn)
    assert [r.credit for r in got] == [1.875, 1.75, 1.5, 1.0] and [r.credit_valid for r in got] == [False, False, True, True]


def test_group_filter_takes_first_rows(spark):
    data = [("a", "x", 0, 5, 9.0), ("a", "x", 0, 1, 1.0), ("a", "y", 0, 2, 1.0), ("b", "x", 0, 3, 1.0), ("b", "y", 0, 4, 3.0), (None, "x", 0, 6, 0.0), (None, "y", 0, 7, 2.0)]
    df = spark.createDataFrame(data, "group string, traj string, turn int, position long, m double")
    assert {r.position for r in U.group_filter(df, "m", least_std=0.5).collect()} == {3, 4, 6, 7}


def test_judge_failures(spark):
    got = spark.createDataFrame([("ok",), (" Error ",), ("ABORTED",), (None,), ("",)], "s string").select(U.judge_valid(F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, False, True, True]
