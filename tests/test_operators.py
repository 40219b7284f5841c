"""Operators whose results SQL doesn't give: properties and plain Python versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.functions import scorers as S
from tessera.functions import text as T
from tessera.operators import aggregates, ordered, packing, relational, sampling
from tessera.operators import annotations as A
from tessera.operators import conversations as C


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_first_failing_reason_of_each_kind(spark):
    def video(secs, answers, asked=0.0, options=("a", "b")):
        return (secs, 1.0, [("q", asked, list(options), [(t, "x") for t in answers])])

    rows = {
        "kept": video(60.0, [25.0, 40.0]), "duplicate_options": video(60.0, [25.0], options=("A. x", " X ")), "missing_answer_events": video(60.0, []),
        "original_video_too_short": video(19.9, [15.0]), "query_after_max_cutoff": video(200.0, [150.0], 120.0), "first_answer_after_max_cutoff": video(200.0, [150.0], 10.0),
        "answer_gap_too_small": video(60.0, [25.0, 31.0]), "final_video_too_short": video(60.0, [5.0]), "missing_query_time": (
            60.0, 1.0, [("q", None, ["a"], [(30.0, "x")])],
        ), "missing_query_events": (60.0, 1.0, []),
    }
    schema = "want string, video_seconds double, fps double, query_events array<struct<qid:string,time:double,options:array<string>,answer_events:array<struct<time:double,gt:string>>>>"
    got = A.first_failing_reason(spark.createDataFrame([(k, *v) for k, v in rows.items()], schema)).collect()
    assert {r.want: r.reason for r in got} == {k: k for k in rows}
    assert [r.end_seconds for r in got if r.want == "kept"] == [40]
    cut = A.first_failing_reason(spark.createDataFrame([("x", *video(150.0, [30.0, 100.0, 130.0]))], schema)).first()
    assert cut.reason == "kept" and [a.time for q in cut.query_events for a in q.answer_events] == [30, 100]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.option_text(lit("  B.  Red   Car "))) == "red car"
    assert one(spark, T.answer_text(lit("Option (B) yes."))) == "option (b) yes"
    assert one(spark, T.answer_text(lit("b) Yes 。"))) == "yes"
    assert one(spark, T.exact_match_text(lit("The Cat, a dog!"))) == "cat dog"
    assert [one(spark, T.choice(lit(x))) for x in ("C", "it is (b)", "number 3", "none", "xAy")] == ["C", "B", "C", None, None]
    assert [one(spark, T.yes_no(lit(x))) for x in ("Yes.", "no, no", "yes and no", "nothing", "y")] == ["YES", "NO", None, None, "YES"]
    assert one(spark, T.last_answer_tag(lit("<answer>1</answer> <answer> 2\n</answer>"))) == "2"
    assert one(spark, T.hash_answer(lit("so #### 1,234"))) == "1234" and one(spark, T.hash_answer(lit("x 5 then 7"), False)) == "7"
    assert one(spark, T.filled("a {{x}} {{y}} {{x}}", x=lit("1$"), y=lit("2\\"))) == "a 1$ 2\\ {{x}}"
    assert one(spark, T.natural_key(lit("a10b2"))) > one(spark, T.natural_key(lit("a9b30")))
    assert one(spark, T.ground_truth_letter(lit("1"), F.array(lit("x"), lit("y")))) == "B" and one(spark, T.ground_truth_letter(lit("y"), F.array(lit("x"), lit("y")))) == "B"
    assert one(spark, T.preview(lit("a  b" * 100), 10)).endswith("...")
    assert one(spark, R.clock_seconds(lit("1:02:03"))) == 3723 and one(spark, R.clock_seconds(lit("x"))) is None


def test_scorers(spark):
    lit = F.lit
    assert [one(spark, S.SCORERS[n](lit(a), lit(g), None)) for n, a, g in (("exact", "A. red", "red"), ("contains", "a red car", "red"), ("mcq", "B", "b"), ("count", "1 and 2", "12"), ("em", "the cat", "Cat"), ("subem", "big cat", "cat"), ("yes_no", "yes", "Y"))] == [1.0] * 7
    assert one(spark, S.token_f1(lit("a a b"), lit("a b c"))) == pytest.approx(2 / 3)
    assert one(spark, S.score_event(lit(" "), lit("x"), lit(False))) == 1 and one(spark, S.score_event(lit("y"), lit("x"), lit(False))) == 0
    assert [one(spark, S.difficulty(lit(x).cast("double"))) for x in (1.0, 0.67, 0.34, 0.1, None)] == ["easy", "medium", "hard", "unsolved", "unscored"]


def test_greedy_folds(spark):
    rng = random.Random(1)
    times = sorted(round(rng.uniform(0, 100), 1) for _ in range(60))
    kept = []
    for t in times:
        if not kept or t - kept[-1] >= 7:
            kept.append(t)
    assert one(spark, ordered.thinned(F.array(*map(F.lit, times)), 7.0)) == kept
    items = [(round(rng.random(), 2), float(i)) for i in range(40)]
    chosen = []
    for _, at in sorted(items, key=lambda x: (-x[0], x[1])):
        if len(chosen) < 6 and all(abs(at - c) >= 5 for c in chosen):
            chosen.append(at)
    arr = F.array(*(F.struct(F.lit(a).alias("score"), F.lit(b).alias("at")) for a, b in items))
    assert one(spark, ordered.spread_best(arr, 5.0, 6)) == sorted(chosen)


def test_as_of_ties_and_missing(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 2, "b"), (3, 1, "c")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in ordered.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {(1, 5): "a", (1, 1): None, (2, 9): None, (None, 3): None}
    assert {(r.k, r.t): r.v for r in ordered.as_of(left, right, ["k"], "t", "u", ["v"], strict=True).collect()}[1, 5] == "b"


def test_sampling_properties(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    chosen = sampling.whole_groups(df, "g", 300, "s").where("chosen")
    assert chosen.count() <= 300 and chosen.count() >= 280
    assert sampling.resampled(df, 2500, "s", ["id"]).groupBy("id").count().agg(F.min("count"), F.max("count"), F.sum("count")).first() == (2, 3, 2500)
    split = sampling.split_counts(df, ["g"], "s", ["id"], 50, 20).groupBy("g", "split").count().where("split is not null").collect()
    assert {(r.split, r["count"]) for r in split} == {("train", 50), ("val", 20)}


def test_packing(spark):
    rng = random.Random(2)
    lengths = [rng.randrange(1, 120) for _ in range(200)]
    packs = packing.knapsacks(lengths, 100)
    assert sorted(i for p in packs for i in p) == [i for i, n in enumerate(lengths) if n <= 100] and all(sum(lengths[i] for i in p) <= 100 for p in packs)
    for equal in (False, True):
        parts = packing.karmarkar_karp(lengths, 8, equal)
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(200)) and max(sums) - min(sums) <= 120
        assert not equal or {len(p) for p in parts} == {25}
    with pytest.raises(ValueError, match="multiple"):
        packing.karmarkar_karp([1, 2, 3], 2, True)
    assert packing.karmarkar_karp([], 3) == [[], [], []] and packing.small_at_both_ends([5, 1, 3]) == [1, 0, 2]


def test_conversations(spark):
    rows = [(1, [("system", "s"), ("user", "a"), ("assistant", "b")]), (2, [("user", "a")]), (3, [("assistant", "a"), ("user", "b")]), (4, [])]
    df = spark.createDataFrame(rows, f"id int, messages {C.MESSAGES}")
    got = {r.id: (len(r._prompt), len(r._response), r._system) for r in C.sharegpt(df).collect()}
    assert got == {1: (1, 1, "s"), 2: (0, 0, ""), 3: (0, 0, ""), 4: (0, 0, "")} and C.valid_examples(C.sharegpt(df)).count() == 1
    tools = [[("user", "q"), ("tool", "1"), ("tool", "2"), ("assistant", "a"), ("tool", "3")]]
    merged = spark.createDataFrame([(x,) for x in tools], f"m {C.MESSAGES}").select(C.merged_tools(F.col("m")).alias("x")).first().x
    assert [tuple(m) for m in merged] == [("user", "q"), ("tool", "1\n2"), ("assistant", "a"), ("tool", "3")]
    back = df.where("id = 1").select(C.from_chatml(C.chatml(F.col("messages"))).alias("x")).first().x
    assert [tuple(m) for m in back] == rows[0][1]


def test_zipped_columns_must_agree(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert relational.zipped(a, a.withColumn("w", F.lit(1)), ["k"]).collect()[0].asDict() == {"k": 1, "v": 2, "w": 1}
    with pytest.raises(Exception, match="column v differs"):
        relational.zipped(a, a.withColumn("v", F.lit(3)), ["k"]).collect()


def test_positions_are_global(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x")).repartition(7)
    got = relational.with_position(df, ["x"]).collect()
    assert all(r.x == r.position for r in got) and len(got) == 500


def test_expected_best_is_the_bootstrap_limit(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 4, 9)], "k string, v double")
    row = aggregates.best_and_worst_of(df, ["k"], "v", 2).first()
    draws = [(a, b) for a in (1, 4, 9) for b in (1, 4, 9)]
    assert row.best == pytest.approx(sum(map(max, draws)) / 9) and row.worst == pytest.approx(sum(map(min, draws)) / 9)


def test_judging():
    from tessera.functions import judging as J
    from tessera.functions import mathematics as X

    assert J.same_answer("The red car turned left at the corner.", "the red car turned left at the corner")
    assert J.same_answer("A vehicle is moving outside in the snow", "cars in motion outdoors, snowing")
    assert not J.same_answer("I cannot answer", "a red car") and not J.same_answer("red car", "blue car") and not J.same_answer("", "x")
    assert J.boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\frac{1}{2}" and J.boxed("\\boxed 7$") == "7" and J.boxed("no") is None and J.boxed("\\boxed{1") is None
    for a, b in (("0.5", "\\frac12"), ("x = 3", "3"), ("1,000", "1000"), ("\\dfrac{3}{4}", "3/4"), ("50\\%", "50"), ("2.50", "5/2")):
        assert X.same_math(a, b), (a, b)
    assert not X.same_math("1", "2") and not X.same_math("", "") and not X.same_math("a", "b")
    assert J.first_json('x ```json {"b": [1, {"a": null}]} ``` {') == '{"b":[1,{"a":null}]}' and J.first_json("none [") is None
    assert [J.verdict(x) for x in ('{"correct": true}', '{"score": 0.4}', '{"is_correct": "no"}', "[1]", None)] == [True, False, False, None, None]
    calls = '[{"name": "f", "parameters": {"a": 1, "b": 2}}]'
    assert J.call_likeness(calls, calls) == 3 and J.call_likeness("nonsense", calls) == -3 and -3 < J.call_likeness(calls.replace("2", "3"), calls) < 3
    assert J.bleu4("a b c d", "a b c d") == pytest.approx(1) and J.rouge_l("a b c", "a x c") == pytest.approx(2 / 3) and J.bleu4("", "a") == 0


def test_timeline(spark):
    from tessera.operators import timeline as L

    gaps = one(spark, L.complement(F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end")), F.struct(F.lit(2.0).alias("start"), F.lit(3.0).alias("end"))), F.lit(0), F.lit(5)))
    assert [tuple(g) for g in gaps] == [(0, 1), (3, 5)]
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, L.history_frames(ids(9, 1), ids(1, 2, 3, 9), 3)) == [1, 3, 9] and one(spark, L.history_frames(ids(1, 2, 3, 4), ids(5), 3)) == [1, 2, 3]
    assert one(spark, L.around(F.array().cast("array<int>"), F.lit(1), F.lit(0), F.lit(9))) == [0, 1, 2, 3]


def test_rejection_masks(spark):
    from tessera.operators import metrics as M

    a, b, m = (F.array(*map(F.lit, x)) for x in ([0.0, 1.0], [0.0, -1.0], [1.0, 1.0]))
    got = {k: one(spark, M.rejection_mask(a, b, m, k, -1.0, 1.0)) for k in ("token_k1", "token_k2", "token_k3", "seq_sum", "seq_mean", "seq_max")}
    assert got == {"token_k1": [1, 0], "token_k2": [1, 0], "token_k3": [1, 0], "seq_sum": [0, 0], "seq_mean": [1, 1], "seq_max": [0, 0]}


def test_step_reward_values(spark):
    from tessera.operators import advantages as V

    lit = F.lit
    assert one(spark, V.step_reward(lit(0.5), lit(1.0), lit(0.0))) == pytest.approx(0.6) and one(spark, V.step_reward(lit(2.0), lit(1.0), lit(0.0))) == pytest.approx(2.1)
    kl = V.AdaptiveKl(0.1, 1.0, 100)
    assert kl.update(3.0, 10) == pytest.approx(0.102) and kl.update(0.0, 10) == pytest.approx(0.102 * 0.98)


def test_openai_messages(spark):
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
    rows = [
        (
            1,
            [("system", "s", None), ("user", "q", None), ("assistant", None, [("f", "{}")]), ("tool", "1", None), ("tool", "2", None), ("assistant", "a", None)],
        ),
        (2, [("assistant", "a", None), ("user", "q", None)]), (3, []),
    ]
    got = {r.id: r for r in C.openai(spark.createDataFrame(rows, f"id int, messages {kind}")).collect()}
    assert [m.role for m in got[1]._prompt] == ["user", "function", "observation"] and got[1]._prompt[2].content == "1\n</tool_response>\n<tool_response>\n2" and got[1]._system == "s"
    assert not got[2]._prompt and not got[3]._response


def test_padding_and_overlap(spark):
    df = spark.range(3)
    assert relational.padded(df, ["id"], 8).count() == 8 and relational.padded(df, ["id"], 3).where("padding").count() == 0 and relational.padded(df.limit(0), ["id"], 4).count() == 0
    assert [r.id for r in relational.disjoint(df, spark.range(2, 9), ["id"]).collect()] == [2]


def test_tool_dialects(spark):
    from tessera.functions import tools as X

    calls = F.array(F.struct(F.lit("f").alias("name"), F.lit('{"a":1}').alias("arguments")), F.struct(F.lit("g_2").alias("name"), F.lit('{"b":[1,2]}').alias("arguments")))
    want = [("f", '{"a":1}'), ("g_2", '{"b":[1,2]}')]
    for d in ("action", "tagged", "listed", "array"):  # arguments stay as they are written
        assert [tuple(c) for c in one(spark, X.read(X.written(calls, d), d))] == want, d
    for d in X.DIALECTS:  # the others keep their values; one of them holds one call only
        got = [(c.name, json.loads(c.arguments)) for c in one(spark, X.read(X.written(calls, d), d))]
        assert got == [(n, json.loads(a)) for n, a in want[: 1 if d == "two_lines" else 2]], d
        assert one(spark, X.read(F.lit("just text"), d)) is None
    assert one(spark, X.read(F.lit("Action: f\nAction Input: {oops"), "action")) is None
    ok = "<think>x</think>\n<tool_call>\n{}\n</tool_call>"
    assert one(spark, X.format_reward(F.lit(ok), F.lit(True), F.lit(False))) == 1 and one(spark, X.format_reward(F.lit(ok), F.lit(False), F.lit(True))) == 0


def test_balanced_groups_keep_groups_together(spark):
    from tessera.shipping import ship

    ship(spark)
    df = spark.range(240).select(F.col("id"), F.floor(F.col("id") / 5).alias("g"), (F.col("id") % 37 + 1).alias("n"))
    got = packing.balanced_groups(df, "id", "g", "n", F.lit(0), 8).collect()
    assert len(got) == 240 and {len({r.part for r in got if r.g == g}) for g in range(48)} == {1}
    assert {sum(r.part == p for r in got) for p in range(8)} == {30}
    assert one(spark, packing.padded_batch(F.array(F.lit(1), F.lit(2)), 4, 0)) == [1, 2, 0, 0] and one(spark, packing.padded_batch(F.array(F.lit(1), F.lit(2), F.lit(3)), 2, 0, True)) == [1, 2]
