"""Errors and edge cases of parts whose results the queries hold against SQL."""

import pytest
from pyspark.sql import functions as F

from tessera import plugins
from tessera.functions import judges, mathematics, templates, tools
from tessera.operators import batches, canonical, ordered, sampling
from tessera.sources import folders


def test_registries_and_paths():
    r = plugins.Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError, match="there is a thing named a"):
        r.register("a")(2)
    with pytest.raises(ValueError, match="no thing named b; there are a"):
        r.find("b")
    assert plugins.loaded("tessera.functions.mathematics:same_math") is mathematics.same_math
    for bad in ("nothing", "tessera.functions.mathematics:", "tessera.functions.mathematics:UNITS"):
        with pytest.raises(ValueError):
            plugins.loaded(bad)
    with pytest.raises(ValueError, match="exists"):
        templates.register("llama3", templates.TEMPLATES["yi"])
    with pytest.raises(ValueError, match="there is a dialect"):
        tools.register("qwen", tools.DIALECTS["action"])
    assert set(tools.FAMILIES.values()) == set(tools.DIALECTS)


def test_batches_and_columns(spark):
    assert batches.micro_batches([5, 5, 5, 5], 10) and batches.micro_batches([], 10, least=0) == []
    for lengths, budget, least in (([11], 10, 1), ([1, 1], 10, 3)):
        with pytest.raises(ValueError):
            batches.micro_batches(lengths, budget, least)
    df = spark.createDataFrame([(0, 1), (1, 2)], "a long, b int")
    with pytest.raises(ValueError, match="can't rename"):
        canonical.renamed(df, {"a": "b"})
    with pytest.raises(ValueError, match="different things"):
        canonical.concatenated([(df, {"k": 1}), (df, {"k": 2})])
    with pytest.raises(ValueError, match="columns differ"):
        canonical.concatenated([(df, {}), (df.drop("b"), {})])
    with pytest.raises(Exception, match="don't divide"):
        batches.dealt(df, "a", 3).collect()
    assert batches.padded(df.select("a"), "a", 2, 7).count() == 7 and batches.unpadded(batches.padded(df.select("a"), "a", 2, 7)).count() == 2


def test_canonical_rows_refuse_what_is_wrong(spark):
    rows = lambda t: spark.createDataFrame([("d", "v", 5.0)], "dataset string, video_id string, frame_count double").withColumn("query_events", F.expr(t))
    event = "array(named_struct('qid', cast(null as string), 'time', {0}, 'content', {1}, 'answer_policy', {2}, 'options', array('x'), 'answer_events', array(named_struct('time', 1.0D, 'gt', {3}, 'answer', 'a', 'content', cast(null as string)))))"
    good = ("1.4D", "'q'", "''", "'b'")
    q = canonical.canonical(rows(event.format(*good))).first().query_events[0]
    assert (q.qid, q.time, q.answer_policy, q.answer_events[0].gt, q.answer_events[0].content) == ("q0", 1.0, "answer_when_asked", "B", "a")
    for i, (bad, why) in enumerate([("-1D", "negative"), ("' '", "content is missing"), ("'never'", "unknown policy"), ("'7'", "no gold letter")]):
        with pytest.raises(Exception, match=why):
            canonical.canonical(rows(event.format(*[bad if i == k else x for k, x in enumerate(good)]))).collect()


def test_folders_of_one_kind(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "_hidden").write_text("")
    assert folders.load_folder(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ValueError, match="several kinds"):
        folders.load_folder(spark, str(tmp_path))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError, match="no files"):
        folders.load_folder(spark, str(empty))


def test_groups_are_chosen_greedily(spark):
    import hashlib
    import random

    rng = random.Random(3)
    for n in (0, 7, 60, 10_000):
        sizes = {f"g{i}": rng.choice([1, 2, 3, 20, 41]) for i in range(40)}
        df = spark.createDataFrame([(g, i) for g, k in sizes.items() for i in range(k)], "g string, i int")
        total, want = 0, set()
        for g in sorted(sizes, key=lambda x: hashlib.sha256(f"s:{x}".encode()).hexdigest()):
            if total + sizes[g] <= n:
                total += sizes[g]
                want.add(g)
        assert {r.g for r in sampling.whole_groups(df, "g", n, "s").where("chosen").select("g").distinct().collect()} == want


def test_scans_of_long_sequences(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: i.cast("double")).alias("x"))
    row = df.select(F.size(ordered.thinned(F.col("x"), 10.0)).alias("n"), F.get(ordered.discounted(F.col("x"), 0.5), F.lit(99_999)).alias("last"), F.get(ordered.smoothed(F.col("x"), 0.0), F.lit(5)).alias("s")).first()
    assert tuple(row) == (10_000, 100_000.0, 6.0)


def test_judgements_without_sense():
    assert judges.judgement(None, judges.FORMS["step"]) is None and judges.judgement("[1]", judges.FORMS["step"]) is None
    found = judges.judgement('{"keyframe_selection": {"score": {"score": 1}}, "bridge_quality": "high", "issues": 3}', judges.FORMS["step"])
    assert found["score"] == 0 and found["issues"] == []


@pytest.mark.parametrize(("a", "b", "same"), [
    (r"\frac{x^2-1}{x-1}", "x+1", True), (r"\sqrt[3]{8}", "2", True), ("2^{-1}", "0.5", True), (r"\text{no}", r"\text{yes}", False), ("x", "y", False), ("(", "(", True), ("1+", "1", False), ("a" * 3000, "b", False),
])
def test_expressions(a, b, same):
    assert mathematics.same_math(a, b) == same
