"""Schemaless records."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import records as V


def lines(spark, *rows):
    return spark.createDataFrame([(r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False),) for r in rows], "value string")


def shown(df, column):
    return [json.loads(r[0]) for r in df.select(F.to_json(column)).collect()]


def test_strict_and_lenient_lines(spark):
    some = lines(spark, {"a": 1}, " ", "", '{"b": [1,', "[1]", "3")
    got = V.lenient(some).collect()
    assert [r.bad for r in got] == [None, '{"b": [1,', "[1]", "3"] and [r.record is None for r in got] == [False, True, True, True]
    assert V.parsed(lines(spark, {"a": 1}, "  ")).count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        V.parsed(some).collect()
    assert V.parsed(lines(spark)).count() == 0 and V.keys(V.parsed(lines(spark))).count() == 0


def test_keys_and_schema(spark):
    df = V.parsed(lines(spark, {"a": 1, "é x": {"b": [1]}}, {"a": "t"}, {"a": None}))
    assert {r.key: (r.n, r.kinds) for r in V.keys(df).collect()} == {"a": (3, ["BIGINT", "STRING", "VOID"]), "é x": (1, ["OBJECT"])}
    assert V.schema(df).startswith("OBJECT<a: VARIANT")


def test_cuts_and_merges(spark):
    df = V.parsed(lines(spark, {"a": 1, "b.c": {"x": 2}, "d": [None]}, {"d": "only"}, {}))
    r = F.col("record")
    assert shown(df, V.projected(r, ["a", "b.c", "zz"])) == [{"a": 1, "b.c": {"x": 2}}, {}, {}]
    assert shown(df, V.without(r, ["d"])) == [{"a": 1, "b.c": {"x": 2}}, {}, {}]
    assert shown(df, V.renamed(r, {"d": "e"})) == [{"a": 1, "b.c": {"x": 2}, "e": [None]}, {"e": "only"}, {}]
    assert shown(df, V.merged(r, F.parse_json(F.lit('{"a": 9, "n": 0}')), r)) == [{"a": 1, "b.c": {"x": 2}, "d": [None], "n": 0}, {"a": 9, "n": 0, "d": "only"}, {"a": 9, "n": 0}]
    assert df.select(V.at(r, "b.c", "string")).first()[0] == '{"x":2}'
    with pytest.raises(Exception, match="(?i)duplicate"):
        shown(df, V.renamed(r, {"d": "a"}))


ROW = {"dataset": "d", "sample_id": "s", "duration": 9.4, "query_events": [{"query": "q?", "answer_events": [{"gt": None, "answer": "yes", "by": {"who": "é\n\"x\""}}], "lang": "fr"}], "more": [{"k": "v"}], "zero": 0}


def test_unknown_keys_survive_at_every_level(spark):
    got = json.loads(V.exported(V.canonical(V.parsed(lines(spark, ROW)))).first().value)
    assert got["more"] == [{"k": "v"}] and got["zero"] == 0 and got["query_events"][0]["lang"] == "fr" and got["query_events"][0]["answer_events"][0]["by"] == {"who": "é\n\"x\""}
    assert list(got)[:8] == ["dataset", "video_id", "video", "frames_dir", "sample_fps", "frame_count", "frame_id_base", "query_events"] and got["frame_count"] == 9
    assert list(got["query_events"][0]) == ["qid", "time", "content", "answer_type", "answer_policy", "answer_events", "lang"]
    again = V.exported(V.canonical(V.parsed(lines(spark, got)))).first().value
    assert json.loads(again) == got


@pytest.mark.parametrize(("change", "error"), [
    ({"dataset": " "}, "dataset is missing"), ({"sample_id": 0}, "video_id is missing"), ({"query_events": [{"answer_events": []}]}, "content is missing"),
    ({"duration": -1}, "negative"), ({"query_events": [{"query": "q", "answer_policy": "never", "answer_events": []}]}, "unknown policy"), ({"query_events": [{"query": "q", "options": ["a"], "answer_events": [{"gt": "AB"}]}]}, "no gold letter"),
])
def test_faulty_records_fail(spark, change, error):
    with pytest.raises(Exception, match=error):
        V.exported(V.canonical(V.parsed(lines(spark, ROW | change)))).collect()
