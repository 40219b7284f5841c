"""Arrow files by record batches, JSON lists by byte ranges."""

import json
import random

import pyarrow as pa
import pytest

from tessera.sources import arrow_source, json_arrays, readers
from tessera.streaming import windows


def _table(n=1000, start=0):
    return pa.table({"id": list(range(start, start + n)), "x": [f"t{i}" * 3 for i in range(n)], "k": pa.array([f"c{i % 3}" for i in range(n)]).dictionary_encode()})


def _write(path, table, form=pa.ipc.new_stream, rows=90):
    with form(str(path), table.schema) as w:
        for b in table.to_batches(max_chunksize=rows):
            w.write_batch(b)


@pytest.mark.parametrize("form", [pa.ipc.new_file, pa.ipc.new_stream])
def test_a_file_is_read_by_many_tasks(spark, tmp_path, form):
    """Both formats, dictionaries decoded, each row once; planning reads no batch."""
    _write(tmp_path / "a.arrow", _table(), form)
    df = arrow_source.read_arrow(spark, [str(tmp_path / "a.arrow")], most=4000)
    assert df.rdd.getNumPartitions() > 3 and sorted(map(tuple, df.collect())) == sorted((r["id"], r["x"], r["k"]) for r in _table().to_pylist())
    kinds = [k for k, *_ in arrow_source.messages(str(tmp_path / "a.arrow"))]
    assert kinds.count(arrow_source.BATCH) == 12 and kinds[0] == arrow_source.SCHEMA


def test_files_that_lack_columns_and_empty_ones(spark, tmp_path):
    _write(tmp_path / "a.arrow", _table(5))
    _write(tmp_path / "b.arrow", _table(3, 100).select(["id"]))
    _write(tmp_path / "c.arrow", _table(0))
    got = arrow_source.read_arrow(spark, [str(tmp_path)]).collect()
    assert len(got) == 8 and sum(r.x is None for r in got) == 3
    assert arrow_source.read_arrow(spark, [str(tmp_path / "c.arrow")]).count() == 0
    some = arrow_source.read_arrow(spark, [str(tmp_path)], spark.createDataFrame([], "id long, more string").schema).collect()
    assert len(some) == 8 and all(r.more is None for r in some)


def test_a_half_written_message_is_left_for_later(spark, tmp_path):
    _write(tmp_path / "a.arrow", _table())
    whole = (tmp_path / "a.arrow").read_bytes()
    ends = [hi for k, _, hi in arrow_source.messages(str(tmp_path / "a.arrow")) if k == arrow_source.BATCH]
    (tmp_path / "a.arrow").write_bytes(whole[: ends[4] + 11])
    assert arrow_source.read_arrow(spark, [str(tmp_path / "a.arrow")]).count() == 5 * 90


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    """A file that grows, then another: each batch is read once over three runs."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    schema = "id long, x string, k string"
    _write(tmp_path / "whole.arrow", _table())
    whole = (tmp_path / "whole.arrow").read_bytes()
    ends = [hi for k, _, hi in arrow_source.messages(str(tmp_path / "whole.arrow")) if k == arrow_source.BATCH]

    def run():
        windows.drained(arrow_source.stream_arrow(spark, str(source), spark.createDataFrame([], schema).schema), out, state)
        return sorted(r.id for r in spark.read.schema(schema).parquet(out).collect())

    (source / "a.arrow").write_bytes(whole[: ends[3]])
    assert run() == list(range(360))
    (source / "a.arrow").write_bytes(whole)
    assert run() == list(range(1000))
    _write(source / "b.arrow", _table(50, 5000))
    assert run() == [*range(1000), *range(5000, 5050)]


def test_written_files_are_read_back(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id as string) s", "array(id) a")
    files = arrow_source.write_arrow(df.repartition(4), str(tmp_path / "w"))
    assert files.count() == 4 and sum(r.rows for r in files.collect()) == 1000
    again = arrow_source.write_arrow(df.repartition(4), str(tmp_path / "w"))
    assert again.count() == 4 and sorted(map(tuple, arrow_source.read_arrow(spark, [str(tmp_path / "w")]).collect())) == sorted(map(tuple, df.collect()))


def _rows(n=300):
    rng = random.Random(1)
    odd = ['x"y', "\\", "[{", "],,", "{", 'é,日"\\\\', "plain", "", "\\\\\\", '\\"']
    return [{"a": i, "b": "".join(rng.choice(odd) for _ in range(rng.randrange(5))), "c": [1, {"d": "]"}]} for i in range(n)]


@pytest.mark.parametrize("chunk", [101, 1 << 12, 1 << 23])
def test_a_list_in_chunks(spark, tmp_path, chunk):
    rows = _rows(40 if chunk == 101 else 300)
    documents = {
        "list": json.dumps(rows), "indented": json.dumps(rows, indent=2, ensure_ascii=False),
        "object": json.dumps({"v": [1, 2], "x": {"data": [9]}, "annotations": rows, "z": [3]}, ensure_ascii=False), "first_name": json.dumps({"samples": [5], "data": rows}),
    }
    for name, text in documents.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        got = [json.loads(r.value) for r in json_arrays.json_texts(spark, str(tmp_path / f"{name}.json"), chunk=chunk).collect()]
        assert sorted(got, key=lambda r: r["a"]) == rows, name


def test_lists_without_rows_and_many_files(spark, tmp_path):
    for name, text in (("a", "[]"), ("b", ' [ {"a": 1} ] '), ("c", '{"q": [1], "data": []}'), ("d", '{"q": 1}'), ("e", ""), ("f", '[{"a": 2}, 7, null]')):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.value for r in json_arrays.json_texts(spark, str(tmp_path), chunk=5).collect()) == ["7", "null", '{"a": 1}', '{"a": 2}']
    schema = spark.createDataFrame([], "a int").schema
    assert sorted(r.a for r in readers.wrapped(spark, str(tmp_path / "b.json"), schema).unionAll(readers.wrapped(spark, str(tmp_path / "f.json"), schema)).where("a is not null").collect()) == [1, 2]
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a"')
    with pytest.raises(Exception, match="does not end"):
        json_arrays.json_texts(spark, str(tmp_path / "cut.json")).collect()
