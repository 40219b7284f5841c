"""Queries on tables of other sizes and values than the given ones, against their SQL in DuckDB."""

import json
import tracemalloc

import duckdb
import pytest

from tessera.catalog import ORACLES, QUERIES
from tessera.operators.relational import TASK_ROWS
from tessera.sources import folders, json_arrays
from tests.test_queries import plain


@pytest.fixture
def held(spark, tmp_path):
    """A check of a query on tables, each given as SQL that makes its rows."""
    def check(name: str, **tables: str) -> list[tuple]:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        return got

    return check


@pytest.mark.parametrize("n", [7, 8, 10, 402])
def test_rows_that_do_not_divide_among_workers(held, n):
    assert len(held("dealt_to_workers", embeddings=f"SELECT i AS vec_id, (i % 5)::INTEGER AS label FROM range({n}) AS r(i)")) == n


@pytest.mark.parametrize("n", [82, 83, 121, 3])
def test_last_batches_that_do_not_divide_into_parts(held, n):
    assert len(held("greedy_parts_of_equal_size", documents=f"SELECT i AS doc_id, (i * 7919) % 1013 AS n_chars FROM range({n}) AS r(i)")) == n


def test_first_accepted_lines_of_parts_beyond_a_million(held):
    lines = "SELECT i // 4 AS l_orderkey, ((i * 7919 + 13) * 104729) % 1200007 AS l_partkey, (1 + i % 3)::INTEGER AS l_linenumber, (20 + i % 31)::DOUBLE AS l_quantity FROM range(4000) AS r(i)"
    assert len(held("first_accepted_per_video", lineitem=lines)) > 900


def test_tasks_grow_with_the_lines_to_dedupe(spark, held, tmp_path):
    tables = {
        "lineitem": "SELECT i // 4 AS l_orderkey, i % 977 AS l_partkey, (1 + i % 3)::INTEGER AS l_linenumber, (20 + i % 31)::DOUBLE AS l_quantity, 'R' AS l_returnflag, 'F' AS l_linestatus FROM range({n}) AS r(i)",
        "orders": "SELECT i AS o_orderkey, i % 1000 + 0.5 AS o_totalprice FROM range(900) AS r(i)",
    }
    held("dedupe_events_keep_first", **{t: sql.format(n=4000) for t, sql in tables.items()})
    duckdb.execute(f"COPY ({tables['lineitem'].format(n=5 * TASK_ROWS)}) TO '{tmp_path}/lineitem.parquet'")
    plan = QUERIES["dedupe_events_keep_first"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert ", 5), REPARTITION_BY_NUM" in plan


def test_one_document_of_several_files(spark, tmp_path):
    text = json.dumps({"version": {"data": [1]}, "samples": [{"a": '\\" ]}, [' * 3, "b": i} for i in range(40)]}).encode()
    for i, cut in enumerate(range(0, len(text), 97)):
        (tmp_path / f"part-{i:05}").write_bytes(text[cut : cut + 97])
    for chunk in (64, 1000, 1 << 20):
        found = json_arrays.json_texts(spark, str(tmp_path), chunk=chunk, joined=True).collect()
        assert sorted(json.loads(r.value)["b"] for r in found) == list(range(40))


def test_memory_of_a_chunk():
    data = json.dumps([{"id": i, "name": "x" * 40} for i in range(100_000)]).encode()
    tracemalloc.start()
    json_arrays.structure(data, 0, False, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(data)


def test_issues_are_found_once(spark, small):
    plan = QUERIES["tagged_output_issues"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text_outside_tags") == 1


def test_exports_are_made_once(spark, small):
    plan = QUERIES["records_round_trip"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" not in plan and "zip_with" not in plan


def test_many_runs_share_files_and_the_last_write_counts(spark, tmp_path):
    path = str(tmp_path / "trace")
    rows = spark.range(600).selectExpr("id % 300 AS run", "id AS step", "'old' AS what")
    folders.trace(rows, path, "run", "step")
    folders.trace(rows.where("run < 2").selectExpr("run", "step + 1000 AS step", "'new' AS what"), path, "run", "step")
    got = folders.traced(spark, path, "run", "run long, step long, what string").select("run", "step", "what").collect()
    assert sorted(got) == sorted([(i % 300, i, "old") for i in range(600) if i % 300 > 1] + [(i % 300, i + 1000, "new") for i in range(600) if i % 300 < 2])
    assert len(list((tmp_path / "trace" / "lines").rglob("*.json"))) < 20 and "what: new" in "".join(p.read_text() for p in (tmp_path / "trace" / "text").rglob("*.txt"))
