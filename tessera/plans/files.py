"""Readers and writers as queries: rows go through a sink, a reader and back, and must be what they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import Tables, query
from tessera.shipping import ship
from tessera.sources import arrow_source, folders, readers, writers
from tessera.storage import shared_dir
from tessera.streaming import windows

PARTS = "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part"
KIND = "id bigint, name string, price double"


def _path(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/tessera-files-{name}-{uuid.uuid4().hex}"


def _parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


def _schema(t: Tables, kind: str = KIND):
    return t.spark.createDataFrame([], kind).schema


def _text(t: Tables, df: DataFrame, name: str, one: bool = False, suffix: str = "") -> str:
    path = _path(t, name) + suffix
    (df.coalesce(1) if one else df).write.text(path)
    return path


@query(PARTS)
def strict_json_lines(t: Tables) -> DataFrame:
    """Compact lines with blank ones between them, strictly read."""
    lines = _parts(t).select(F.explode(F.array(F.to_json(F.struct("id", "name", "price")), F.lit("  "))).alias("value"))
    return readers.strict_lines(t.spark, _text(t, lines, "strict"), _schema(t))


@query("SELECT count(*)::BIGINT AS n FROM part")
def lines_of_a_missing_file(t: Tables) -> DataFrame:
    """A file that is there and one that is not."""
    path = _path(t, "there") + ".jsonl"
    writers.lines(_parts(t), path)
    both = [readers.lines_or_nothing(t.spark, p, _schema(t)) for p in (path, _path(t, "missing") + ".jsonl")]
    return both[0].unionAll(both[1]).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, p_name AS name, NULL::VARCHAR AS bad FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT NULL, NULL, '{broken ' || p_partkey FROM part WHERE p_size % 5 = 0")
def lenient_json_lines(t: Tables) -> DataFrame:
    good = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    lines = t.part.select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("{broken "), F.col("p_partkey").cast("string"))).otherwise(good).alias("value"))
    rows = readers.lenient_lines(t.spark, _text(t, lines, "lenient"), _schema(t, "id bigint, name string"), "bad")
    return rows.select("id", "name", "bad")


@query(PARTS + " UNION ALL " + PARTS)
def wrapped_json(t: Tables) -> DataFrame:
    """A list of rows, and an object that holds one, each as one JSON document."""
    def document(rows: DataFrame, before: str, after: str) -> DataFrame:
        return rows.agg(F.concat(F.lit(before), F.to_json(F.collect_list(F.struct("id", "name", "price"))), F.lit(after)).alias("value"))

    listed = _text(t, document(_parts(t), "", ""), "listed")
    held = _text(t, document(_parts(t), '{"version": 1, "annotations": ', "}"), "held")
    return readers.wrapped(t.spark, listed, _schema(t)).unionAll(readers.wrapped(t.spark, held, _schema(t)))


@query(
    "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price FROM part UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part"
)
def loaded_by_suffix(t: Tables) -> DataFrame:
    """Parquet with NaN, JSON lines and CSV in one list of paths."""
    rows, paths = _parts(t), [_path(t, "load") + s for s in (".parquet", ".jsonl", ".csv")]
    size = t.part.select(F.col("p_partkey").alias("id"), "p_size")
    rows.join(size, "id").select("id", "name", F.when(F.col("p_size") % 2 == 0, F.col("price")).otherwise(float("nan")).alias("price")).write.parquet(paths[0])
    writers.lines(rows, paths[1])
    rows.write.option("header", True).csv(paths[2])
    return readers.load(t.spark, ", ".join(paths), _schema(t))


@query(PARTS)
def arrow_folder(t: Tables) -> DataFrame:
    """Arrow files of a folder, written and read by tasks, a few record batches each."""
    path = _path(t, "arrow")
    arrow_source.write_arrow(_parts(t).repartition(3, "id"), path)
    return folders.load_folder(t.spark, path).select("id", "name", "price")


@query(PARTS)
def arrow_stream(t: Tables) -> DataFrame:
    """The same as a stream, whose offsets are a file and a place in it."""
    path, out = _path(t, "arrows"), _path(t, "arrows-out")
    arrow_source.write_arrow(_parts(t).repartition(3, "id"), path)
    windows.drained(arrow_source.stream_arrow(t.spark, path), out, _path(t, "arrows-state"))
    return t.spark.read.schema(_schema(t)).parquet(out).select("id", "name", "price")


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents")
def json_array_in_chunks(t: Tables) -> DataFrame:
    """All documents as one JSON list in an object, read in chunks that cut strings, escapes and characters anywhere."""
    lines = t.documents.select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    first = lines.limit(0).unionAll(t.spark.range(1).select(F.lit('{"version": {"data": [1]}, "samples": [').alias("value")))
    rows = first.unionAll(lines.select(F.concat("value", F.lit(",")).alias("value"))).unionAll(t.spark.range(1).select(F.lit('{"doc_id": null}]}').alias("value")))
    path = _text(t, rows, "array")  # one document, written by many tasks: its files follow each other
    found = readers.wrapped(t.spark, path, _schema(t, "doc_id bigint, text string, lang string"), chunk=99_991, joined=True)
    return found.where("doc_id is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang")


@query(PARTS)
def parquet_of_many_files(t: Tables) -> DataFrame:
    """Multi-turn and RL tables: many Parquet folders as one."""
    paths = []
    for k in range(3):
        paths.append(_path(t, f"many{k}") + ".parquet")
        _parts(t).where(F.col("id") % 3 == k).write.parquet(paths[-1])
    return readers.load(t.spark, ",".join(paths))


@query("SELECT event_id, event_type FROM events")
def streamed_files(t: Tables) -> DataFrame:
    """A folder read as a stream, until it has no more."""
    from tessera.streaming import windows

    source, out = _path(t, "stream"), _path(t, "streamed")
    t.events.select("event_id", "event_type").repartition(3).write.parquet(source)
    schema = t.spark.read.parquet(source).schema
    windows.drained(windows.stream_of(t.spark, source, schema), out, _path(t, "checkpoint"))
    return t.spark.read.schema(schema).parquet(out)


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 2 = 1")
def appended_rows(t: Tables) -> DataFrame:
    path, rows = _path(t, "appended"), t.events.select("event_id", "event_type")
    writers.appended(rows.where("event_id % 2 = 0"), path)
    writers.appended(rows.where("event_id % 2 = 1"), path)
    return t.spark.read.parquet(path)


@query("SELECT doc_id, lang FROM documents")
def rows_by_split(t: Tables) -> DataFrame:
    path = _path(t, "split")
    writers.by_split(t.documents.select("doc_id", "lang"), path, "lang")
    return t.spark.read.parquet(path).select("doc_id", "lang")


@query("SELECT event_id, (event_id % 4)::INTEGER AS batch FROM events")
def batches_written_twice(t: Tables) -> DataFrame:
    """Micro-batches that replace themselves when they come again."""
    path = _path(t, "batches")
    write = writers.per_batch(path)
    for n in (0, 1, 2, 3, 2):
        write(t.events.where(F.col("event_id") % 4 == n).select("event_id"), n)
    return t.spark.read.parquet(path).select("event_id", F.col("batch").cast("int").alias("batch"))


@query(
    "SELECT '| lang | n |' AS line, 0::INTEGER AS at UNION ALL SELECT '|---|---|', 1 UNION ALL SELECT '| ' || lang || ' | ' || n || ' |', (1 + row_number() OVER (ORDER BY lang))::INTEGER FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)"
)
def summary_as_table(t: Tables) -> DataFrame:
    text = writers.markdown(t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang"))
    return t.spark.createDataFrame([(x, i) for i, x in enumerate(text.split("\n"))], "line string, at int")


@query("WITH k AS (SELECT DISTINCT event_type AS kind FROM events) SELECT kind, 'exists' AS why FROM k UNION ALL SELECT kind, 'reserved' FROM k UNION ALL SELECT kind, 'safe' FROM k")
def outputs_that_are_refused(t: Tables) -> DataFrame:
    """A folder for each kind of event: the folder itself, one below it where it is reserved, and a new one."""
    path = _path(t, "refused")
    t.events.write.partitionBy("event_type").parquet(path)
    found = []
    for f in folders.folders_of(t.spark, path):  # one for each kind
        kind = f.rsplit("=", 1)[-1]
        for p, reserved in ((f, []), (f + "/below", [f]), (f + "-new", [f])):
            try:
                folders.ensure_safe(t.spark, p, reserved)
                found.append((kind, "safe"))
            except ValueError as e:
                found.append((kind, "reserved" if "reserved" in str(e) else "exists"))
    return t.spark.createDataFrame(found, "kind string, why string")


@query("SELECT user_id, event_id AS step, 'Step ' || event_id AS title, event_type FROM events")
def traces_of_runs(t: Tables) -> DataFrame:
    """Steps written as lines and as text: the title of each step's text beside its line."""
    path = _path(t, "trace")
    folders.trace(t.events.select("user_id", "event_id", "event_type"), path, "user_id", "event_id")
    lines = folders.traced(t.spark, path, "user_id", "event_id bigint, event_type string, user_id bigint").drop(folders.WRITE)
    titles = t.spark.read.text(f"{path}/text").where(F.col("value").startswith("Step ")).select(F.col("value").alias("title"), F.substring("value", 6, 20).cast("long").alias("event_id"))
    return lines.join(titles, "event_id").select("user_id", F.col("event_id").alias("step"), "title", "event_type")


@query("SELECT vec_id, label, list_sum(embedding::DOUBLE[])::DOUBLE AS total FROM embeddings")
def batches_kept(t: Tables) -> DataFrame:
    rows = folders.kept(t.embeddings, _path(t, "kept"))
    return rows.select("vec_id", "label", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id = 3 OR (conv_id = 5 AND lower(role || chr(10) || coalesce(text, '')) LIKE '%user%')")
def rollout_log(t: Tables) -> DataFrame:
    one = folders.rollouts(t.conversations, "3", None, "conv_id", ["turn"])
    return one.unionAll(folders.rollouts(t.conversations, "5", "USER", "conv_id", ["turn"])).select("conv_id", "turn")


@query("SELECT p_partkey, 'math' AS data_source, 'user' AS role, p_name AS content, 'parts' AS ability, 'rule' AS style, p_type AS ground_truth, 'train' AS split FROM part")
def rows_for_trainers(t: Tables) -> DataFrame:
    path = _path(t, "training")
    writers.training_rows(t.part, "p_name", "p_type", "math", "parts", "p_partkey", "train").write.parquet(path)
    r = t.spark.read.parquet(path)
    return r.select(
        F.col("extra_info.index").alias("p_partkey"), "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"),
        "ability", "reward_model.style", "reward_model.ground_truth", "extra_info.split",
    )


@query("SELECT p_partkey, '<image> ' || p_name AS asked, p_type AS said, p_brand AS image FROM part")
def sharegpt_export(t: Tables) -> DataFrame:
    path = _path(t, "sharegpt") + ".jsonl"
    rows = t.part.select(F.concat(F.lit("<image> "), "p_name").alias("q"), F.concat("p_type", F.lit("|"), F.col("p_partkey").cast("string")).alias("a"), F.array("p_brand").alias("images"))
    writers.lines(writers.sharegpt_rows(rows, "q", "a", "images"), path)
    r = readers.strict_lines(t.spark, path, _schema(t, "messages array<struct<role:string,content:string>>, images array<string>"))
    said = F.split(F.col("messages")[1]["content"], r"\|")
    return r.select(said[1].cast("long").alias("p_partkey"), F.col("messages")[0]["content"].alias("asked"), said[0].alias("said"), F.col("images")[0].alias("image"))


@query("""
WITH f AS (SELECT o_custkey AS video, count(DISTINCT o_orderkey % 40) AS n, min(o_orderkey % 40) AS lo, max(o_orderkey % 40) AS hi FROM orders GROUP BY o_custkey)
SELECT c_custkey AS video, CASE WHEN n IS NULL THEN 'missing' WHEN hi - lo + 1 <> n THEN 'gap' WHEN n < 2 THEN 'short' END AS fault FROM customer LEFT JOIN f ON c_custkey = video
""")
def faults_of_frames(t: Tables) -> DataFrame:
    frames = t.orders.select(F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 40).alias("frame"))
    return readers.frame_gaps(frames, "video", "frame", t.customer.select(F.col("c_custkey").alias("video"), F.lit(2).alias("want")), "want").select("video", "fault")
