"""Schemaless records as variants: keys that no schema names survive projection, canonical form and export.

A record is a VARIANT column. Known keys are read by path with their aliases; what is left over stays a variant of its own (`extra`), at each level of a row,
its queries and their answers, and is written back after the known keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import canonical as N

# Names under which the canonical keys may come, in order of preference.
TOP = {
    "dataset": ("dataset",), "video_id": ("video_id", "sample_id"), "video": ("video", "frames_dir"), "frames_dir": ("frames_dir", "video"), "sample_fps": ("sample_fps", "fps"),
    "frame_count": ("frame_count", "realtime", "duration"), "frame_id_base": ("frame_id_base",), "query_events": ("query_events",),
}
QUERY = {
    "qid": ("qid",), "time": ("time", "timestamp", "query_time"), "content": ("content", "question", "query", "text"), "answer_type": ("answer_type",), "answer_policy": ("answer_policy",),
    "options": ("options",), "answer_events": ("answer_events",),
}
ANSWER = {"time": ("time", "timestamp", "evidence_time"), "gt": ("gt",), "answer": ("answer",), "content": ("content",)}


def parsed(lines: DataFrame, value: str = "value", record: str = "record") -> DataFrame:
    """JSON lines as records; blank ones are skipped, others that are no objects fail the job."""
    rows = lines.where(T.stripped(F.col(value)) != "")
    found = F.try_parse_json(value)
    ok = F.coalesce(F.schema_of_variant(found).startswith("OBJECT"), F.lit(False))
    return rows.withColumn(record, F.when(ok, found).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(value, 1, 80))).cast("variant")))


def lenient(lines: DataFrame, value: str = "value", record: str = "record", bad: str = "bad") -> DataFrame:
    """The same; lines that are no objects are null records, with their text in `bad`."""
    rows = lines.where(T.stripped(F.col(value)) != "").withColumn(record, F.try_parse_json(value))
    ok = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    return rows.withColumn(bad, F.when(~ok, F.col(value))).withColumn(record, F.when(ok, F.col(record)))


def read(spark: SparkSession, path: str, record: str = "record") -> DataFrame:
    return parsed(spark.read.text(path), record=record).select(record)


def fields(record: Column) -> Column:
    """A record's keys and values; null for what is no object."""
    return F.try_variant_get(record, F.lit("$"), "map<string,variant>")


def record_of(values: Column) -> Column:
    """A record from keys and values; none of either: an empty one."""
    return F.to_variant_object(F.coalesce(values, F.create_map().cast("map<string,variant>")))


def projected(record: Column, names: list[str]) -> Column:
    """The record's keys that are among names."""
    return record_of(F.map_filter(fields(record), lambda k, _: k.isin(*names)))


def without(record: Column, names: list[str]) -> Column:
    return record_of(F.map_filter(fields(record), lambda k, _: ~k.isin(*names)))


def renamed(record: Column, names: dict[str, str]) -> Column:
    """Keys under new names; a record with both of a pair fails the job."""
    new = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return record_of(F.transform_keys(fields(record), lambda k, _: F.coalesce(F.try_element_at(new, k), k)))


def merged(*records: Column) -> Column:
    """All keys of all records; of a key that several have, the last one's value."""
    def add(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return record_of(reduce(add, (F.coalesce(fields(r), F.create_map().cast("map<string,variant>")) for r in records)))


def keys(df: DataFrame, record: str = "record") -> DataFrame:
    """(key, n, kinds): how many records have each key, and the kinds of its values."""
    each = df.select(F.explode(fields(F.col(record))).alias("key", "value"))
    return each.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0))).alias("kinds"))


def schema(df: DataFrame, record: str = "record") -> str:
    """One schema of all records, as Spark writes it; a key of several kinds is a VARIANT."""
    return df.agg(F.schema_of_variant_agg(record)).first()[0]


def at(record: Column, name: str, kind: str) -> Column:
    """The value of a key as a kind, or null."""
    return F.try_variant_get(record, F.lit(f"$['{name}']"), kind)


def first_of(record: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first value among names that is given: no null, no blank text; as a text, no zero and no false either."""
    found = [at(record, n, kind) for n in names]
    if kind == "string":
        return F.coalesce(*(F.when(~T.stripped(x).isin("", "0", "false"), x) for x in found))
    return F.coalesce(*found)


def _left_over(record: Column, known: dict[str, tuple[str, ...]]) -> Column:
    return without(record, sorted({n for names in known.values() for n in names}))


def _asked(query: Column) -> Column:
    """A query's known keys in the form that canonical.events() takes."""
    text = lambda key: first_of(query, QUERY[key])
    answers = F.transform(at(query, "answer_events", "array<variant>"), lambda a: F.struct(
        first_of(a, ANSWER["time"], "double").alias("time"), at(a, "gt", "string").alias("gt"), at(a, "answer", "string").alias("answer"), at(a, "content", "string").alias("content"),
    ))
    return F.struct(
        text("qid").alias("qid"), first_of(query, QUERY["time"], "double").alias("time"), text("content").alias("content"), text("answer_policy").alias("answer_policy"),
        F.transform(at(query, "options", "array<variant>"), lambda o: F.coalesce(o.cast("string"), F.lit(""))).alias("options"), answers.alias("answer_events"),
    )


def _with_extra(event: Column, query: Column) -> Column:
    """A canonical query with what its record, and those of its answers, hold besides."""
    raw = F.coalesce(at(query, "answer_events", "array<variant>"), F.array().cast("array<variant>"))
    answers = F.zip_with(event["answer_events"], raw, lambda a, r: F.struct(*(a[k].alias(k) for k in ANSWER), _left_over(r, ANSWER).alias("extra")))
    return F.struct(*(event[k].alias(k) for k in QUERY if k != "answer_events"), answers.alias("answer_events"), _left_over(query, QUERY).alias("extra"))


def canonical(df: DataFrame, record: str = "record") -> DataFrame:
    """The eight canonical columns of records under any of their aliases, and extra: all other keys. Queries and answers carry their own."""
    r, given = F.col(record), F.coalesce(at(F.col(record), "query_events", "array<variant>"), F.array().cast("array<variant>"))
    number = lambda key: F.coalesce(*(F.when(at(r, n, "double") != 0, at(r, n, "double")) for n in TOP[key]))
    rows = df.select(
        first_of(r, TOP["dataset"]).alias("dataset"), first_of(r, TOP["video_id"]).alias("video_id"), first_of(r, TOP["video"]).alias("video"), first_of(r, TOP["frames_dir"]).alias("frames_dir"),
        first_of(r, TOP["sample_fps"], "double").alias("sample_fps"), number("frame_count").alias("frame_count"), first_of(r, TOP["frame_id_base"], "long").alias("frame_id_base"),
        F.transform(given, _asked).alias("query_events"), given.alias("_given"), _left_over(r, TOP).alias("extra"),
    )
    *known, events = N.canonical_columns(rows)
    return rows.select(*known, F.zip_with(events, F.col("_given"), _with_extra).alias("query_events"), "extra")


def _object(known: Column, extra: Column, listed: tuple[str, Column] | None = None) -> Column:
    """A JSON object of known keys (their own JSON), a list of objects under a name, and a record's keys."""
    more, inner = F.to_json(extra), lambda x: F.substring(x, 2, F.length(x) - 2)
    parts = [inner(known), inner(more)]
    if listed:
        parts.insert(1, F.concat(F.lit(f'"{listed[0]}":['), F.array_join(listed[1], ","), F.lit("]")))
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ","), F.lit("}"))


def exported(rows: DataFrame) -> DataFrame:
    """(value): canonical rows as JSON lines, known keys in their order and then all others, at every level."""
    def answer(a: Column) -> Column:
        return _object(F.to_json(F.struct(*(a[k].alias(k) for k in ANSWER))), a["extra"])

    def query(q: Column) -> Column:
        return _object(F.to_json(F.struct(*(q[k].alias(k) for k in QUERY if k != "answer_events"))), q["extra"], ("answer_events", F.transform(q["answer_events"], answer)))

    top = F.to_json(F.struct(*(F.col(k) for k in TOP if k != "query_events")))
    return rows.select(_object(top, F.col("extra"), ("query_events", F.transform("query_events", query))).alias("value"))
