"""Schemaless records: parts as records under several names of their keys, with keys that no schema has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import records as V
from tessera.registry import Tables, query
from tessera.storage import settled, shared_dir


def _lines(t: Tables) -> DataFrame:
    """Three forms of records by p_size % 3, as JSON lines in a file."""
    text = lambda c: F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)")
    id_, size = (F.col("p_partkey") + 1000).cast("string"), F.col("p_size").cast("string")
    first = F.concat(
        F.lit('{"note":{"deep":[1,null,{"z":true}]},"sample_id":'), id_, F.lit(',"dataset":" d ","duration":'), size, F.lit('.5,"fps":2,"query_events":[{"timestamp":3.4,"question":'), text("p_name"),
        F.lit(',"options":[" x ",""],"level":"hard","answer_events":[{"evidence_time":5.5,"gt":"b","answer":'), text("p_type"), F.lit(',"score":0.5}]}],"a_tag":["t",1]}'),
    )
    second = F.concat(
        F.lit('{"dataset":"e","video_id":"v'), id_, F.lit('","video":"w/'), id_, F.lit('","frame_count":0,"realtime":'), size, F.lit(',"query_events":[{"qid":"k","time":1,"content":'), text("p_name"),
        F.lit(',"answer_events":[{"time":2,"answer":" one ","content":" "},{"time":9,"content":"two"}]}]}'),
    )
    third = F.concat(F.lit('{"p": null, "dataset":"f","video_id":'), id_, F.lit(',"frames_dir":"g","frame_count":7,"sample_fps":0.5,"frame_id_base":1,"query_events":[]}'))
    rows = t.part.select(F.when(F.col("p_size") % 3 == 0, first).when(F.col("p_size") % 3 == 1, second).otherwise(third).alias("value"))
    path = f"{shared_dir(t.spark)}/tessera-records-{uuid.uuid4().hex}"
    rows.write.text(path)
    return V.read(t.spark, path)


#: What the forms become; DuckDB's to_json() writes a text as JSON.
CANONICAL = """
SELECT CASE p_size % 3
  WHEN 0 THEN '{"dataset":"d","video_id":"' || (p_partkey + 1000) || '","video":"video/' || (p_partkey + 1000) || '","frames_dir":"video/' || (p_partkey + 1000) || '","sample_fps":2.0,"frame_count":' || (p_size + 1) || ',"frame_id_base":0,"query_events":[{"qid":"q0","time":3.0,"content":' || to_json(p_name) ||
    ',"answer_type":"mcq","answer_policy":"answer_when_asked","options":["x"],"answer_events":[{"time":6.0,"gt":"B","answer":' || to_json(p_type) || ',"content":' || to_json(p_type) || ',"score":0.5}],"level":"hard"}],"a_tag":["t",1],"note":{"deep":[1,null,{"z":true}]}}'
  WHEN 1 THEN '{"dataset":"e","video_id":"v' || (p_partkey + 1000) || '","video":"w/' || (p_partkey + 1000) || '","frames_dir":"w/' || (p_partkey + 1000) || '","sample_fps":1.0,"frame_count":' || p_size || ',"frame_id_base":0,"query_events":[{"qid":"k","time":1.0,"content":' || to_json(UPDATES || chr(10) || chr(10) || p_name) ||
    ',"answer_type":"text","answer_policy":"update_when_changed","answer_events":[{"time":2.0,"answer":"one","content":"one"},{"time":9.0,"content":"two"}]}]}'
  ELSE '{"dataset":"f","video_id":"' || (p_partkey + 1000) || '","video":"g","frames_dir":"g","sample_fps":0.5,"frame_count":7,"frame_id_base":1,"query_events":[],"p":null}' END AS value FROM part
"""


def _canonical_sql() -> str:
    from tessera.plans.forms import UPDATES

    return CANONICAL.replace("UPDATES", "'" + UPDATES.replace("'", "''") + "'")


@query("SELECT value FROM (" + _canonical_sql() + ")")
def canonical_records(t: Tables) -> DataFrame:
    return V.exported(V.canonical(_lines(t)))


@query("SELECT value, value AS again FROM (" + _canonical_sql() + ")")
def records_round_trip(t: Tables) -> DataFrame:
    """What is exported is canonical already: read again, it exports as itself, with all its keys."""
    once = settled(V.exported(V.canonical(_lines(t))))  # both are made once: the join's filters would make them again, each step of theirs as often as it is named
    again = settled(V.exported(V.canonical(V.parsed(once))).select(F.col("value").alias("again")))
    return once.join(again, F.col("value") == F.col("again"), "left")


@query("""
WITH k AS (SELECT unnest(CASE p_size % 3 WHEN 0 THEN ['note', 'sample_id', 'dataset', 'duration', 'fps', 'query_events', 'a_tag'] WHEN 1 THEN ['dataset', 'video_id', 'video', 'frame_count', 'realtime', 'query_events'] ELSE ['p', 'dataset', 'video_id', 'frames_dir', 'frame_count', 'sample_fps', 'frame_id_base', 'query_events'] END) AS key, p_size % 3 AS form FROM part)
SELECT key, count(*)::BIGINT AS n, CASE key WHEN 'note' THEN 'OBJECT' WHEN 'dataset' THEN 'STRING' WHEN 'duration' THEN 'DECIMAL' WHEN 'sample_fps' THEN 'DECIMAL' WHEN 'query_events' THEN 'ARRAY' WHEN 'a_tag' THEN 'ARRAY' WHEN 'video' THEN 'STRING' WHEN 'frames_dir' THEN 'STRING' WHEN 'p' THEN 'VOID'
  WHEN 'video_id' THEN CASE WHEN bool_or(form = 1) AND bool_or(form = 2) THEN 'BIGINT,STRING' WHEN bool_or(form = 1) THEN 'STRING' ELSE 'BIGINT' END ELSE 'BIGINT' END AS kinds FROM k GROUP BY key
""")
def keys_of_records(t: Tables) -> DataFrame:
    return V.keys(_lines(t)).select("key", "n", F.array_join("kinds", ",").alias("kinds"))


@query("""
SELECT event_id, '{"event":"' || event_type || '","k":' || (props->>'$.k') || '}' AS kept, '{"event":"' || event_type || '"}' AS rest, '{"event":"' || event_type || '","k2":' || (props->>'$.k') || '}' AS renamed FROM events
""")
def records_cut_and_renamed(t: Tables) -> DataFrame:
    own = F.to_variant_object(F.struct(F.col("event_type").alias("event"), F.lit("old").alias("k")))
    r = V.merged(own, V.projected(F.parse_json("props"), ["k", "nothing"]))
    return t.events.select("event_id", F.to_json(r).alias("kept"), F.to_json(V.without(r, ["k", "x"])).alias("rest"), F.to_json(V.renamed(r, {"k": "k2", "y": "z"})).alias("renamed"))
