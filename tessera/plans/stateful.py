"""Stateful and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import Tables, query, seconds
from tessera.shipping import ship
from tessera.storage import settled, shared_dir
from tessera.streaming import memory, tagged, windows


def raw_steps(t: Tables) -> DataFrame:
    """Tagged output of a 5-second step for each event of a user, with faults by event id."""
    e = t.events.select("user_id", "event_id", "value", F.row_number().over(_by_time()).alias("i"))
    i = (F.col("i") - 1).cast("long")
    a, b = (i * 5).cast("double"), (i * 5 + 5).cast("double")
    k = F.col("event_id") % 9
    note = F.format_string('<anchor t="%.1f-%.1f"></anchor>', a, a + 1)
    gap = lambda s, text: F.format_string(f'<delta t="%.1f-%.1f">{text}</delta>', s, b)
    head = F.concat(F.lit("<state>s "), F.col("event_id").cast("string"), F.lit("</state><answer>"), F.when(k == 4, "yes").otherwise(""), F.lit("</answer>"))
    body = F.when(k == 0, F.concat(head, gap(a, "all"))).when(k == 1, F.concat(head, note, gap(a + 1, "rest"), F.lit(" tail"))).when(k == 2, gap(a, "no head")).when(k == 3, F.concat(head, note, gap(a + 2, "late"))).when(k == 5, F.lit("nothing")).when(
        k == 6, F.concat(head, F.lit('<anchor t="9-3"></anchor>'), gap(a, "x")),
    )
    return e.select(
        F.col("user_id").alias("video_id"), i.alias("step_index"), a.alias("step_start"), b.alias("step_end"), F.when(k == 7, "what?").alias("question"),
        body.otherwise(F.concat(head, note, gap(a + 1, "rest"))).alias("raw"),
    )


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""
WITH e AS (SELECT event_id % 9 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), c AS (
  SELECT unnest(CASE k WHEN 1 THEN ['text_outside_tags'] WHEN 2 THEN ['state_count', 'answer_count', 'tag_order'] WHEN 5 THEN ['text_outside_tags', 'no_tags'] WHEN 6 THEN ['tag_parse_error'] ELSE [] END) AS code FROM e)
SELECT code, count(*)::BIGINT AS n FROM c GROUP BY code
""")
def tagged_output_issues(t: Tables) -> DataFrame:
    codes = tagged.parsed(raw_steps(t)).select(F.explode_outer("issues").alias("code")).where("code is not null")  # of an inner one, a filter would find the issues a second time
    return codes.groupBy("code").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_id % 9 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT count(*)::BIGINT AS n, sum((k IN (0, 4, 7, 8))::INTEGER)::BIGINT AS valid, sum((k IN (0, 4, 7, 8))::INTEGER)::BIGINT AS well_formed FROM e
""")
def tagged_output_quality(t: Tables) -> DataFrame:
    ship(t.spark)
    rows = tagged.with_quality(tagged.parsed(raw_steps(t)))
    return rows.agg(F.count("*").alias("n"), F.count_if("quality.valid").alias("valid"), F.count_if(F.col("quality.format_reward") == 1).alias("well_formed"))


def _steps(t: Tables) -> DataFrame:
    ship(t.spark)
    return tagged.recovered(tagged.parsed(raw_steps(t))).select("video_id", "step_index", "step_start", "step_end", "events", "question", "answer", "n_recovered")


COUNTS = ["n_notes", "n_bridges", "n_seen", "tail_start", "n_repairs"]


@query(None)
def memory_replay(t: Tables) -> DataFrame:
    return memory.replay(_steps(t), shown=False).select("video_id", "step_index", *COUNTS)


@query("SELECT user_id AS video_id, count(*)::BIGINT AS n_steps, count(*)::BIGINT AS n_equal FROM events GROUP BY user_id")
def live_memory(t: Tables) -> DataFrame:
    """The same steps as a stream of several micro-batches, against their replay."""
    steps, top = settled(_steps(t)), f"{shared_dir(t.spark)}/tessera-live-{uuid.uuid4().hex}"  # parsed once for the five parts and the replay
    part = F.least(F.floor(F.col("step_index") / 16), F.lit(4))
    files = max(1, steps.rdd.getNumPartitions())
    for k in range(5):  # files of later steps are written later, and read later
        steps.where(part == k).write.parquet(f"{top}/in/part={k}")
    stream = windows.stream_of(t.spark, f"{top}/in", steps.schema, files_per_batch=files)  # a batch a part: as many of large tables as of small ones
    n, tasks = steps.where("step_index = 0").count(), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    together = min(64, max(1, n // (16 * tasks)))  # videos a group: some groups for each task, and few calls of the state
    windows.drained(memory.live(stream.drop("part"), shown=False, groups=max(1, n // together)), f"{top}/out", f"{top}/state")
    got, want = t.spark.read.schema(memory.STEPS).parquet(f"{top}/out"), memory.replay(steps, shown=False)
    same = F.lit(True)
    for c in COUNTS:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = want.alias("r").join(got.alias("l"), ["video_id", "step_index"], "left")
    return both.groupBy("video_id").agg(F.count("*").alias("n_steps"), F.count_if(same).alias("n_equal"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
""")
def tumbling_windows(t: Tables) -> DataFrame:
    rows = windows.tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM s)
SELECT user_id, round(epoch(min(ts)), 3) AS start, count(*)::BIGINT AS n FROM i GROUP BY user_id, island
""")
def session_windows(t: Tables) -> DataFrame:
    rows = windows.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"])
    return rows.withColumn("s", F.col("start").cast("timestamp_ntz")).select("user_id", F.round(seconds("s"), 3).alias("start"), "n")


@query("""
SELECT user_id, round(epoch(w), 0)::BIGINT AS start, count(*)::BIGINT AS n FROM (
  SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS w FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL
""")
def sliding_windows(t: Tables) -> DataFrame:
    rows = windows.sliding(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "12 hours", ["user_id"])
    return rows.withColumn("s", F.col("start").cast("timestamp_ntz")).select("user_id", seconds("s").cast("long").alias("start"), "n")
