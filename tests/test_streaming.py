"""Tagged output, memory, streams and sources."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.shipping import ship
from tessera.sources import readers, writers
from tessera.streaming import memory, tagged, windows

HEAD = "<state>s</state><answer></answer>"
CASES = {
    HEAD + '<anchor t="0.0-1.0"></anchor><delta t="1.0-5.0">x</delta>': [],
    HEAD + '<anchor t="0-1"></anchor>': [],
    "plain": ["text_outside_tags", "no_tags"],
    HEAD + '<delta t="5–9">x</delta> tail': ["text_outside_tags"],
    "<state></state><answer></answer><delta t='1-2'>x</delta>": ["text_outside_tags", "state_empty", "missing_observation"],
    HEAD + '<anchor t="9-3"></anchor>': ["tag_parse_error", "missing_observation"],
    HEAD + '<anchor t="0-1"/><delta t="1-2">x</delta>': ["text_outside_tags", "anchor_tag_format"],
    "<answer></answer><state>a</state><delta t=\"1-2\">x</delta>": ["tag_order"],
    "<state>a</state><state>b <i></state><answer>x</answer><delta t=\"1-2\">x</delta>": ["state_count", "state_contains_xml", "tag_order"],
    None: ["no_tags"],
    "": ["no_tags"],
}


def test_parser_issues(spark):
    rows = tagged.parsed(spark.createDataFrame([(k,) for k in CASES], "raw string")).collect()
    got = {r.raw: [i for i in r.issues if i not in ("state_count", "answer_count", "tag_order", "missing_observation") or i in CASES[r.raw]] for r in rows}
    for raw, want in CASES.items():
        assert got[raw] == want, raw


def test_quality():
    step = tagged.Step(0.0, 5.0, [(float(i), i + 1.0) for i in range(5)])
    ok = tagged.scored([("note", 0, 1, ""), ("bridge", 1, 5, "x")], [], step)
    assert ok["valid"] and ok["issues"] == []
    assert tagged.scored([("note", 0.5, 1.5, ""), ("bridge", 0, 5, "x")], [], step)["issues"][0] == "note_time_unmatched"
    assert "missing_bridge_gap" in tagged.scored([("note", 0, 1, "")], [], step)["issues"]
    assert "duplicate_bridge_gap" in tagged.scored([("bridge", 0, 5, "x"), ("bridge", 0, 5, "y")], [], step)["issues"]
    tail = tagged.Step(5.0, 10.0, [(float(i), i + 1.0) for i in range(5, 10)], (2.0, 5.0, "old"))
    assert tagged.scored([("bridge", 2.0, 10.0, "on")], [], tail)["valid"]
    assert tagged.scored([("note", 5, 6, "")], [], tail)["tail_reward"] == 0
    first = tagged.Step(0.0, 5.0, step.frames, first=True)
    assert "missing_initial_anchor" in tagged.scored([("bridge", 0, 5, "x")], [], first)["issues"]
    assert tagged.text_only_scored([("bridge", 0, 5, "x")], [], step)["valid"] and not tagged.text_only_scored([("note", 0, 1, "")], [], step)["valid"]


def test_repairs_tile_the_step():
    step = tagged.Step(0.0, 5.0, [(float(i), i + 1.0) for i in range(5)], first=True)
    for found in ([], [("bridge", 0, 9, "x")], [("note", 2, 3, ""), ("note", 2, 3, ""), ("bridge", 3.3, 5, "a"), ("bridge", 1, 2, " ")], [("bridge", 4, 4.5, "z"), ("note", 7, 8, "")]):
        events, done = tagged.repaired(found, step)
        at = 0.0
        for _, a, b, _ in events:
            assert a == pytest.approx(at)
            at = b
        assert at == 5.0 and done
        assert tagged.scored(events, [], step)["valid"]


def test_memory_by_hand():
    m = memory.Memory(window=3.0)
    a = memory.advance(m, 0, 5, [("note", 0.0, 1.0, ""), ("bridge", 1.0, 5.0, "x")], "q?", "", "full")
    b = memory.advance(m, 5, 10, [("bridge", 1.0, 10.0, "y")], None, "yes", "full")
    assert (a["n_notes"], a["n_bridges"], a["tail_start"]) == (1, 1, 1.0)
    assert (b["n_bridges"], b["n_seen"], b["tail_start"]) == (1, 0, 1.0) and m.dialogue().endswith('role="a">yes</qa>')
    assert "[image]" not in m.shown() and m.shown("delta_only") == '<delta t="1.0-10.0">y</delta>' and m.shown("none") == m.shown("recent") == ""
    n = memory.Memory()
    assert memory.advance(n, 0, 5, [], None, "", "none")["n_notes"] == 1 and n.shown("none") == ""


def test_live_memory_is_replayed_memory(spark, tmp_path):
    ship(spark)
    schema = "video_id long, step_index long, step_start double, step_end double, events " + tagged.EVENT + ", question string, answer string"
    rows = [
        (
            v, i, 5.0 * i, 5.0 * i + 5, [("note", 5.0 * i, 5.0 * i + 1, ""), ("bridge", 5.0 * i + 1, 5.0 * i + 5, f"{v}{i}")], "q" if i == 1 else None,
            "a" if i == 3 else "",
        ) for v in (1, 2) for i in range(6)
    ]
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    batch = memory.replay(spark.createDataFrame(rows, schema)).collect()
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    windows.drained(memory.live(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    live = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, live)) == sorted(map(tuple, batch)) and len(live) == 12


RECORDED = (1000, 19655, 19655, 11212, 1440, 164220.0)
STEP = "video_id long, step_index long, step_start double, step_end double, events " + tagged.EVENT + ", question string, answer string"


def _script(videos, steps):
    """Notes now and then, bridges that go on, one that takes its end back, and answers."""
    def events(v, i):
        a, b = 5.0 * i, 5.0 * i + 5
        if i % 7 == 3:
            return [("bridge", max(0.0, a - 5), b, f"{v}:{i}")]
        return [("note", a, a + 1, ""), ("bridge", a + 1, b, f"{v}:{i}")] if (v + i) % 3 else [("bridge", a, a + 3, "x")]

    return [(v, i, 5.0 * i, 5.0 * i + 5, events(v, i), "q" if i % 5 == 1 else None, "a" if i % 5 == 3 else "") for v in range(videos) for i in range(steps)]


def _live(spark, top, parts, watch=None, calls=None, **options):
    ship(spark)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, STEP).coalesce(1).write.parquet(str(top / "in" / f"part={k}"))
    stream = windows.stream_of(spark, str(top / "in"), spark.createDataFrame([], STEP).schema).drop("part")
    q = memory.live(stream, **options).writeStream.outputMode("append").format("parquet").option("path", str(top / "out")).option("checkpointLocation", str(top / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    if watch is not None:
        watch += [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    if calls is not None:
        calls += [sum(p["stateOperators"][0]["customMetrics"][f"rocksdb{c}Count"] for c in ("Get", "Put")) for p in q.recentProgress if p["numInputRows"]]
    return sorted(map(tuple, spark.read.schema(memory.STEPS).parquet(str(top / "out")).collect()))


def test_live_memory_in_many_batches(spark, tmp_path):
    rows, written = _script(3, 60), []
    parts = [[r for r in rows if r[1] // 6 == k] for k in range(10)]
    live = _live(spark, tmp_path, [p[::-1] for p in parts], written)
    assert live == sorted(map(tuple, memory.replay(spark.createDataFrame(rows, STEP)).collect())) and len(live) == 180
    # what a batch writes goes with its own steps and with the window, not with what came before
    assert len(written) == 10 and max(written[5:]) <= 1.5 * max(written[:5])


def test_live_memory_by_policy_without_text(spark, tmp_path):
    rows = _script(2, 12)
    live = _live(spark, tmp_path, [rows[::2], [r for r in rows[1::2] if r[1] > 10]], policy="anchor_only", shown=False, window=9.0)
    assert len(live) == 14 and all(r[-1] is None for r in live)


def test_live_memory_calls_its_state_seldom(spark, tmp_path):
    """A video's micro-batch reads and writes its state a few times, fewer than it has steps."""
    rows, calls = _script(3, 60), []
    parts = [[r for r in rows if r[1] // 20 == k] for k in range(3)]
    live = _live(spark, tmp_path, parts, calls=calls)
    assert live == sorted(map(tuple, memory.replay(spark.createDataFrame(rows, STEP)).collect()))
    assert len(calls) == 3 and sum(calls) < len(rows), calls


def test_live_memory_of_videos_together(spark, tmp_path):
    """Videos in groups, one without a number, one that comes later: the same memory; odd numbers and texts travel whole."""
    odd = [(None if r[0] == 1 else r[0] + 2**60, *r[1:]) for r in _script(5, 30)]
    odd[4] = (*odd[4][:4], [("note", float("nan"), float("inf"), ""), ("bridge", 20.0, 25.0, 'a "b"\n\u2028</x>')], *odd[4][5:])
    parts = [[r for r in odd if r[1] // 10 == k and (k or r[0] != 2**60 + 4)] for k in range(3)]
    ship(spark)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, STEP).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = windows.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], STEP).schema).drop("part")
    windows.drained(memory.live(stream, groups=2), str(tmp_path / "out"), str(tmp_path / "check"))
    live = spark.read.schema(memory.STEPS).parquet(str(tmp_path / "out")).collect()
    want = memory.replay(spark.createDataFrame([r for p in parts for r in p], STEP)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, live), key=key) == sorted(map(tuple, want), key=key) and len(want) == 140
    with pytest.raises(ValueError):
        memory.live(spark.createDataFrame(odd, STEP), groups=2, idle=5)


def test_live_memory_by_event_time(spark, tmp_path):
    """A video's timer goes by its watermarked time."""
    ship(spark)
    rows = _script(2, 12)
    at = F.timestamp_seconds(F.col("step_end"))
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 6 == k], STEP).withColumn("ts", at).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = windows.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], STEP).withColumn("ts", at).schema).drop("part").withWatermark("ts", "1 minute")
    windows.drained(memory.live(stream, idle=3_600_000, time="ts"), str(tmp_path / "out"), str(tmp_path / "check"))
    live = spark.read.schema(memory.STEPS).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, live)) == sorted(map(tuple, memory.replay(spark.createDataFrame(rows, STEP)).collect()))


def test_records_go_after_their_time_to_live():
    """By a state of plain dictionaries: what was last changed too long ago is shown no more."""
    from types import SimpleNamespace as Some

    import pandas as pd

    cells, chunks = {}, {}
    value = Some(get=lambda: cells.get("head"), update=lambda v: cells.update(head=v))
    of_chunks = Some(iterator=lambda: iter(chunks.items()), updateValue=chunks.__setitem__)
    keeper = memory.Keeper("full", True, 120.0, None, 10, None)
    keeper.init(Some(getValueState=lambda *_: value, getMapState=lambda *_: of_chunks, getListState=lambda *_: Some(appendList=lambda _: None)))

    def shown(i, now):
        events = [{"kind": "bridge", "start": 5.0 * i, "end": 5.0 * i + 5, "text": f"s{i}"}] if i else []
        step = json.dumps({"video_id": 1, "step_index": i, "step_start": 5.0 * i, "step_end": 5.0 * i + 5, "events": events, "question": None, "answer": ""})
        (part,) = keeper.handleInputRows(("1",), iter([pd.DataFrame({"step_text": [step]})]), Some(getCurrentProcessingTimeInMs=lambda: now))
        return json.loads(part["rows"][0])[0]["memory"]

    first, second = shown(0, 0), shown(1, 5)
    assert "t=\"0.0-1.0\"" in first and "t=\"0.0-1.0\"" in second
    third = shown(2, 12)
    assert "t=\"0.0-1.0\"" not in third and third.endswith("s2</delta>") and third.count("<delta") >= 1


def test_live_memory_forgets_idle_videos(spark, tmp_path):
    """After the idle time a video starts anew; a timer has dropped its state."""
    rows = _script(1, 4)
    import time

    ship(spark)
    schema = spark.createDataFrame([], STEP).schema

    (tmp_path / "in").mkdir()
    stream = windows.stream_of(spark, str(tmp_path / "in" / "part=*"), schema).drop("part")
    spark.createDataFrame(rows[:2], STEP).coalesce(1).write.parquet(str(tmp_path / "in" / "part=0"))
    live = memory.live(stream, idle=500).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    def written(n):
        end = time.time() + 20
        while time.time() < end:
            try:
                if spark.read.schema(memory.STEPS).parquet(str(tmp_path / "out")).count() >= n:
                    return
            except Exception:  # nothing is written yet
                pass
            time.sleep(0.5)
        raise AssertionError(f"{n} rows did not come")

    try:
        written(2)
        for k, (part, n) in enumerate([([(9, *rows[0][1:])], 3), (rows[2:], 5)], start=1):  # another video, then the first one again: its timer has expired
            time.sleep(2)
            spark.createDataFrame(part, STEP).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
            written(n)
    finally:
        live.stop()
    got = {(r.video_id, r.step_index): r.n_notes + r.n_bridges for r in spark.read.schema(memory.STEPS).parquet(str(tmp_path / "out")).collect()}
    anew = {r.step_index: r.n_notes + r.n_bridges for r in memory.replay(spark.createDataFrame(rows[2:], STEP)).collect()}
    assert got[0, 2] == anew[2] and got[0, 3] == anew[3] and len(got) == 5


def test_replayed_memory_of_the_events(spark, small):
    """A recorded result, checked by hand on its first steps."""
    from tessera.catalog import QUERIES

    got = QUERIES["memory_replay"](spark, small)
    total = got.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("n_notes", "n_bridges", "n_seen", "n_repairs")), F.round(F.sum("tail_start"), 3).alias("tail_start")).first()
    assert tuple(total) == RECORDED


def test_snapshots_see_the_prefix_only(spark):
    ship(spark)
    schema = "video_id long, step_index long, step_start double, step_end double, events " + tagged.EVENT + ", question string, answer string"
    rows = [(1, i, 5.0 * i, 5.0 * i + 5, [("bridge", 5.0 * i, 5.0 * i + 5, f"part {i}")], None, "") for i in range(4)]
    queries = spark.createDataFrame([(1, "early", 1.0), (1, "mid", 10.0), (1, "late", 99.0), (2, "other", 3.0)], "video_id long, query_id string, at double")
    got = {r.query_id: r.memory for r in memory.snapshots(spark.createDataFrame(rows, schema), queries).collect()}
    assert got["early"] == got["other"] == "" and "part 1" in got["mid"] and "part 2" not in got["mid"] and "part 3" in got["late"]


def test_streamed_windows_are_batch_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = windows.stream_of(spark, str(tmp_path / "in"), events.schema)
    q = windows.tumbling(stream, "ts", "1 day", ["event_type"], "60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = windows.tumbling(events, "ts", "1 day", ["event_type"]).collect()
    assert {(r.start, r.event_type, r.n) for r in spark.table("tumbled").collect()} == {(r.start, r.event_type, r.n) for r in want}


def test_readers_and_writers(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b double").schema
    good, bad = tmp_path / "x.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1, "b": 2.5}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n[3]\nnope\n')
    assert [tuple(r) for r in readers.strict_lines(spark, str(good), schema).collect()] == [(1, 2.5), (2, None)]
    with pytest.raises(Exception, match="not a JSON object"):
        readers.strict_lines(spark, str(bad), schema).collect()
    assert readers.lenient_lines(spark, str(bad), schema).cache().where("_bad is not null").count() >= 1
    assert readers.lines_or_nothing(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"a": 7}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"a": 8}, {"a": 9}]))
    got = readers.load(spark, f"{tmp_path}/w.json, {tmp_path}/l.json, {good}", schema)
    assert sorted(r.a for r in got.collect()) == [1, 2, 7, 8, 9]
    writers.lines(got, str(tmp_path / "out"), one_file=True)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.lines(got, str(tmp_path / "out"))
    assert readers.select_samples(got, ["a"], offset=1, limit=2).count() == 2
    assert writers.markdown(spark.createDataFrame([(1, None)], "x int, y double")).endswith("| 1 |  |")
    rows = spark.createDataFrame([("<image> what", "x", ["p"])], "q string, a string, i array<string>")
    assert writers.sharegpt_rows(rows, "q", "a", "i").first().messages[0].role == "user"
    with pytest.raises(Exception, match="image marks"):
        writers.sharegpt_rows(rows.withColumn("q", F.lit("none")), "q", "a", "i").collect()
    frames = spark.createDataFrame([("v", i) for i in (1, 2, 4)] + [("w", 1), ("w", 2)], "v string, i int")
    manifest = spark.createDataFrame([("v", 3), ("w", 2), ("x", 1)], "v string, n_frames int")
    assert {r.v: r.fault for r in readers.frame_gaps(frames, "v", "i", manifest, "n_frames").collect()} == {"v": "gap", "w": None, "x": "missing"}


def test_feedback_queue_and_buffer(spark):
    row = spark.range(1).select(tagged.feedback(F.array(F.lit("no_tags"), F.lit("no_tags"), F.lit("other"))).alias("x"), tagged.feedback(F.array().cast("array<string>")).alias("y")).first()
    assert row.x == "- Answer with the tags only.\n- Mind: other" and row.y == ""
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    assert sorted(r.id for r in windows.latest(df, ["k"], ["id"], 2).collect()) == [6, 7, 8, 9]
    assert windows.in_step(df, "id", 9, 3).count() == 4
    out = windows.buffer_shuffled(df, ["id"], 4, "s").orderBy("place").collect()
    assert [r.id // 4 for r in out] == [0] * 4 + [1] * 4 + [2] * 2 and [r.id for r in out] != list(range(10))
