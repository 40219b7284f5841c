"""Memory of a stream: notes, bridges and questions of one video, replayed step by step.

replay() works on a batch table, grouped by video; live() keeps the same state between micro-batches.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessera.streaming.tagged import Step, repaired

@dataclass(frozen=True)
class Policy:
    """What is shown of the memory, whether bridges go on from step to step, whether steps are kept at all, and how many recent frames are shown instead."""

    notes: bool = True
    bridges: bool = True
    tail: bool = True
    keeps: bool = True
    frames: int = 0


POLICIES = {"full": Policy(), "anchor_only": Policy(bridges=False, tail=False), "delta_only": Policy(notes=False), "recent": Policy(False, False, False, True, 5), "none": Policy(False, False, False)}
WINDOW = 120.0


def _rank(record: list) -> tuple[float, bool]:
    return record[2], record[0] == "note"


class Memory:
    """Records are lists [kind, start, end, text, seen] by number; seen: the note's image is still there.

    What each step asks for is kept up to date: the latest record's number, the notes still seen, and counts. A memory between micro-batches holds only these and the
    records of its own batch; `older` gives those of before when all are asked for, `changed` says which to write back.
    """

    def __init__(self, window: float = WINDOW, older: Callable[[], dict[int, list]] | None = None, count: int = 0, n_notes: int = 0, latest: int | None = None, asked: bool = False):
        self.records: dict[int, list] = {}
        self.questions: list[tuple[float, str, str]] = []
        self.window, self._older, self.count, self.n_notes, self.latest, self.asked = window, older, count, n_notes, latest, asked
        self.seen: set[int] = set()
        self.changed: set[int] = set()

    def whole(self) -> dict[int, list]:
        """All records, those of earlier batches too."""
        if self._older:
            self.records, self._older = self._older() | self.records, None
        return self.records

    def evict(self, now: float) -> None:
        records, since = self.records, now - self.window
        gone = {i for i in self.seen if records[i][2] < since}
        for i in gone:
            self.records[i][4] = False
        self.seen -= gone
        self.changed |= gone

    def tail(self) -> tuple[float, float, str] | None:
        """The latest record if it is a bridge; at one end, notes come last."""
        last = self.records[self.latest] if self.latest is not None else None
        return (last[1], last[2], last[3]) if last and last[0] == "bridge" else None

    def _add(self, event: tuple[str, float, float, str]) -> None:
        record, i = [*event, True], self.count
        self.records[i] = record
        self.changed.add(i)
        self.count += 1
        if record[0] == "note":
            self.n_notes += 1
            self.seen.add(i)
        if self.latest is None or _rank(record) > _rank(self.records[self.latest]):
            self.latest = i

    def commit(self, events: list[tuple[str, float, float, str]], answer: str, now: float, goes_on: bool = True) -> None:
        """Adds a step's events; where bridges go on, the first one takes the open tail's place."""
        old = self.tail() if goes_on else None
        bridges = [e for e in events if e[0] == "bridge"]
        if old and bridges and abs(bridges[0][1] - old[0]) <= 0.11:
            last = self.records[self.latest]
            before = _rank(last)
            last[1:4] = bridges[0][1:4]  # a tail is the latest of all records, so of all bridges
            self.changed.add(self.latest)
            if _rank(last) < before:  # it ends earlier than it did: another one may be the latest
                self.latest = max(self.whole(), key=lambda i: (_rank(self.records[i]), -i))
            bridges = bridges[1:]
        for e in (*bridges, *(e for e in events if e[0] == "note")):
            self._add(e)
        if answer.strip() and self.asked:
            self.questions.append((now, "a", answer.strip()))

    def ask(self, at: float, question: str) -> None:
        self.questions.append((at, "q", question))
        self.asked = True

    def shown(self, policy: str = "full") -> str:
        p, records = POLICIES[policy], self.whole()
        found = sorted((records[i] for i in sorted(records) if (p.notes if records[i][0] == "note" else p.bridges)), key=lambda r: (r[1], r[0] == "note"))
        return "\n".join(f'<delta t="{a:.1f}-{b:.1f}">{text}</delta>' if kind == "bridge" else f'<anchor t="{a:.1f}-{b:.1f}">{"" if not seen else "[image]"}</anchor>' for kind, a, b, text, seen in found)

    def dialogue(self) -> str:
        return "\n".join(f'<qa t="{t:.1f}" role="{role}">{text}</qa>' for t, role, text in sorted(self.questions, key=lambda q: q[0])) or "<empty/>"


STEPS = "video_id long, step_index long, n_notes int, n_bridges int, n_seen int, tail_start double, n_repairs int, memory string"


def advance(memory: Memory, step_start: float, step_end: float, events: list, question: str | None, answer: str, policy: str, recovered: int = 0, shown: bool = True) -> dict:
    """One step: question in, old images out, events repaired and committed; recovered: how many of them come from malformed tags."""
    if question:
        memory.ask(step_start, question)
    memory.evict(step_end)
    frames = [(x + 0.0, x + 1.0) for x in range(int(step_start), int(step_end))]
    p = POLICIES[policy]
    fixed, done = repaired(events, Step(step_start, step_end, frames, memory.tail() if p.tail else None, not memory.count))
    memory.commit(fixed if p.keeps else [], answer or "", step_end, p.tail)
    tail = memory.tail()
    return {
        "n_notes": memory.n_notes, "n_bridges": memory.count - memory.n_notes, "n_seen": len(memory.seen), "tail_start": tail[0] if tail else None,
        "n_repairs": len(done) + (recovered > 0), "memory": memory.shown(policy) if shown else None,
    }


#: What is known of a step; n_recovered may be absent.
Given = namedtuple("Given", ["video_id", "step_index", "step_start", "step_end", "events", "question", "answer", "n_recovered"], defaults=[0])


def _as_text(steps: DataFrame) -> Column:
    """Each step as one JSON text, which Python reads much faster than nested columns."""
    return F.to_json(F.struct(*(c for c in Given._fields if c in steps.columns)), {"ignoreNullFields": "false"})


def _number(x: float | str | None) -> float | None:
    """JSON has no NaN and no infinite numbers: Spark writes their names."""
    return float(x) if isinstance(x, str) else x


def _given(text: str) -> Given:
    s = json.loads(text)
    s["events"] = [(e["kind"], _number(e["start"]), _number(e["end"]), e["text"]) for e in s["events"]]
    s["step_start"], s["step_end"] = _number(s["step_start"]), _number(s["step_end"])
    return Given(**s)


def _rows(memory: Memory, steps: Iterable[Given], policy: str, shown: bool = True) -> list[dict]:
    out = []
    for s in sorted(steps, key=lambda s: s.step_index):
        out.append({"video_id": s.video_id, "step_index": s.step_index, **advance(memory, s.step_start, s.step_end, s.events, s.question, s.answer, policy, s.n_recovered or 0, shown)})
    return out


def replay(steps: DataFrame, policy: str = "full", shown: bool = True) -> DataFrame:
    """Memory after each step; steps: video_id, step_index, step_start, step_end, events, question, answer, and n_recovered if malformed tags were read.

    The text of the memory is made only if shown.
    A group is one video's steps, whose number the video's length bounds.
    """
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in STEPS.split(", "))])

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_rows(Memory(), map(_given, table["_step"].to_pylist()), policy, shown), schema)

    return steps.select("video_id", _as_text(steps).alias("_step")).groupBy("video_id").applyInArrow(one, STEPS)


class Keeper(StatefulProcessor):
    """State of one video, or of several kept together: for each its counts, the latest record's number and the records that may still change (a value), all other records in chunks of a micro-batch (a map) and the dialogue (a list that grows at its end).

    Records that may still change are the notes still seen, as many as the window holds, and the latest record; a chunk holds those of which a micro-batch was the last to know this.
    So a micro-batch reads the value and writes it, one chunk and the end of the dialogue, however many steps it has and however long the videos are: each call of the state waits for the JVM's answer.
    Value and chunks are JSON texts, as Spark's Python side looks at each cell of a state. A record is [number, kind, start, end, text, seen, at].
    Only a shown memory, and a bridge that takes its end back, read all chunks; a record in several chunks is as the last one says, and as the value says if that has it.
    After `idle` milliseconds without a step (of the clock, or of event time) a timer drops the video's state; `ttl` milliseconds after a record was last changed (`at`), it goes by itself.
    """

    def __init__(self, policy: str, shown: bool, window: float, idle: int | None, ttl: int | None, time: str | None):
        self.policy, self.shown, self.window, self.idle, self.ttl, self.time = policy, shown, window, idle, ttl, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "n_chunks int, videos string", self.ttl)
        self.chunks = handle.getMapState("chunks", "chunk int", "videos string", self.ttl)
        self.dialogue = handle.getListState("dialogue", "video_id long, at double, role string, text string", self.ttl)

    def _kept(self, records: list[list], now: int) -> tuple[dict[int, list], dict[int, int]]:
        """Records that have not gone, and the times of their last changes, by number."""
        records = [r for r in records if not self.ttl or r[-1] + self.ttl > now]
        return {r[0]: r[1:-1] for r in records}, {r[0]: r[-1] for r in records}

    def _older(self, now: int) -> dict[int, tuple[dict[int, list], dict[int, int]]]:
        """By video, what the chunks hold."""
        found: dict[int, tuple[dict[int, list], dict[int, int]]] = {}
        for _, text in sorted((k[0], v[0]) for k, v in self.chunks.iterator()):
            for video, records in json.loads(text):
                for all_of_it, more in zip(found.setdefault(video, ({}, {})), self._kept(records, now), strict=True):
                    all_of_it |= more
        return found

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        by_video: dict[int, list[Given]] = {}
        last = 0
        for part in rows:
            for s in map(_given, part["step_text"]):
                by_video.setdefault(s.video_id, []).append(s)
            if self.time:
                last = max(last, int(part["step_at"].max()))
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        n_chunks, heads = self.head.get() or (0, "[]")
        videos, chunk, said, out = {v: head for v, *head in json.loads(heads)}, [], [], []
        older = cache(lambda: self._older(now))
        for video, steps in by_video.items():
            *counts, live = videos.get(video, (0, 0, None, False, []))
            records, at = self._kept(live, now)

            def before(video: int = video, at: dict[int, int] = at) -> dict[int, list]:
                found, times = older().get(video, ({}, {}))
                at |= times | at
                return {i: list(r) for i, r in found.items()}

            memory = Memory(self.window, before if n_chunks else None, *counts)
            memory.records, memory.latest = dict(records), memory.latest if memory.latest in records else None
            memory.seen = {i for i, r in records.items() if r[0] == "note" and r[4]}
            out.append(json.dumps(_rows(memory, steps, self.policy, self.shown)))
            at |= dict.fromkeys(memory.changed, now)
            held = memory.seen | ({memory.latest} if memory.latest is not None else set())
            settled = (records.keys() | memory.changed) - held
            held, settled = ([[i, *memory.records[i], at[i]] for i in sorted(which)] for which in (held, settled))
            videos[video] = [memory.count, memory.n_notes, memory.latest, memory.asked, held]
            if settled:
                chunk.append([video, settled])
            said += [(video, *q) for q in memory.questions]
        if chunk:
            self.chunks.updateValue((n_chunks,), (json.dumps(chunk),))
        self.head.update((n_chunks + bool(chunk), json.dumps([[v, *head] for v, head in videos.items()])))
        if said:
            self.dialogue.appendList(said)
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last if self.time else timerValues.getCurrentProcessingTimeInMs()) + self.idle)
        yield pd.DataFrame({"rows": out})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.head, self.chunks, self.dialogue):
            state.clear()
        return iter([])


def live(
    steps: DataFrame, policy: str = "full", shown: bool = True, window: float = WINDOW, idle: int | None = None, ttl: int | None = None, time: str | None = None, groups: int | None = None,
) -> DataFrame:
    """The same on a stream: state survives between micro-batches. Steps of a video come in order, or within one micro-batch in any.

    idle: milliseconds after which a video without steps is forgotten, by the clock, or by event time if `time` names the watermarked column.
    ttl: milliseconds that state lives after it was written (by the clock). Where either goes by the clock, batches go on without data, so that the stream needs a trigger that does not wait for its end.
    groups: keeps the videos' states together in so many groups, dealt by hash, in place of one by one: fewer calls of the state where a micro-batch has steps of most videos. A group's value is written whole, so that it should
    hold some dozens of videos; timers and times to live go by video, and allow none.
    """
    if groups and (idle or ttl):
        raise ValueError("a time after which a video's state goes needs states by video")
    spark = steps.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "EventTime" if time else "ProcessingTime" if idle or ttl else "None"
    key = F.pmod(F.xxhash64("video_id"), F.lit(groups)) if groups else F.coalesce(F.col("video_id").cast("string"), F.lit(""))  # never null, which pandas has no integers for
    at = [time, F.unix_millis(F.col(time).cast("timestamp")).alias("step_at")] if time else []
    rows = steps.select(key.alias("video_key"), _as_text(steps).alias("step_text"), *at)
    found = rows.groupBy("video_key").transformWithStateInPandas(Keeper(policy, shown, window, idle, ttl, time), "rows string", "append", mode)
    return found.select(F.inline(F.from_json("rows", f"array<struct<{STEPS.replace(', ', ',').replace(' ', ':')}>>", {"mode": "FAILFAST"})))


def snapshots(steps: DataFrame, queries: DataFrame, policy: str = "full") -> DataFrame:
    """(video_id, query_id, memory): what each query (query_id, at) sees; the common prefix of steps runs once for all of them."""
    names = ["video_id", "query_id", "memory"]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        memory, out = Memory(), []
        todo = sorted(b.itertuples(index=False), key=lambda q: (q.at, q.query_id), reverse=True)
        for r in [*a.sort_values("step_index").itertuples(index=False), None]:
            while todo and (r is None or todo[-1].at < r.step_end):
                q = todo.pop()
                out.append((q.video_id, q.query_id, memory.shown(policy)))
            if r is not None:
                advance(memory, r.step_start, r.step_end, [(e["kind"], e["start"], e["end"], e["text"]) for e in r.events], r.question, r.answer, policy)
        return pd.DataFrame(out, columns=names)

    kind = queries.schema["query_id"].dataType.simpleString()
    return steps.groupBy("video_id").cogroup(queries.groupBy("video_id")).applyInPandas(one, f"video_id long, query_id {kind}, memory string")
