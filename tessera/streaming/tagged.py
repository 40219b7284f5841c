"""Tagged step output: parsed by expressions, scored and repaired per step.

A step says <state>, <answer> and then notes (<anchor t="a-b"></anchor>) and bridges (<delta t="a-b">text</delta>) that
tile its time. Parsing is a set of built-in expressions; scoring and repairing look at one step's few events at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Tolerances in seconds for steps, intervals and gaps, and the texts that stand in for missing ones.
STEP_SLACK, INTERVAL_SLACK, GAP_SLACK = 0.51, 0.11, 1e-6
NO_BRIDGE = "The video continues through this interval, but no reliable delta description was recovered."
NO_STATE = "No usable state was recovered from the raw output."
ELEMENT = r"""(?s)(<state>.*?</state>|<answer>.*?</answer>|<anchor\s+t="[^"]+">\s*</anchor>|<delta\s+t="[^"]+">.*?</delta>)"""
EVENT = "array<struct<kind:string,start:double,end:double,text:string>>"


def elements(raw: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(ELEMENT), F.lit(1))


def _inner(e: Column, tag: str) -> Column:
    return T.stripped(F.regexp_extract(e, rf"(?s)^<{tag}[^>]*>(.*)</{tag}>$", 1))


def events(found: Column) -> Column:
    """Notes and bridges with proper intervals, in order."""
    timed = F.filter(found, lambda e: e.startswith("<anchor") | e.startswith("<delta"))
    each = F.transform(
        timed,
        lambda e: F.struct(
            F.when(e.startswith("<anchor"), "note").otherwise("bridge").alias("kind"), T.interval(F.regexp_extract(e, r'^<\w+\s+t="([^"]+)"', 1)).alias("i"),
            F.when(e.startswith("<delta"), _inner(e, "delta")).otherwise("").alias("text"),
        ),
    )
    return F.transform(F.filter(each, lambda e: e["i"].isNotNull()), lambda e: F.struct(e["kind"].alias("kind"), e["i"]["start"].alias("start"), e["i"]["end"].alias("end"), e["text"].alias("text")))


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds state, answer, events and issues (codes, in a fixed order); no Python is involved."""
    text = F.coalesce(F.col(raw), F.lit(""))
    df = df.withColumn("_e", elements(text))
    kinds = F.transform("_e", lambda e: F.when(e.startswith("<state"), "S").when(e.startswith("<answer"), "A").otherwise("E"))
    df = df.withColumn("_k", kinds).withColumn("events", events(F.col("_e")))
    last = lambda tag: F.element_at(F.filter("_e", lambda e: e.startswith(f"<{tag}>")), -1)
    df = df.withColumn("state", F.when(F.array_contains("_k", "S"), _inner(last("state"), "state"))).withColumn("answer", F.when(F.array_contains("_k", "A"), _inner(last("answer"), "answer")))
    some, n = F.size("_e") > 0, lambda k: F.size(F.filter("_k", lambda x: x == k))
    checks = {
        "text_outside_tags": T.stripped(F.regexp_replace(text, ELEMENT, "")) != "",
        "no_tags": ~some,
        "tag_parse_error": some & (F.size("events") < n("E")),
        "anchor_tag_format": some & text.rlike(r'(?s)<anchor\b[^>]*\bt="[^"]+"[^>]*/>'),
        "state_count": some & (n("S") != 1),
        "state_empty": some & (F.col("state") == ""),
        "state_contains_xml": some & F.col("state").rlike(r"</?\w"),
        "answer_count": some & (n("A") != 1),
        "missing_observation": some & (F.size("events") == 0),
        "tag_order": some & ~F.coalesce((F.get("_k", F.lit(0)) == "S") & (F.get("_k", F.lit(1)) == "A") & F.forall(F.slice("_k", F.lit(3), F.size("_k")), lambda k: k == "E"), F.lit(False)),
    }
    return df.withColumn("issues", F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items())))).drop("_e", "_k")


def recovered(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows of parsed() with notes from malformed tags (closed in themselves, with other attributes, or not closed) at the end of events, and their number n_recovered.

    A tag with a frame or an id, or with a time that some note has already (to a thousandth), gives none.
    """
    tags = F.regexp_extract_all(F.coalesce(F.col(raw), F.lit("")), F.lit(r"<anchor\b([^>]*)>"), F.lit(1))
    timed = F.filter(tags, lambda a: ~a.rlike(r"\b(?:frame|id)\s*="))
    found = F.filter(F.transform(timed, lambda a: T.interval(F.regexp_extract(a, r'\bt\s*=\s*["\']([^"\']*)["\']', 1))), lambda i: i.isNotNull())
    mark = lambda e: F.struct(F.round(e["start"], 3).alias("a"), F.round(e["end"], 3).alias("b"))
    known = F.transform(F.filter("events", lambda e: e["kind"] == "note"), mark)

    def first_ones(i: Column) -> Column:
        """Intervals, with their marks and those of known notes, that are the first of their mark and not known."""
        each = F.transform(i["found"], lambda e, k: F.struct(e["start"].alias("start"), e["end"].alias("end"), (F.array_position(i["marks"], i["marks"][k]) == k + 1).alias("first"), i["marks"][k].alias("mark")))
        return F.filter(each, lambda e: e["first"] & ~F.array_contains(i["known"], e["mark"]))

    new = T.once(found, lambda f: T.once(F.struct(f.alias("found"), F.transform(f, mark).alias("marks"), known.alias("known")), first_ones))
    notes = F.transform(new, lambda i: F.struct(F.lit("note").alias("kind"), i["start"].alias("start"), i["end"].alias("end"), F.lit("").alias("text")))
    return df.withColumn("_new", notes).withColumns({"events": F.concat("events", "_new"), "n_recovered": F.size("_new")}).drop("_new")


@dataclass
class Step:
    """What a step is held against: its frames (start, end), its bounds, and the open tail (start, end, text) before it."""

    start: float
    end: float
    frames: list[tuple[float, float]] = field(default_factory=list)
    tail: tuple[float, float, str] | None = None
    first: bool = False  # memory is empty: the first event must be a note on the first frame


def near(a: tuple, b: tuple, slack: float = INTERVAL_SLACK) -> bool:
    return abs(a[0] - b[0]) <= slack and abs(a[1] - b[1]) <= slack


def gaps(notes: list[tuple[float, float]], step: Step) -> list[tuple[float, float]]:
    """What sorted notes leave of the step (with its open tail): where bridges belong."""
    at, out = step.tail[0] if step.tail else step.start, []
    for a, b in [*notes, (step.end, step.end)]:
        if a > at + GAP_SLACK:
            out.append((at, a))
        at = b
    return out


def scored(found: list[tuple[str, float, float, str]], issues: list[str], step: Step) -> dict:
    """Four rewards of 0 or 1 and all issues of parsed events (kind, start, end, text)."""
    codes, bad = list(issues), {"format": bool(issues), "timing": False, "order": False, "tail": False}

    def fault(code: str, *kinds: str) -> None:
        codes.append(code)
        for k in kinds:
            bad[k] = True

    at = step.start
    for i, (kind, a, b, text) in enumerate(found):
        goes_on = False
        if kind == "note":
            hits = sum(near((a, b), f) for f in step.frames)
            if not hits:
                fault("note_time_unmatched", "timing")
                continue
            if hits > 1:
                fault("note_time_ambiguous", "timing")
        else:
            if not text.strip():
                fault("empty_bridge", "timing")
            if step.tail and i == 0:
                goes_on = abs(a - step.tail[0]) <= STEP_SLACK
                if not goes_on:
                    fault("open_tail_start_mismatch", "tail")
            if not goes_on and (a < step.start - STEP_SLACK or b > step.end + STEP_SLACK):
                fault("bridge_time_oob", "timing")
            elif goes_on and b > step.end + STEP_SLACK:
                fault("open_tail_end_oob", "tail")
        if not goes_on and a < at - STEP_SLACK:
            fault("event_overlap", "order", "timing")
        at = max(at, b)
    if step.tail and found and found[0][0] != "bridge":
        fault("missing_open_tail_bridge", "tail")
    if step.first and step.frames and not (found and found[0][0] == "note" and near(found[0][1:3], step.frames[0])):
        fault("missing_initial_anchor", "format", "timing")
    bridges = [(a, b) for kind, a, b, _ in found if kind == "bridge"]
    taken: dict[int, str] = {}
    for g in gaps(sorted((a, b) for kind, a, b, _ in found if kind == "note"), step):
        hits = [i for i, b in enumerate(bridges) if near(b, g)]
        if not hits:
            fault("missing_bridge_gap", "format")
        for k, i in enumerate(hits):
            if k == 0 or i not in taken:
                taken[i] = "used" if k == 0 else "again"
    for i in range(len(bridges)):
        if taken.get(i) != "used":
            fault("duplicate_bridge_gap" if i in taken else "invalid_bridge_gap", "format")
    return {
        "format_reward": int(not bad["format"]), "timing_reward": int(not bad["timing"]), "order_reward": int(not bad["order"]),
        "tail_reward": int(not bad["tail"]), "valid": not any(bad.values()), "issues": codes,
    }


def text_only_scored(found: list[tuple[str, float, float, str]], issues: list[str], step: Step) -> dict:
    """The variant without notes: exactly one bridge, over the whole step."""
    codes, bridges = list(issues), [e for e in found if e[0] == "bridge"]
    shape = bool(issues)
    if len(bridges) < len(found):
        codes.append("anchor_not_allowed")
        shape = True
    if len(bridges) != 1:
        codes.append("delta_count")
        shape = True
    empty, off = [not e[3].strip() for e in bridges], [not near(e[1:3], (step.start, step.end)) for e in bridges]
    for e, o in zip(empty, off, strict=True):
        codes += ["empty_delta"] * e + ["delta_time_mismatch"] * o
    timing = any(empty) or any(off)
    return {"format_reward": int(not shape), "timing_reward": int(not timing), "order_reward": int(not any(off)), "tail_reward": 1, "valid": not (shape or timing), "issues": codes}


def repaired(found: list[tuple[str, float, float, str]], step: Step) -> tuple[list[tuple[str, float, float, str]], list[str]]:
    """Events that tile the step, and what was repaired: notes snap to frames, one bridge for each gap."""
    done: list[str] = []
    notes: dict[tuple[float, float], tuple[float, float]] = {}
    sources: list[tuple[float, float, str]] = []
    for kind, a, b, text in found:
        if kind == "note":
            hits = [f for f in step.frames if abs(a - f[0]) <= INTERVAL_SLACK and abs(b - f[1]) <= INTERVAL_SLACK]  # near(), without a call a frame
            if len(hits) != 1:
                done.append("drop_note_time_unmatched" if not hits else "drop_note_time_ambiguous")
            elif (key := (round(hits[0][0], 3), round(hits[0][1], 3))) in notes:
                done.append("drop_duplicate_note")
            else:
                notes[key] = hits[0]
            continue
        if not text.strip():
            done.append("drop_empty_bridge")
            continue
        if step.tail and abs(a - step.tail[0]) <= STEP_SLACK:
            a = step.tail[0]
            if b > step.end or b < step.start:
                done.append("clamp_open_tail_end" if b > step.end else "extend_open_tail_end")
                b = step.end
        elif (max(a, step.start), min(b, step.end)) != (a, b):
            done.append("clamp_bridge_interval")
            a, b = max(a, step.start), min(b, step.end)
        if a >= b:
            done.append("drop_invalid_bridge_interval")
        else:
            sources.append((a, b, text.strip()))
    kept = sorted(notes.values())
    if step.first and step.frames and not any(near(n, step.frames[0]) for n in kept):
        done.append("add_initial_anchor")
        kept = sorted([step.frames[0], *kept])
    used: set[int] = set()
    out: list[tuple[str, float, float, str]] = [("note", a, b, "") for a, b in kept]
    for g in gaps(kept, step):
        i, text = _source(sources, g, used), NO_BRIDGE
        on_tail = step.tail is not None and abs(g[0] - step.tail[0]) <= INTERVAL_SLACK
        if i is None:
            done.append("add_missing_bridge_gap")
            text = step.tail[2].strip() or NO_BRIDGE if on_tail else NO_BRIDGE
        else:
            used.add(i)
            a, b, text = sources[i]
            if not near((a, b), g):
                done.append("adjust_bridge_gap")
            if on_tail and a > step.tail[0] + INTERVAL_SLACK:
                old = step.tail[2].strip()
                text = text if not old else old if old == text else f"{old} {text}"
                done.append("merge_open_tail_bridge_text")
        out.append(("bridge", *g, text))
    if len(used) < len(sources):
        done.append("drop_invalid_bridge_gap")
    return sorted(out, key=lambda e: (e[1], e[2], e[0] != "bridge")), done


def _source(sources: list[tuple[float, float, str]], gap: tuple[float, float], used: set[int]) -> int | None:
    """The unused bridge on the gap, else the one that overlaps it most, then lies nearest."""
    free = [i for i in range(len(sources)) if i not in used]
    for i in free:
        if near(sources[i], gap):
            return i
    if not free:
        return None

    def rank(i: int) -> tuple[float, float]:
        a, b, _ = sources[i]
        return -max(0.0, min(b, gap[1]) - max(a, gap[0])), abs(a - gap[0]) + abs(b - gap[1])

    touching = [i for i in free if rank(i)[0] < 0 or abs(sources[i][0] - gap[0]) <= STEP_SLACK or abs(sources[i][1] - gap[1]) <= STEP_SLACK]
    return min(touching, key=rank, default=None)


QUALITY = "format_reward int, timing_reward int, order_reward int, tail_reward int, valid boolean, issues array<string>"


def with_quality(df: DataFrame, text_only: bool = False) -> DataFrame:
    """Adds quality to rows of parsed(): columns step_start, step_end and optional frames, tail and first."""
    grade = text_only_scored if text_only else scored

    @F.pandas_udf(QUALITY)
    def quality(events: pd.Series, issues: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = []
        for es, ii, a, b in zip(events, issues, start, end, strict=True):
            frames = [(float(x), float(x) + 1) for x in range(int(a), int(b))]
            rows.append(grade([(e["kind"], e["start"], e["end"], e["text"]) for e in es], list(ii), Step(a, b, frames)))
        return pd.DataFrame(rows, columns=["format_reward", "timing_reward", "order_reward", "tail_reward", "valid", "issues"])

    return df.withColumn("quality", quality("events", "issues", "step_start", "step_end"))


#: What to tell a model whose step had an issue; codes without a hint are named.
HINTS = {
    "text_outside_tags": "Write nothing outside the tags.", "no_tags": "Answer with the tags only.", "tag_parse_error": 'Give every interval as t="start-end" with start before end.',
    "anchor_tag_format": "Close anchors with their own end tag.", "state_count": "Write exactly one <state>.", "state_empty": "Say something in <state>.", "state_contains_xml": "Write no tags inside <state>.",
    "answer_count": "Write exactly one <answer>.", "missing_observation": "Write at least one <anchor> or <delta>.", "tag_order": "Begin with <state>, then <answer>, then the observations.",
    "note_time_unmatched": "Take anchor times from the given frames.", "note_time_ambiguous": "An anchor must fit one frame only.", "empty_bridge": "Describe the interval in every <delta>.",
    "open_tail_start_mismatch": "Begin the first <delta> where the open one begins.", "missing_open_tail_bridge": "Begin with a <delta> that goes on from the open one.", "open_tail_end_oob": "End the first <delta> within this step.",
    "bridge_time_oob": "Keep every <delta> within this step.", "event_overlap": "Put events in order of time, without overlaps.", "missing_initial_anchor": "Begin with an <anchor> on the first frame.",
    "missing_bridge_gap": "Cover every gap between anchors with one <delta>.", "duplicate_bridge_gap": "Cover each gap once.", "invalid_bridge_gap": "Match every <delta> to a gap between anchors.",
}


def feedback(issues: Column) -> Column:
    """One line for each distinct issue, in order; empty without issues."""
    hints = F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv))
    return F.array_join(
        F.transform(
            F.array_distinct(issues),
            lambda c: F.concat(
                F.lit("- "), F.coalesce(F.get(F.filter(F.map_entries(hints), lambda e: e["key"] == c), F.lit(0))["value"], F.concat(F.lit("Mind: "), c)),
            ),
        ),
        "\n",
    )
