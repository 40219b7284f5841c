"""What judges answer: scores in JSON, plain or nested or as checklists, and when a judge is asked at all."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which judges give scores, flags, and words for yes and no.
SCORE_NAMES, FLAG_NAMES = ("score", "value", "rating"), ("pass", "passed", "score", "value")
YES, NO = frozenset("1 true yes y pass passed".split()), frozenset("0 false no n fail failed".split())
STEP_SCORES = ("keyframe_selection", "bridge_quality", "semantic_alignment", "state_factuality")
PROCESS_CHECKS = {
    "delta_groundedness": (
        "delta_captures_action_progress", "delta_captures_state_or_location_changes", "delta_preserves_query_relevant_details", "delta_no_visual_hallucination",
        "delta_not_polluted_by_qa",
    ),
    "anchor_keyframe": ("anchor_count_valid", "anchor_time_and_body_valid", "anchor_representative_if_present", "first_window_rule_followed"),
    "semantic_alignment": ("semantic_output_coherent", "semantic_text_anchor_express_current_frames", "semantic_no_cross_step_contradiction"),
    "state_groundedness": (
        "state_uses_available_evidence", "state_identifies_question_scope", "state_decision_is_grounded", "state_no_visual_hallucination",
        "state_consistent_with_answer", "state_no_unreasonable_hallucination",
    ),
}


@dataclass(frozen=True)
class Form:
    """A kind of judgement: its scores, the checklists that may stand for some, other names, and how the scores make one."""

    scores: tuple[str, ...]
    checks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    instead: dict[str, str] = field(default_factory=dict)
    total: Callable[[dict[str, float], dict, bool], float] = lambda scores, said, listed: sum(scores.values()) / len(scores)


def _unit(x) -> float:
    try:
        return min(max(float(x), 0.0), 1.0)
    except (TypeError, ValueError):
        return 0.0


def _named(x, names: tuple[str, ...], plain: Callable):
    """plain of x, or of the first of the names that the object x has; an object without any is nothing."""
    while isinstance(x, dict):
        x = next((x[n] for n in names if n in x), None)
    return plain(x)


def number(x) -> float:
    """A score from 0 to 1, whether plain or in an object (one level)."""
    if isinstance(x, dict):
        x = next((x[n] for n in SCORE_NAMES if n in x), None)
    return 0.0 if isinstance(x, dict) else _unit(x)


def check(x) -> float:
    """Whether a check holds, from 0 to 1."""
    def plain(v) -> float:
        if isinstance(v, str):
            low = v.strip().lower()
            return 1.0 if low in YES else 0.0 if low in NO else _unit(low)
        return _unit(v)

    return _named(x, FLAG_NAMES, plain)


def _listed(said: dict, name: str) -> bool:
    return isinstance(said.get(name), dict) and isinstance(said[name].get("checks"), dict)


def _of_checks(said: dict, name: str, wanted: tuple[str, ...]) -> float:
    """The mean of a checklist, 0 if it is missing, lacks a wanted check, or one fails."""
    if not _listed(said, name):
        return 0.0
    given = said[name]["checks"]
    values = [check(given.get(k)) for k in wanted or given]
    return _unit(sum(values) / len(values)) if values and min(values) > 0 else 0.0


def _process_total(scores: dict[str, float], said: dict, listed: bool) -> float:
    return min(max(2.0 * sum(scores[k] for k in PROCESS_CHECKS) / len(PROCESS_CHECKS), 0.0), 2.0)


FORMS: dict[str, Form] = {
    "step": Form(STEP_SCORES, total=lambda scores, said, listed: number(said["overall"]) if "overall" in said else sum(scores.values()) / len(scores)),
    "process": Form((*PROCESS_CHECKS, "answer_reward"), PROCESS_CHECKS, {"anchor_keyframe": "note_keyframe"}, _process_total),
    "answer": Form(("answer_reward",)),
}


def outer_object(raw: str | None) -> dict | None:
    """The text as a JSON object, or what lies between its first and last brace; null if neither is one."""
    text = raw or ""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def _texts(x) -> list[str]:
    items = x if isinstance(x, list) else [x] if isinstance(x, str) else []
    return [s for s in (str(i).strip() for i in items) if s]


def judgement(raw: str | None, form: Form) -> dict | None:
    said = outer_object(raw)
    if said is None:
        return None
    listed = any(_listed(said, k) for k in form.checks)
    key = {k: form.instead[k] if k in form.instead and k not in said and form.instead[k] in said else k for k in form.scores}
    scores = {k: _of_checks(said, k, form.checks[k]) if listed and k in form.checks else number(said.get(key[k])) for k in form.scores}
    reasons = {k: str(said[key[k]].get("reason") or "").strip() for k in form.scores if isinstance(said.get(key[k]), dict)}
    issues = _texts(said.get("issues")) + [f"cap: {c}" for c in _texts(said.get("caps_applied"))]
    return {"score": form.total(scores, said, listed), "scores": scores, "reasons": {k: v for k, v in reasons.items() if v}, "issues": issues}


JUDGEMENT = "score double, scores map<string,double>, reasons map<string,string>, issues array<string>"


def judged_scores(raw: Column, form: str = "step") -> Column:
    """struct(score, scores, reasons, issues) of a judge's text; all null where it holds no JSON object."""
    rules = FORMS[form]

    @F.pandas_udf(JUDGEMENT)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [judgement(x, rules) or {} for x in texts]
        return pd.DataFrame([{k: r.get(k) for k in ("score", "scores", "reasons", "issues")} for r in rows], columns=["score", "scores", "reasons", "issues"], dtype=object)

    return parse(raw)


def needs_judge(correct: Column, applicable: Column, letter: Column, options: Column, expected: Column, answer: Column) -> Column:
    """Whether a wrong answer goes to a judge: only to an open question with an expected and a given answer."""
    filled = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return ~yes(correct) & yes(applicable) & ~filled(letter) & (F.coalesce(F.size(options), F.lit(0)) <= 0) & filled(expected) & filled(answer)


def with_fallback(correct: Column, asked: Column, accepted: Column) -> Column:
    """The answer is right if it was, or if the judge that was asked accepts it."""
    return F.coalesce(correct, F.lit(False)) | (asked & F.coalesce(accepted, F.lit(False)))


def id_list(x: Column) -> Column:
    """Ids as texts, from a JSON list, one JSON value or plain text; null, empty and [] are none."""
    text = F.trim(F.coalesce(x, F.lit("")))
    whole = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:string>", {"mode": "PERMISSIVE"})["v"]
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when((text == "") | (text == "[]"), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(F.coalesce(whole, text))))


def json_objects(x: Column, key: str | None = None) -> Column:
    """The objects of a JSON list (under key, of a JSON object; none if it has none) as texts; anything else fails the job."""
    inside = F.when(F.ltrim(x).startswith("{"), F.coalesce(F.get_json_object(x, f"$.{key}"), F.lit("[]"))).otherwise(x) if key else x
    items = F.when(F.ltrim(inside).startswith("["), F.from_json(inside, "array<string>"))
    good = items.isNotNull() & F.forall(F.coalesce(items, F.array().cast("array<string>")), lambda i: F.coalesce(F.ltrim(i).startswith("{"), F.lit(False)))
    return F.when(good, items).otherwise(F.raise_error(F.concat(F.lit("not a list of JSON objects: "), F.substring(F.coalesce(x, F.lit("null")), 1, 60))))
