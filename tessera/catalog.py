"""Registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from tessera.plans import aggregation, annotation, curation, evaluation, extras, files, flat, forms, judging, ordered, packs, prompts, records, relational, rl, sampling, scripted, stateful, text, training, turns  # noqa: F401  (they register)
from tessera.registry import ORACLES, QUERIES

FLAGSHIP = "filter_first_failing_reason"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
