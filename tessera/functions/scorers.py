"""Answer scorers as expressions from 0 to 1, picked by name; own scorers can be registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

SCORERS: dict[str, Callable[[Column, Column, Column], Column]] = {}


def scorer(name: str) -> Callable:
    """Registers a function of (answer, gold, options)."""

    def add(f: Callable[[Column, Column, Column], Column]) -> Callable:
        SCORERS[name] = f
        return f

    return add


def _one(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


@scorer("exact")
def exact(answer: Column, gold: Column, options: Column | None = None) -> Column:
    a, g = T.answer_text(answer), T.answer_text(gold)
    return _one((a != "") & (a == g))


@scorer("contains")
def contains(answer: Column, gold: Column, options: Column | None = None) -> Column:
    a, g = T.answer_text(answer), T.answer_text(gold)
    return _one((a != "") & (g != "") & a.contains(g))


@scorer("mcq")
def mcq(answer: Column, gold: Column, options: Column | None = None) -> Column:
    """The letter said, or the gold option's text."""
    by_letter = T.choice(answer) == F.upper(gold)
    if options is None:
        return _one(by_letter)
    i = T.letter_index(gold, F.size(options))
    return _one(F.coalesce(by_letter, F.lit(False)) | F.coalesce(T.option_text(answer) == T.option_text(F.get(options, i)), F.lit(False)))


@scorer("yes_no")
def yes_no(answer: Column, gold: Column, options: Column | None = None) -> Column:
    return _one(F.coalesce(T.yes_no(answer) == T.yes_no(gold), F.lit(False)))


@scorer("count")
def count(answer: Column, gold: Column, options: Column | None = None) -> Column:
    """All digits of the answer together are the number."""
    return _one(T.digits(answer) == gold.cast("string"))


@scorer("em")
def em(answer: Column, gold: Column, options: Column | None = None) -> Column:
    return _one(T.exact_match_text(answer) == T.exact_match_text(gold))


@scorer("subem")
def subem(answer: Column, gold: Column, options: Column | None = None) -> Column:
    return _one(T.exact_match_text(answer).contains(T.exact_match_text(gold)))


@scorer("keyword_coverage")
def keyword_coverage(answer: Column, gold: Column, options: Column | None = None) -> Column:
    """Share of the gold's distinct words that the answer has; 0 if there are fewer than three."""
    want = F.array_distinct(T.words(gold))
    return F.when(F.size(want) < 3, 0.0).otherwise(F.size(F.array_intersect(want, T.words(answer))) / F.size(want))


@scorer("token_f1")
def token_f1(answer: Column, gold: Column, options: Column | None = None) -> Column:
    """F1 of the words' multisets."""
    a, g = T.words(answer), T.words(gold)
    shared = F.aggregate(F.array_distinct(F.array_intersect(a, g)), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(g, lambda x: x == w))))
    return F.when((F.size(a) + F.size(g)) == 0, 0.0).otherwise(2.0 * shared / (F.size(a) + F.size(g)))


def score_event(answer: Column, gold: Column, should_answer: Column, by: str = "exact") -> Column:
    """Silence scores where silence is due."""
    silent = T.stripped(F.coalesce(answer, F.lit(""))) == ""
    return F.when(~F.coalesce(should_answer, F.lit(True)), _one(silent)).otherwise(SCORERS[by](answer, gold, None))


def by_source(source: Column, answer: Column, gold: Column, rules: dict[str, str], other: str = "exact") -> Column:
    """The scorer that the data source asks for."""
    out = None
    for k, name in rules.items():
        x = SCORERS[name](answer, gold, None)
        out = F.when(source == k, x) if out is None else out.when(source == k, x)
    return SCORERS[other](answer, gold, None) if out is None else out.otherwise(SCORERS[other](answer, gold, None))


def difficulty(rate: Column) -> Column:
    third = 1 / 3
    return F.when(rate.isNull(), "unscored").when(rate >= 1, "easy").when(rate >= 2 * third - 1e-9, "medium").when(rate >= third - 1e-9, "hard").otherwise("unsolved")
