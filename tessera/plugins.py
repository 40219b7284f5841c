"""Places where users hang in their own parts: named registries, functions by module path, model backends, curricula."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scorers as S


class Registry(dict):
    """Parts by name; a name is given once."""

    def __init__(self, what: str):
        super().__init__()
        self.what = what

    def register(self, name: str) -> Callable:
        def add(part):
            if name in self:
                raise ValueError(f"there is a {self.what} named {name}")
            self[name] = part
            return part

        return add

    def find(self, name: str):
        if name not in self:
            raise ValueError(f"no {self.what} named {name}; there are {', '.join(sorted(self))}")
        return self[name]


def loaded(path: str) -> Callable:
    """The function that "module:name" names."""
    module, colon, name = path.partition(":")
    if not colon or not name:
        raise ValueError(f"not a module:function: {path}")
    found = getattr(importlib.import_module(module), name)
    if not callable(found):
        raise ValueError(f"{path} is no function")
    return found


def scorer_of(name: str) -> Callable[[Column, Column, Column | None], Column]:
    """A scorer by its registered name, or a function (answer, gold, options) by its path."""
    return loaded(name) if ":" in name else S.SCORERS[name]


#: Ways to make rewards of rows: functions (df, answer, gold, source) that add reward.
MANAGERS = Registry("reward manager")


@MANAGERS.register("naive")
def naive(df: DataFrame, answer: str, gold: str, source: str, scorer: str = "em") -> DataFrame:
    """One scorer for all rows."""
    return df.withColumn("reward", scorer_of(scorer)(F.col(answer), F.col(gold), None))


@MANAGERS.register("by_source")
def by_source(df: DataFrame, answer: str, gold: str, source: str, rules: dict[str, str] | None = None, other: str = "em") -> DataFrame:
    """The scorer that the data source asks for."""
    return df.withColumn("reward", S.by_source(F.col(source), F.col(answer), F.col(gold), rules or {}, other))


@MANAGERS.register("overlong")
def overlong(df: DataFrame, answer: str, gold: str, source: str, length: str = "length", most: int = 1000, buffer: int = 200, factor: float = 1.0, scorer: str = "em") -> DataFrame:
    """A scorer, less the penalty for answers that come near the longest allowed length."""
    from tessera.operators.advantages import overlong_penalty

    return df.withColumn("reward", scorer_of(scorer)(F.col(answer), F.col(gold), None) + overlong_penalty(F.col(length), most, buffer, factor))


@MANAGERS.register("rate_limited")
def rate_limited(df: DataFrame, answer: str, gold: str, source: str, arrival: str = "arrival", key: str = "key", rate: float = 1.0, scorer: str = "em") -> DataFrame:
    """A scorer, with admitted: when each row's call may be made at a rate per second, in order of arrival within a key."""
    rows = df.withColumn("reward", scorer_of(scorer)(F.col(answer), F.col(gold), None))
    return admitted(rows, [key], arrival, rate)


def admitted(df: DataFrame, key: list[str], arrival: str, rate: float, order: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds admitted: the time of each row under a token bucket of one token that refills at `rate` a second: not before it arrives, nor sooner than 1 / rate after the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(arrival, *order)
    rows = df.withColumn("_i", F.row_number().over(w))
    lead = F.max(F.col(arrival) - F.col("_i") / rate).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("admitted", lead + F.col("_i") / rate).drop("_i")


class Backend(Protocol):
    """What makes text of prompts; it is sent to the executors and called with a batch."""

    def generate(self, prompts: list[str]) -> list[str]: ...


@dataclass
class MockBackend:
    """Answers from a table, else one text; for tests."""

    answers: dict[str, str] = field(default_factory=dict)
    other: str = "<state>mock</state><answer></answer>"

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, self.other) for p in prompts]


BACKENDS = Registry("backend")
BACKENDS.register("mock")(MockBackend)


def generated(df: DataFrame, prompt: str, backend: Backend, name: str = "generated") -> DataFrame:
    """Adds what the backend makes of each prompt, by Arrow batches; null prompts give null."""

    @F.pandas_udf("string")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            said = iter(backend.generate([p for p in b if p is not None]))
            yield pd.Series([None if p is None else next(said) for p in b], dtype=object)

    return df.withColumn(name, infer(F.col(prompt)))


class Curriculum:
    """Chances of sources that follow their pass rates: those in between count most, updated round by round."""

    def __init__(self, sources: list[str], floor: float = 0.1, memory: float = 0.5):
        self.weights, self.floor, self.memory = {s: 1.0 for s in sources}, floor, memory

    def update(self, results: DataFrame, source: str, passed: Column) -> dict[str, float]:
        """Moves each source's weight towards 4 p (1 - p) of its pass rate p; a row for each source comes to the driver."""
        for r in results.where(F.col(source).isin(list(self.weights))).groupBy(source).agg(F.avg(passed.cast("double")).alias("p")).collect():
            aim = max(self.floor, 4 * r.p * (1 - r.p))
            self.weights[r[source]] = self.memory * self.weights[r[source]] + (1 - self.memory) * aim
        return dict(self.weights)
