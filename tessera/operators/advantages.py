"""Group-relative advantages and rewards over rollouts, as windows; estimators are registered by name. Those over turns of trajectories are in turns.py."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}
EPS = 1e-6


def estimator(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ESTIMATORS[name] = f
        return f

    return add


def advantage(name: str, df: DataFrame, **options) -> DataFrame:
    """Adds advantage by the estimator of this name."""
    return ESTIMATORS[name](df, **options)


def _group(group: str):
    return Window.partitionBy(group)


@estimator("grpo")
def grpo(df: DataFrame, group: str = "group", score: str = "score", by_std: bool = True) -> DataFrame:
    """(s - mean) / (std + eps); a row alone keeps its score."""
    w = _group(group)
    n = F.count(score).over(w)
    mean, std = F.when(n > 1, F.avg(score).over(w)).otherwise(0.0), F.when(n > 1, F.stddev_samp(score).over(w)).otherwise(1.0)
    return df.withColumn("advantage", (F.col(score) - mean) / (std + EPS) if by_std else F.col(score) - mean)


@estimator("rloo")
def rloo(df: DataFrame, group: str = "group", score: str = "score") -> DataFrame:
    """Score less the mean of the others; a row alone keeps its score."""
    w = _group(group)
    n, total = F.count(score).over(w), F.sum(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col(score) - total) / (n - 1)).otherwise(F.col(score)))


@estimator("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group: str = "group", score: str = "score") -> DataFrame:
    w = _group(group)
    n, total = F.count(score).over(w), F.sum(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col(score) - total) / (n - 1)).otherwise(0.0))


@estimator("opo")
def opo(df: DataFrame, group: str = "group", score: str = "score", length: str = "length") -> DataFrame:
    """Score less the length-weighted mean; a row alone has the baseline 0."""
    w = _group(group)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count(score).over(w) > 1, base).otherwise(0.0))


@estimator("gpg")
def gpg(df: DataFrame, group: str = "group", score: str = "score") -> DataFrame:
    """Centred scores times rows over rows with a score other than zero."""
    w = _group(group)
    total = df.agg(F.count("*").alias("_rows"), F.count_if(F.col(score) != 0).alias("_hits"))
    mean = F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(0.0)
    rows = df.withColumn("_c", F.col(score) - mean).crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("advantage", F.col("_c") * F.col("_rows") / F.greatest("_hits", F.lit(1))).drop("_c", "_rows", "_hits")


@estimator("passk")
def passk(df: DataFrame, group: str = "group", score: str = "score", order: str = "traj") -> DataFrame:
    """Only the best row counts: by how much it beats the second; ties go to the earlier one. A group of one row has no second and fails the job."""
    w = Window.partitionBy(group).orderBy(F.desc(score), order)
    second = F.nth_value(score, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(
        "advantage",
        F.when(
            F.count("*").over(_group(group)) < 2, F.raise_error("a group of one row").cast("double"),
        ).when(F.row_number().over(w) == 1, F.col(score) - second).otherwise(0.0),
    )


@estimator("reinforce_baseline")
def reinforce_baseline(df: DataFrame, group: str = "group", score: str = "score") -> DataFrame:
    """Centred in the group, then whitened over all rows."""
    w = _group(group)
    rows = df.withColumn("_c", F.col(score) - F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(0.0))
    total = rows.agg(F.avg("_c").alias("_m"), F.var_samp("_c").alias("_v"))
    return rows.crossJoin(F.broadcast(total)).withColumn("advantage", (F.col("_c") - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_c", "_m", "_v")  # one row


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def trajectory_reward(df: DataFrame, traj: list[str], weights: tuple[float, float, float], format_: str, step: str, success: str) -> DataFrame:
    f, s, x = weights
    return df.groupBy(*traj).agg((f * F.avg(format_) + s * F.avg(step) + x * F.max(success)).alias("reward"))


def silence_renormalised(df: DataFrame, traj: list[str], reward: str, silent: str, answered: str) -> DataFrame:
    """Silent steps' rewards shared out over the trajectory's answers (at least one)."""
    n = F.sum(F.col(answered).cast("int")).over(Window.partitionBy(*traj))
    return df.withColumn(reward, F.when(F.col(silent), F.col(reward) / F.greatest(n, F.lit(1))).otherwise(F.col(reward)))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of an array in time order; masked steps pass the state on. One pass from the end, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def scan(rs: pd.Series, vs: pd.Series, ms: pd.Series) -> pd.Series:
        rows = []
        for r, v, m in zip(rs, vs, ms, strict=True):
            after, last, out = 0.0, 0.0, [0.0] * len(r)
            for i in range(len(r) - 1, -1, -1):
                if m[i] > 0:
                    last = r[i] + gamma * after - v[i] + gamma * lam * last
                    after = v[i]
                out[i] = last
            rows.append(out)
        return pd.Series(rows, dtype=object)

    return scan(rewards.cast("array<double>"), values.cast("array<double>"), mask.cast("array<double>"))


def two_level_gae(df: DataFrame, traj: list[str], turn: str, rewards: str, values: str, mask: str, gamma: float, lam: float, turn_gamma: float | None = None) -> DataFrame:
    """Adds advantages and returns of tokens: each turn's return over turns (its rewards, its last value) is the reward of its last token.

    Turns without tokens have none and pass the state on. A trajectory's turns, whose number its length bounds, go through one fold.
    """
    high = gamma if turn_gamma is None else turn_gamma
    live = F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(F.col(mask), i) > 0)
    last = F.element_at(live, -1)
    add = lambda a, x: a + x
    total = F.aggregate(F.zip_with(rewards, mask, lambda r, m: r * m), F.lit(0.0), add)
    rows = df.withColumns({"_some": F.size(live) > 0, "_last": F.when(F.size(live) > 0, last), "_r": total})
    item = F.struct(F.col(turn), F.when(F.col("_some"), F.get(F.col(values), F.col("_last"))).otherwise(0.0).alias("v"), F.col("_r").alias("r"), F.col("_some").cast("double").alias("m"))
    turns = rows.groupBy(*traj).agg(F.array_sort(F.collect_list(item)).alias("_t"))
    part = lambda n: F.transform("_t", lambda x: x[n])
    turns = turns.withColumn("_a", gae(part("r"), part("v"), part("m"), high, lam))
    each = turns.select(*traj, F.explode(F.arrays_zip("_t", "_a")).alias("x")).select(*traj, F.col(f"x._t.{turn}").alias(turn), (F.col("x._a") + F.col("x._t.v")).alias("_return"))
    rows = rows.join(each, [*traj, turn])
    final = F.transform(rewards, lambda r, i: F.when(i == F.col("_last"), F.col("_return")).otherwise(0.0))
    rows = rows.withColumn("_g", gae(final, F.col(values), F.col(mask), gamma, lam))
    on = lambda f: F.transform(F.arrays_zip(F.col("_g").alias("g"), F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: F.when(x["m"] > 0, f(x)).otherwise(0.0))
    return rows.withColumns({"advantages": on(lambda x: x["g"]), "returns": on(lambda x: x["g"] + x["v"])}).drop("_some", "_last", "_r", "_return", "_g")


def kl(new: Column, old: Column, kind: str = "k1") -> Column:
    """Per-token divergence from two arrays of log-probabilities: k1, abs, k2 or k3."""
    of = {
        "k1": lambda a, b: a - b,
        "abs": lambda a, b: F.abs(a - b),
        "k2": lambda a, b: 0.5 * (a - b) * (a - b),
        "k3": lambda a, b: F.least(F.greatest(F.exp(F.least(F.greatest(b - a, F.lit(-20.0)), F.lit(20.0))) - (b - a) - 1, F.lit(-10.0)), F.lit(10.0)),
    }[kind]
    return F.zip_with(new, old, of)


def importance_weights(new: Column, old: Column, mask: Column, level: str, most: float) -> Column:
    """Truncated ratios of two policies, by token or one for the sequence."""
    gap = F.transform(F.arrays_zip(new.alias("a"), old.alias("b"), mask.alias("m")), lambda x: (x["a"] - x["b"]) * x["m"])
    ratio = lambda g: F.least(F.exp(F.least(F.greatest(g, F.lit(-20.0)), F.lit(20.0))), F.lit(most))
    if level == "token":
        return F.transform(gap, ratio)
    total = F.aggregate(gap, F.lit(0.0), lambda a, g: a + g)
    return F.transform(mask, lambda m: ratio(total) * m)


def clipped_loss(new: Column, old: Column, adv: Column, mask: Column, low: float, high: float, dual: float = 3.0) -> Column:
    """Mean over the mask of the clipped policy loss."""
    def one(x: Column) -> Column:
        r = F.exp(F.least(F.greatest(x["a"] - x["b"], F.lit(-20.0)), F.lit(20.0)))
        plain = F.greatest(-x["d"] * r, -x["d"] * F.least(F.greatest(r, F.lit(1 - low)), F.lit(1 + high)))
        return F.when(x["d"] < 0, F.least(-x["d"] * dual, plain)).otherwise(plain) * x["m"]

    total = F.aggregate(F.transform(F.arrays_zip(new.alias("a"), old.alias("b"), adv.alias("d"), mask.alias("m")), one), F.lit(0.0), lambda a, x: a + x)
    return total / (F.aggregate(mask, F.lit(0.0), lambda a, m: a + m) + 1e-8)


@estimator("gdpo")
def gdpo(df: DataFrame, group: str = "group", scores: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of each component's group-relative value, whitened over all rows."""
    rows, total, names = df, F.lit(0.0), []
    for i, (c, weight) in enumerate((scores or {"score": 1.0}).items()):
        rows = grpo(rows, group, c).withColumnRenamed("advantage", f"_c{i}")
        total, names = total + weight * F.col(f"_c{i}"), [*names, f"_c{i}"]
    rows = rows.withColumn("_s", total).drop(*names)
    all_ = rows.agg(F.avg("_s").alias("_m"), F.var_samp("_s").alias("_v"))
    return rows.crossJoin(F.broadcast(all_)).withColumn("advantage", (F.col("_s") - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_s", "_m", "_v")  # one row


def answer_supervision(target: Column, wants_answer: Column, asked: Column, query_wants_answer: Column, said: Column) -> Column:
    """struct(kind, status): answer, silence or none, as a step's target, question and answer ask for."""
    pair = lambda kind, status: F.struct(F.lit(kind).alias("kind"), F.lit(status).alias("status"))
    return (
        F.when(target & wants_answer, pair("answer", "answer_target")).when(target, pair("silence", "answer_target_without_target"))
        .when(asked & query_wants_answer, pair("answer", "query_answer")).when(asked, pair("silence", "query_silence"))
        .when(said, pair("silence", "unprompted_answer")).otherwise(pair("none", ""))
    )


def answer_reward(score: Column, kind: Column, said: Column, status: Column, silence: float = 1.0, attempt: float = 0.1) -> Column:
    """Reward of a step's answer: silence pays where it is due; an answer where one is due pays its attempt and, from 0.5 on, one more."""
    right = F.when(score >= 0.5, 1.0).otherwise(0.0)
    return F.when((kind == "none") | (status == "parser_invalid"), 0.0).when(kind == "silence", F.when(said, 0.0).otherwise(silence)).otherwise(F.when(said, silence + attempt + right).otherwise(0.0))


def forced_answers(df: DataFrame, group: str, turn: str, asked: str, target: str, said: str, reward: str, silence: float = 1.0) -> DataFrame:
    """Where some of a (group, turn) answered though nothing was asked or due: answers earn nothing, silence its reward (forced: true)."""
    w = Window.partitionBy(group, turn)
    any_ = lambda c: F.coalesce(F.bool_or(F.col(c)).over(w), F.lit(False))
    forced = ~any_(asked) & ~any_(target) & any_(said)
    rows = df.withColumn("forced", forced)
    return rows.withColumn(reward, F.when(F.col("forced"), F.when(F.col(said), 0.0).otherwise(silence)).otherwise(F.col(reward)))


def sequence_ratio_loss(new: Column, old: Column, adv: Column, mask: Column, low: float, high: float) -> Column:
    """Clipped loss by one ratio for the sequence: the exponential of the masked mean of log ratios."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m) + 1e-8
    gap = F.aggregate(F.transform(F.arrays_zip(new.alias("a"), old.alias("b"), mask.alias("m")), lambda x: (x["a"] - x["b"]) * x["m"]), F.lit(0.0), lambda a, g: a + g) / n
    ratio = F.exp(F.least(gap, F.lit(10.0)))
    return F.aggregate(F.zip_with(adv, mask, lambda d, m: F.greatest(-d * ratio, -d * F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))) * m), F.lit(0.0), lambda a, x: a + x) / n


def weighted_likelihood_loss(new: Column, old: Column, adv: Column, mask: Column, low: float | None = None, high: float | None = None) -> Column:
    """-ratio * advantage * log-probability, ratios clipped (held constant); without bounds, ratios are one."""
    ratio = lambda x: F.lit(1.0) if low is None else F.least(F.greatest(F.exp(x["a"] - x["b"]), F.lit(1 - low)), F.lit(1 + high))
    total = F.aggregate(F.transform(F.arrays_zip(new.alias("a"), old.alias("b"), adv.alias("d"), mask.alias("m")), lambda x: -ratio(x) * x["d"] * x["a"] * x["m"]), F.lit(0.0), lambda a, v: a + v)
    return total / (F.aggregate(mask, F.lit(0.0), lambda a, m: a + m) + 1e-8)


class AdaptiveKl:
    """A coefficient that follows a target: it grows or shrinks with the error, cut to a fifth, a step."""

    def __init__(self, start: float, target: float, horizon: int):
        self.value, self.target, self.horizon = start, target, horizon

    def update(self, now: float, steps: int) -> float:
        error = min(max(now / self.target - 1, -0.2), 0.2)
        self.value *= 1 + error * steps / self.horizon
        return self.value


def adaptive_penalties(df: DataFrame, key: list[str], order: list[str], now: str, start: float, target: float, horizon: int, steps: int) -> DataFrame:
    """Adds penalty: the coefficient of AdaptiveKl after each row, in order; its steps are factors, so that their logarithms add up."""
    error = F.least(F.greatest(F.col(now) / target - 1, F.lit(-0.2)), F.lit(0.2))
    return df.withColumn("penalty", start * F.exp(F.sum(F.log(1 + error * steps / horizon)).over(Window.partitionBy(*key).orderBy(*order))))


def step_reward(process: Column, format_: Column, note: Column, w_process: float = 1.0, w_format: float = 0.1, w_note: float = 0.0, most: float = 1.0) -> Column:
    """Weighted process and format scores; with a weight for notes, a note score of zero voids the process score, and any other adds its weight."""
    cut = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
    value, weight = F.greatest(process, F.lit(0.0)), F.lit(w_process)
    if w_note > 0:
        value = F.when(cut(note) > 0, value).otherwise(0.0)
        weight = F.when(cut(note) > 0, w_process + w_note).otherwise(w_process)
    return F.greatest(weight * value + w_format * cut(format_), F.lit(0.0))


def note_frequency(df: DataFrame, key: list[str], order: list[str], notes: str, most: int, stale: int, full: float = 1.0, penalty: float = 0.0) -> DataFrame:
    """Adds note_score and note_reasons: too many notes in a step, or none for `stale` steps."""
    from tessera.operators.ordered import streak

    rows = streak(df.withColumn("_some", F.col(notes) > 0), key, order, "_some", "_streak")
    reasons = F.array_compact(F.array(F.when(F.col(notes) > most, "too_many_notes"), F.when(F.col("_streak") >= stale, "note_stale")))
    return rows.withColumn("note_reasons", reasons).withColumn("note_score", F.when(F.size("note_reasons") > 0, penalty).otherwise(full)).drop("_some", "_streak")
