"""Estimators over turns of trajectories, of which a batch may hold copies.

Padded and resampled batches repeat rows of a (group, trajectory, turn). Each estimator counts a turn once, by its first row (the least
`position`), and gives every copy that turn's values. First rows, trajectories and cohorts are found by map-side aggregates and joined back by equi-joins, which
adaptive execution splits where a group is hot. Scores that are null, NaN or infinite count as zero; null keys are keys like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordered
from tessera.operators.advantages import EPS, estimator, two_level_gae


@dataclass(frozen=True)
class Keys:
    """Names of the columns that tell rows apart."""

    group: str = "group"
    traj: str = "traj"
    turn: str = "turn"
    position: str = "position"

    @property
    def of_turn(self) -> list[str]:
        return [self.group, self.traj, self.turn]

    @property
    def of_traj(self) -> list[str]:
        return [self.group, self.traj]

    @property
    def cohort(self) -> list[str]:
        return [self.group, self.turn]


def number(c: str | Column) -> Column:
    """A score as a double; null, NaN and infinite: 0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def judge_valid(status: Column) -> Column:
    """False if the judge failed: the status is error or aborted, whatever its case. Without a status, true."""
    return ~F.coalesce(F.lower(F.trim(status)).isin("error", "aborted"), F.lit(False))


def joined(rows: DataFrame, values: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """values (one row a key) joined to rows, whose columns of the same names go; null keys are equal."""
    if how == "left":
        rows = rows.drop(*(c for c in values.columns if c not in on))
    named = values.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_on_{c}`")) for c in on]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(named, condition, how).drop(*(f"_on_{c}" for c in on))


def first_rows(df: DataFrame, on: list[str], position: str, columns: dict[str, Column]) -> DataFrame:
    """(on, columns): of each key, the values of its first row."""
    item = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.groupBy(*on).agg(F.min_by(item, F.col(position)).alias("_first")).select(*on, "_first.*")


def _normalised(rows: DataFrame, by: list[str], value: str, valid: Column, to: str, by_std: bool, least_std: float | None) -> DataFrame:
    """Adds `to`, the value centred within `by` over valid rows, and `to`_valid: whether there were two of them, spread by more than least_std (None: any spread)."""
    stats = rows.where(valid).groupBy(*by).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_std"))
    out = joined(rows, stats, by)
    ok = valid & (F.coalesce("_n", F.lit(0)) > 1)
    ok = ok if least_std is None else ok & (F.col("_std") > least_std)
    centred = F.col(value) - F.col("_mean")
    centred = centred / (F.col("_std") + EPS) if by_std else centred
    return out.withColumn(to, F.when(ok, centred).otherwise(0.0)).withColumn(f"{to}_valid", ok).drop("_n", "_mean", "_std")


def _last_of_trajectories(turns: DataFrame, k: Keys, value: str) -> DataFrame:
    """(group, traj, value): that of the trajectory's last turn."""
    return turns.groupBy(*k.of_traj).agg(F.max_by(value, F.col(k.turn)).alias(value))


@estimator("trajectory")
def trajectory(df: DataFrame, score: str = "score", keys: Keys = Keys(), by_std: bool = True) -> DataFrame:
    """Adds advantage: the trajectory's score (that of its last turn) against its group; a trajectory alone gets 0."""
    turns = first_rows(df, keys.of_turn, keys.position, {"_score": number(score)})
    trajs = _normalised(_last_of_trajectories(turns, keys, "_score"), [keys.group], "_score", F.lit(True), "advantage", by_std, None)
    return joined(df, trajs.select(*keys.of_traj, "advantage"), keys.of_traj)


@estimator("trajectory_sum")
def trajectory_sum(
    df: DataFrame, step: str = "step", answer: str | None = None, valid: str | None = None, keys: Keys = Keys(), step_weight: float = 1.0, answer_weight: float = 1.0,
    by_std: bool = True, least_std: float = 0.0, exclude_invalid: bool = True,
) -> DataFrame:
    """Adds turn_reward, traj_score, advantage, signal_valid and traj_valid.

    A trajectory's score is the sum of its turns' weighted step and answer rewards (raw ones: credit that has been carried back would count twice).
    One with an invalid turn scores 0 and takes no part; without two others, or with a spread of least_std at most, a group has no signal and advantages of 0.
    """
    reward = step_weight * number(step) + answer_weight * (number(answer) if answer else F.lit(0.0))
    ok = F.coalesce(F.col(valid), F.lit(True)) if valid and exclude_invalid else F.lit(True)
    turns = first_rows(df, keys.of_turn, keys.position, {"turn_reward": reward, "_ok": ok})
    trajs = turns.groupBy(*keys.of_traj).agg(F.sum("turn_reward").alias("_sum"), F.bool_and("_ok").alias("traj_valid"))
    trajs = trajs.withColumn("traj_score", F.when(F.col("traj_valid"), F.col("_sum")).otherwise(0.0)).drop("_sum")
    trajs = _normalised(trajs, [keys.group], "traj_score", F.col("traj_valid"), "advantage", by_std, least_std).withColumnRenamed("advantage_valid", "signal_valid")
    return joined(joined(df, turns.drop("_ok"), keys.of_turn), trajs, keys.of_traj)


def four_dimensions(*scores: str) -> Column:
    """A step's reward from the judge's four dimensions: half their sum."""
    total = number(scores[0])
    for s in scores[1:]:
        total = total + number(s)
    return total / 2.0


def credits(df: DataFrame, step: str | Column = "step", answer: str | None = "answer", valid: str | None = None, keys: Keys = Keys(), beta: float = 0.7, step_weight: float = 1.0, answer_weight: float = 1.0) -> DataFrame:
    """One row a turn: step, answer, credit, reward, valid and credit_valid.

    A turn's credit is its answer's reward and beta times the next turn's credit; its reward weighs step and credit. credit_valid: no turn from this one on is invalid.
    """
    ok = F.coalesce(F.col(valid), F.lit(True)) if valid else F.lit(True)
    turns = first_rows(df, keys.of_turn, keys.position, {"step": number(step), "answer": number(answer) if answer else F.lit(0.0), "valid": ok})
    item = F.struct(F.col(keys.turn).alias("t"), "step", "answer", "valid")
    trajs = turns.groupBy(*keys.of_traj).agg(F.array_sort(F.collect_list(item)).alias("_turns"), F.max(F.when(~F.col("valid"), F.col(keys.turn))).alias("_bad"))  # a trajectory's turns
    credit = ordered.discounted(F.transform("_turns", lambda x: x["answer"]), max(beta, 0.0))
    each = trajs.withColumn("_credit", credit).select(*keys.of_traj, "_bad", F.explode(F.arrays_zip("_turns", "_credit")).alias("x"))
    out = each.select(
        *keys.of_traj, F.col("x._turns.t").alias(keys.turn), F.col("x._turns.step").alias("step"), F.col("x._turns.answer").alias("answer"), F.col("x._credit").alias("credit"),
        F.col("x._turns.valid").alias("valid"), (F.col("_bad").isNull() | (F.col("x._turns.t") > F.col("_bad"))).alias("credit_valid"),
    )
    return out.withColumn("reward", step_weight * F.col("step") + answer_weight * F.col("credit"))


@estimator("component")
def component(
    df: DataFrame, step: str | Column = "step", answer: str | None = None, valid: str | None = None, keys: Keys = Keys(), beta: float = 0.7, step_weight: float = 1.0, answer_weight: float = 1.0,
    by_std: bool = False, least_std: float = 0.03,
) -> DataFrame:
    """Adds step_advantage, answer_advantage, advantage (their weighted sum), step_valid, answer_valid, update_valid and reward.

    Steps and credits are centred apart, each within (group, turn): steps over turns that are valid, credits over those after which nothing is invalid.
    A cohort of one, or with a spread of least_std at most, has no signal. What is invalid counts as 0 in the reward.
    """
    turns = credits(df, step, answer, valid, keys, beta, step_weight, answer_weight)
    turns = _normalised(turns, keys.cohort, "step", F.col("valid"), "step_advantage", by_std, least_std)
    turns = _normalised(turns, keys.cohort, "credit", F.col("credit_valid"), "answer_advantage", by_std, least_std)
    reward = step_weight * F.when(F.col("valid"), F.col("step")).otherwise(0.0) + answer_weight * F.when(F.col("credit_valid"), F.col("credit")).otherwise(0.0)
    turns = turns.select(
        *keys.of_turn, "step_advantage", "answer_advantage", (step_weight * F.col("step_advantage") + answer_weight * F.col("answer_advantage")).alias("advantage"),
        F.col("step_advantage_valid").alias("step_valid"), F.col("answer_advantage_valid").alias("answer_valid"),
        (F.col("step_advantage_valid") | F.col("answer_advantage_valid")).alias("update_valid"), reward.alias("reward"),
    )
    return joined(df, turns, keys.of_turn)


@estimator("mixed")
def mixed(df: DataFrame, outcome: str = "outcome", states: dict[str, float] | None = None, keys: Keys = Keys(), alpha: float = 0.8, by_std: bool = False) -> DataFrame:
    """Adds advantage: alpha times the trajectory's outcome (its last turn's) centred in its group, and the rest of the weighted states' sum centred in (group, turn)."""
    share, total = min(max(alpha, 0.0), 1.0), F.lit(0.0)
    for name, weight in (states or {"state": 1.0}).items():
        total = total + weight * number(name)
    turns = first_rows(df, keys.of_turn, keys.position, {"_outcome": number(outcome), "_state": total})
    trajs = _normalised(_last_of_trajectories(turns, keys, "_outcome"), [keys.group], "_outcome", F.lit(True), "_o", by_std, None).select(*keys.of_traj, "_o")
    turns = _normalised(turns, keys.cohort, "_state", F.lit(True), "_s", by_std, None)
    turns = joined(turns, trajs, keys.of_traj).select(*keys.of_turn, (share * F.col("_o") + (1 - share) * F.col("_s")).alias("advantage"))
    return joined(df, turns, keys.of_turn)


def _whitened(turns: DataFrame, mask: str) -> DataFrame:
    """Advantages less their mean over all masked tokens, by their standard deviation; one token at most stays as it is. Elsewhere 0."""
    add = lambda a, x: a + x
    live = F.filter(F.arrays_zip(F.col("advantages").alias("a"), F.col(mask).alias("m")), lambda x: x["m"] > 0)
    sums = turns.agg(
        F.sum(F.size(live)).alias("_n"), F.sum(F.aggregate(live, F.lit(0.0), lambda a, x: a + x["a"])).alias("_x"), F.sum(F.aggregate(live, F.lit(0.0), lambda a, x: a + x["a"] * x["a"])).alias("_xx"),
    )
    mean = F.col("_x") / F.col("_n")
    scale = sums.select(F.when(F.col("_n") > 1, mean).otherwise(0.0).alias("_mean"), F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_xx") - F.col("_n") * mean * mean, F.lit(0.0)) / (F.col("_n") - 1) + 1e-8)).otherwise(1.0).alias("_by"))
    white = F.transform(F.arrays_zip(F.col("advantages").alias("a"), F.col(mask).alias("m")), lambda x: F.when(x["m"] > 0, (x["a"] - F.col("_mean")) / F.col("_by")).otherwise(0.0))
    return turns.crossJoin(F.broadcast(scale)).withColumn("advantages", white).drop("_mean", "_by")  # one row


def _arrays(*names: str) -> dict[str, Column]:
    return {f"_{n}": F.col(n).cast("array<double>") for n in names}


@estimator("step_gae")
def step_gae(df: DataFrame, rewards: str = "rewards", values: str = "values", mask: str = "mask", keys: Keys = Keys(), gamma: float = 1.0, lam: float = 1.0, whiten: bool = True) -> DataFrame:
    """Adds advantages and returns of tokens: one recursion over all masked tokens of a trajectory, from turn to turn."""

    @F.pandas_udf("array<array<double>>")
    def scan(turns: pd.Series) -> pd.Series:
        rows = []
        for ts in turns:
            after = last = 0.0
            out = []
            for t in reversed(ts):
                got = [0.0] * len(t["r"])
                for i in range(len(got) - 1, -1, -1):
                    if t["m"][i] > 0:
                        last = t["r"][i] + gamma * after - t["v"][i] + gamma * lam * last
                        after, got[i] = t["v"][i], last
                out.append(got)
            rows.append(out[::-1])
        return pd.Series(rows, dtype=object)

    turns = first_rows(df, keys.of_turn, keys.position, _arrays(rewards, values, mask))
    item = F.struct(F.col(keys.turn).alias("t"), F.col(f"_{rewards}").alias("r"), F.col(f"_{values}").alias("v"), F.col(f"_{mask}").alias("m"))
    trajs = turns.groupBy(*keys.of_traj).agg(F.array_sort(F.collect_list(item)).alias("_turns"))  # a trajectory's tokens
    each = trajs.withColumn("_a", scan("_turns")).select(*keys.of_traj, F.explode(F.arrays_zip("_turns", "_a")).alias("x"))
    turns = each.select(*keys.of_traj, F.col("x._turns.t").alias(keys.turn), F.col("x._a").alias("advantages"), F.col("x._turns.v").alias("_v"), F.col("x._turns.m").alias("_m"))
    turns = turns.withColumn("returns", F.transform(F.arrays_zip(F.col("advantages").alias("a"), F.col("_v").alias("v"), F.col("_m").alias("m")), lambda x: F.when(x["m"] > 0, x["a"] + x["v"]).otherwise(0.0)))
    turns = _whitened(turns, "_m") if whiten else turns
    return joined(df, turns.drop("_v", "_m"), keys.of_turn)


@estimator("two_level_gae")
def two_level(
    df: DataFrame, rewards: str = "rewards", values: str = "values", mask: str = "mask", keys: Keys = Keys(), gamma: float = 1.0, lam: float = 1.0, turn_gamma: float | None = None, whiten: bool = True,
) -> DataFrame:
    """Adds advantages and returns of tokens: turns first (turn_gamma), whose returns are the rewards of their last tokens."""
    turns = first_rows(df, keys.of_turn, keys.position, _arrays(rewards, values, mask))
    turns = two_level_gae(turns, keys.of_traj, keys.turn, f"_{rewards}", f"_{values}", f"_{mask}", gamma, lam, turn_gamma)
    turns = _whitened(turns, f"_{mask}") if whiten else turns
    return joined(df, turns.select(*keys.of_turn, "advantages", "returns"), keys.of_turn)


def group_filter(df: DataFrame, metric: str, keys: Keys = Keys(), least_std: float = 1e-6) -> DataFrame:
    """Rows of groups with two trajectories at least whose values (each that of its first row) spread by more than least_std."""
    first = first_rows(df, keys.of_traj, keys.position, {"_m": number(metric)})
    kept = first.groupBy(keys.group).agg(F.count("*").alias("_n"), F.stddev_samp("_m").alias("_s")).where((F.col("_n") > 1) & (F.col("_s") > least_std)).select(keys.group)
    return joined(df, kept, [keys.group], "left_semi")


def cohort_filter(df: DataFrame, step: str = "step", answer: str | None = "answer", valid: str | None = None, keys: Keys = Keys(), **options) -> DataFrame:
    """Rows of turns that either signal of component() can teach something."""
    found = component(df.select(*keys.of_turn, keys.position, *dict.fromkeys(c for c in (step, answer, valid) if c)), step, answer, valid, keys, **options)
    kept = found.where("update_valid").select(*keys.of_turn).distinct()
    return joined(df, kept, keys.of_turn, "left_semi")
