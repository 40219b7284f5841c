"""Metrics of rollouts: lengths, clipping, throughput, off-policy distance, validation at n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.aggregates import best_and_worst_of, majority


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, max, min) of columns in one pass."""
    aggs = df.agg(*(F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("max"), F.min(c).cast("double").alias("min")).alias(c) for c in columns))
    return aggs.select(F.inline(F.array(*columns)))


def data_metrics(df: DataFrame, response: str, most: int, returns: str, values: str) -> DataFrame:
    """Clip ratio, aborted ratio (nothing said) and explained variance of the values."""
    gap = F.col(returns) - F.col(values)
    return df.agg(
        F.avg((F.col(response) >= most).cast("double")).alias("clip_ratio"),
        F.avg((F.col(response) == 0).cast("double")).alias("aborted_ratio"),
        (1 - F.var_samp(gap) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"),
    )


def timings(df: DataFrame, seconds: str, tokens: str, devices: int) -> DataFrame:
    return df.agg((F.sum(seconds) * 1000 / F.sum(tokens)).alias("ms_per_token"), (F.sum(tokens) / (F.sum(seconds) * devices)).alias("tokens_per_second"))


def _mean(x: Column, m: Column) -> Column:
    add = lambda a, v: a + v
    return F.aggregate(F.zip_with(x, m, lambda v, w: v * w), F.lit(0.0), add) / (F.aggregate(m, F.lit(0.0), add) + 1e-8)


def off_policy(df: DataFrame, new: str, old: str, mask: str) -> DataFrame:
    """Means over rows: perplexities of both policies, kl, its k3 form and chi squared of tokens."""
    a, b, m = F.col(new), F.col(old), F.col(mask)
    gap = F.zip_with(a, b, lambda x, y: F.least(F.greatest(x - y, F.lit(-20.0)), F.lit(20.0)))
    return df.agg(
        F.avg(F.exp(-_mean(a, m))).alias("ppl_new"), F.avg(F.exp(-_mean(b, m))).alias("ppl_old"), F.avg(-_mean(gap, m)).alias("kl"),
        F.avg(_mean(F.transform(gap, lambda g: F.exp(g) - g - 1), m)).alias("k3"), F.avg(_mean(F.transform(gap, lambda g: F.exp(2 * g)), m) - 1).alias("chi2"),
    )


def rejection_mask(new: Column, old: Column, mask: Column, kind: str, low: float, high: float) -> Column:
    """The mask without tokens (token_k1, k2, k3) or without the whole sequence (seq_sum, seq_mean, seq_max) beyond bounds."""
    gap = F.zip_with(new, old, lambda x, y: x - y)
    level, form = kind.split("_")
    if level == "token":
        of = {"k1": lambda g: g, "k2": lambda g: 0.5 * g * g, "k3": lambda g: F.exp(g) - g - 1}[form]
        return F.zip_with(mask, gap, lambda m, g: F.when(of(g).between(low, high), m).otherwise(0.0))
    on = F.zip_with(gap, mask, lambda g, m: g * m)
    add = lambda a, v: a + v
    value = {"sum": F.aggregate(on, F.lit(0.0), add), "mean": _mean(gap, mask), "max": F.array_max(F.transform(on, F.abs))}[form]
    return F.when(value.between(low, high), mask).otherwise(F.transform(mask, lambda m: F.lit(0.0)))


def validation(df: DataFrame, source: str, uid: str, value: str, answer: str, order: str, sizes: list[int]) -> DataFrame:
    """(source, metric, value): mean and population std at N, expected best and worst of n, and the majority's value, averaged over prompts."""
    key = [source, uid]
    parts = [df.groupBy(*key).agg(F.avg(value).alias("value")).withColumn("metric", F.lit("mean")), df.groupBy(*key).agg(F.stddev_pop(value).alias("value")).withColumn("metric", F.lit("std"))]
    for n in sizes:
        found = best_and_worst_of(df, key, value, n)
        parts += [found.select(*key, F.col(w).alias("value"), F.lit(f"{w}@{n}").alias("metric")) for w in ("best", "worst")]
    parts.append(majority(df, key, answer, value, order).withColumn("metric", F.lit("maj")))
    out = parts[0].select(*key, "metric", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select(*key, "metric", F.col("value").cast("double").alias("value")))
    return out.groupBy(source, "metric").agg(F.avg("value").alias("value"))


def whitened(df: DataFrame, column: str, name: str) -> DataFrame:
    total = df.agg(F.avg(column).alias("_m"), F.var_samp(column).alias("_v"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, (F.col(column) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_m", "_v")  # one row


def path_weights(logp: Column, sum_pi_squared: Column, importance: Column | None = None) -> Column:
    """1 - 2 p + the sum of squared probabilities for each token, times the squared importance weight if given."""
    plain = F.zip_with(logp, sum_pi_squared, lambda p, s: 1 - 2 * F.exp(p) + s)
    return plain if importance is None else F.zip_with(plain, importance, lambda w, r: w * r * r)


def token_baseline(df: DataFrame, key: str, group: str, rewards: str, weights: str, mask: str | None = None, zero_tail: bool = False) -> DataFrame:
    """(key, place, advantage): returns to go less the group's baseline at each place, the sum of G W over the sum of W, W running weights.

    Places count the tokens that the mask keeps, over all turns of a row; a row alone in its group has baseline 0, rows without tokens don't
    count. zero_tail: places that only the longest row of a group has get baseline 0.
    """
    on = F.col(mask) if mask else F.transform(rewards, lambda r: F.lit(1.0))
    tokens = df.select(key, group, F.posexplode(F.arrays_zip(F.col(rewards).alias("r"), F.col(weights).alias("w"), on.alias("m"))).alias("place", "x")).where("x.m > 0")
    w = Window.partitionBy(key).orderBy("place")
    tokens = tokens.select(
        key, group, "place", (F.row_number().over(w) - 1).alias("_at"), F.sum("x.w").over(w).alias("_w"),
        F.sum("x.r").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_g"),
    )
    rows = tokens.groupBy(group).agg(F.count_distinct(key).alias("_rows"))
    tokens = tokens.join(rows, group)
    g = Window.partitionBy(group, "_at")
    several = (F.col("_rows") > 1) & ((F.count("*").over(g) > 1) if zero_tail else F.lit(True))
    base = F.when(several, F.sum(F.col("_g") * F.col("_w")).over(g) / (F.sum("_w").over(g) + 1e-8)).otherwise(0.0)
    return tokens.withColumn("advantage", F.col("_g") - base).select(key, "place", "advantage")


def softmax_statistics(logits: Column, chosen: Column) -> Column:
    """struct(logp of the chosen id, entropy, sum_pi_squared) of an array of logits; for small vocabularies."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    logp = lambda x: x - top - F.log(total)
    return F.struct(
        logp(F.get(logits, chosen)).alias("logp"), (-F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(logp(x)) * logp(x))).alias("entropy"),
        F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(2 * logp(x))).alias("sum_pi_squared"),
    )


def aggregated_loss(df: DataFrame, losses: str, mask: str, mode: str, scale: float = 1.0) -> DataFrame:
    """One loss of token losses: token-mean, seq-mean-token-sum, seq-mean-token-sum-norm (by scale) or seq-mean-token-mean; rows without tokens don't count."""
    add = lambda a, v: a + v
    total, n = F.aggregate(F.zip_with(losses, mask, lambda x, m: x * m), F.lit(0.0), add), F.aggregate(F.transform(mask, lambda m: m.cast("double")), F.lit(0.0), add)
    rows = df.select(total.alias("s"), n.alias("n"), (n > 0).cast("double").alias("on"))
    s, on = F.col("s"), F.col("on")
    out = {
        "token-mean": F.sum("s") / F.sum("n"), "seq-mean-token-sum": F.sum(s * on) / F.sum(on), "seq-mean-token-sum-norm": F.sum("s") / F.lit(scale),
        "seq-mean-token-mean": F.sum(s / (F.col("n") + 1e-8) * on) / F.sum(on),
    }[mode]
    return rows.agg(out.alias("loss"))


def variance_proxy(df: DataFrame, advantage: str, weight: str, gradient_norm: float) -> DataFrame:
    """Signal, total and noise: squared norm, mean of A**2 max(W, 0), and their difference over n - 1."""
    total = F.avg(F.col(advantage) * F.col(advantage) * F.greatest(F.col(weight), F.lit(0.0)))
    return df.agg(F.lit(gradient_norm**2).alias("signal"), total.alias("total"), F.greatest(F.lit(0.0), (total - gradient_norm**2) / (F.count("*") - 1)).alias("noise"))


def perplexity(nll: Column, mask: Column) -> Column:
    return F.exp(_mean(nll, mask))


def map_sums(df: DataFrame, key: list[str], counts: str) -> DataFrame:
    """Maps of counts added up for each key."""
    rows = df.select(*key, F.explode(counts).alias("_k", "_v")).groupBy(*key, "_k").agg(F.sum("_v").alias("_v"))
    return rows.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(counts))


def call_savings(df: DataFrame, group: list[str], size: str) -> DataFrame:
    """Calls made (one a group), questions they answered, and the share of calls saved."""
    first = df.groupBy(*group).agg(F.max(size).alias("n"))
    return first.agg(F.count("*").alias("calls"), F.sum("n").alias("questions"), (1 - F.count("*") / F.sum("n")).alias("saved"))


def cleaning_decision(rate: Column, scored: Column, errors: Column) -> Column:
    """What to do with a sample after repeated runs: retry, drop_easy, keep, or check (never passed)."""
    return F.when(scored == 0, "retry").when(errors * 2 > scored, "retry").when(rate >= 1, "drop_easy").when(rate > 0, "keep").otherwise("check")
