"""Intervals as flat tables, exact selection and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import intervals as I
from tessera.operators import selection as S
from tessera.registry import Tables, query, seconds

#: Windows begin at purchases and last up to two days; points are views.
W = "WITH e AS (SELECT event_id, user_id, event_type, epoch(ts)::DOUBLE AS s FROM events), w AS (SELECT user_id, event_id AS window_id, s AS a, s + 3600.0 * (event_id % 48) AS b FROM e WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id, s FROM e WHERE event_type = 'view')"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", seconds("ts").alias("s"))


def _windows(t: Tables) -> DataFrame:
    rows = _events(t).where("event_type = 'purchase'")
    return rows.select("user_id", F.col("event_id").alias("window_id"), F.col("s").alias("a"), (F.col("s") + 3600.0 * (F.col("event_id") % 48)).alias("b"))


def _points(t: Tables) -> DataFrame:
    return _events(t).where("event_type = 'view'").select("user_id", "event_id", "s")


@query(W + "SELECT event_id, window_id FROM p JOIN w USING (user_id) WHERE s BETWEEN a AND b")
def points_within_windows(t: Tables) -> DataFrame:
    return I.overlapping(_points(t), _windows(t), ["user_id"], ("s", "s"), ("a", "b")).select("l.event_id", "r.window_id")


@query(W + ", x AS (SELECT event_id AS other, s AS a, s + 60.0 * (event_id % 11) * (event_id % 13) AS b FROM e WHERE event_type = 'error') SELECT window_id, other FROM x JOIN w ON x.a <= w.a + 600 AND w.a <= x.b")
def intervals_that_overlap(t: Tables) -> DataFrame:
    """Without a key: windows of ten minutes against others of up to two hours."""
    short = _windows(t).withColumn("b", F.col("a") + 600)
    other = _events(t).where("event_type = 'error'").select(F.col("event_id").alias("other"), F.col("s").alias("a"), (F.col("s") + 60.0 * (F.col("event_id") % 11) * (F.col("event_id") % 13)).alias("b"))
    return I.overlapping(short, other, [], ("a", "b"), ("a", "b")).select("l.window_id", "r.other")


@query(W + "SELECT event_id, (SELECT arg_min(window_id, (a, window_id)) FROM w WHERE w.user_id = p.user_id AND p.s BETWEEN a AND b) AS window_id FROM p")
def first_window_of_points(t: Tables) -> DataFrame:
    return I.holding(_points(t), _windows(t), ["user_id"], "s", ("a", "b"), ["a", "window_id"]).select("event_id", F.col("window.window_id").alias("window_id"))


@query(W + "SELECT event_id, count(window_id)::BIGINT AS n, max(b) AS last FROM p JOIN w USING (user_id) WHERE b <= s GROUP BY event_id")
def windows_that_ended(t: Tables) -> DataFrame:
    pairs = I.before(_points(t), _windows(t), ["user_id"], "s", "b")
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("n"), F.max("r.b").alias("last"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_quantity, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1500")
def least_rows_by_selection(t: Tables) -> DataFrame:
    keys = [F.col("l_quantity"), -F.col("l_extendedprice")]
    return S.first_n(t.lineitem, keys, 1500, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""
WITH r AS (SELECT user_id, value AS v, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k FROM events WINDOW w AS (PARTITION BY user_id)), c AS (
  SELECT *, pow(k / n, 4) - pow((k - 1) / n, 4) AS b, pow((n - k + 1) / n, 4) - pow((n - k) / n, 4) AS w FROM r)
SELECT user_id, round(sum(b * v), 4) AS best, round(sqrt(greatest(sum(b * v * v) - pow(sum(b * v), 2), 0)), 3) AS best_std, round(sum(w * v), 4) AS worst, round(sqrt(greatest(sum(w * v * v) - pow(sum(w * v), 2), 0)), 3) AS worst_std,
  round(avg(v), 4) AS mean, round(stddev_pop(v) / 2, 4) AS mean_std FROM c GROUP BY user_id
""")
def bootstrap_of_four(t: Tables) -> DataFrame:
    rows = A.bootstrap_of(t.events, ["user_id"], "value", 4)
    return rows.select("user_id", *(F.round(c, 3 if c in ("best_std", "worst_std") else 4).alias(c) for c in rows.columns if c != "user_id"))


@query("SELECT event_type, true AS mean_is_near, true AS std_is_near FROM events GROUP BY event_type HAVING count(*) > 30")
def resampled_means(t: Tables) -> DataFrame:
    """Poisson resampling of each type's mean: its spread is the standard error, within a fifth (1,000 replicates leave some 2 %)."""
    true_ = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("e"), F.count("*").alias("n"))
    rows = A.poisson_bootstrap(t.events, ["event_type"], F.col("event_id"), "value").join(true_, "event_type").where("n > 30")
    return rows.select("event_type", (F.abs(F.col("mean") - F.col("m")) < F.col("e") / 5).alias("mean_is_near"), (F.abs(F.col("std") / F.col("e") - 1) < 0.2).alias("std_is_near"))
