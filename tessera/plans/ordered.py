"""Ordered-sequence queries; users stand for videos and their events for steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.operators import ordered as O
from tessera.operators import sampling as P
from tessera.registry import Tables, query, seconds

E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch(ts) AS s FROM events)"


def events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", seconds("ts").alias("s"))


@query(E + """
, g AS (SELECT user_id, event_type, s - lag(s) OVER (PARTITION BY user_id, event_type ORDER BY s) AS gap FROM e)
SELECT user_id, event_type, round(min(gap), 4) AS gap FROM g GROUP BY ALL
""")
def least_gap_between_events(t: Tables) -> DataFrame:
    return O.least_adjacent_gap(events(t), ["user_id", "event_type"], "s").withColumn("gap", F.round("gap", 4))


@query(E + """
SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1)::INTEGER AS number FROM e
""")
def running_sequence_number(t: Tables) -> DataFrame:
    return O.running_number(events(t), ["user_id"], ["s", "event_id"]).select("event_id", "number")


@query("""
SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history,
       coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '') AS recent
FROM conversations
""")
def turn_history_and_recent(t: Tables) -> DataFrame:
    rows = O.history(t.conversations, ["conv_id"], ["turn"], F.col("role"))
    rows = O.recent(rows, ["conv_id"], ["turn"], F.col("role"), 3)
    return rows.select("conv_id", "turn", F.array_join("history", ">").alias("history"), F.array_join("recent", ">").alias("recent"))


@query(E + """
, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM e)
SELECT a.event_id, round(sum(b.value * pow(0.7, b.k - a.k)) + 0.0000031, 4) AS credit FROM n AS a JOIN n AS b ON a.user_id = b.user_id AND b.k >= a.k GROUP BY a.event_id
""")
def discounted_credit(t: Tables) -> DataFrame:
    steps = events(t).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", "value"))).alias("x"))
    credit = O.discounted(F.transform("x", lambda r: r["value"]), 0.7)
    rows = steps.select(F.explode(F.arrays_zip(F.col("x.event_id").alias("event_id"), credit.alias("credit"))).alias("r"))
    return rows.select("r.event_id", F.round(F.col("r.credit") + 0.0000031, 4).alias("credit"))


@query(E + """
SELECT event_id, min((value < 100)::INTEGER) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS all_later FROM e
""")
def valid_from_here_on(t: Tables) -> DataFrame:
    rows = events(t).withColumn("ok", F.col("value") < 100)
    return O.all_later(rows, ["user_id"], ["s", "event_id"], "ok").select("event_id", "all_later")


@query(E + """
, p AS (SELECT DISTINCT user_id, floor(s / 3600.0) AS h FROM e), k AS (
  SELECT user_id, list(h ORDER BY h) AS hs FROM p GROUP BY user_id
)
SELECT user_id, len(list_reduce(list_prepend([hs[1]], list_transform(hs[2:], lambda h: [h])), lambda acc, h: CASE WHEN h[1] - acc[-1] >= 7 THEN list_concat(acc, h) ELSE acc END))::BIGINT AS n_kept,
       list_sum(list_reduce(list_prepend([hs[1]], list_transform(hs[2:], lambda h: [h])), lambda acc, h: CASE WHEN h[1] - acc[-1] >= 7 THEN list_concat(acc, h) ELSE acc END))::DOUBLE AS total
FROM k
""")
def greedy_least_gap(t: Tables) -> DataFrame:
    hours = events(t).groupBy("user_id").agg(F.array_sort(F.collect_set(F.floor(F.col("s") / 3600).cast("double"))).alias("hs"))
    kept = hours.select("user_id", O.thinned(F.col("hs"), 7.0).alias("k"))
    return kept.select("user_id", F.size("k").cast("long").alias("n_kept"), F.aggregate("k", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(E.replace("WITH", "WITH RECURSIVE", 1) + """
, o AS (SELECT user_id, floor(s / 3600)::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, floor(s / 3600)) AS i FROM e), r AS (SELECT user_id, 0::BIGINT AS i, []::DOUBLE[] AS kept FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT r.user_id, o.i, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda k: abs(k - h) < 24)) = 0 THEN list_append(kept, h) ELSE kept END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, array_to_string(list_transform(list_sort(max_by(kept, i)), lambda k: printf('%.1f', k)), ',') AS chosen FROM r GROUP BY user_id
""")
def greedy_best_spread(t: Tables) -> DataFrame:
    steps = events(t).groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("score"), F.floor(F.col("s") / 3600).cast("double").alias("at"))).alias("x"))
    return steps.select("user_id", F.array_join(O.spread_best(F.col("x"), 24.0, 8).cast("array<string>"), ",").alias("chosen"))


@query(E + """
, w AS (SELECT user_id, s AS a, s + value * 60 AS b FROM e), m AS (
  SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w
), i AS (
  SELECT *, sum(CASE WHEN a - before < 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b) AS island FROM m
)
SELECT user_id, island::BIGINT AS island, round(min(a), 3) AS "start", round(max(b), 3) AS "end", count(*)::BIGINT AS n FROM i GROUP BY user_id, island
""")
def merged_windows(t: Tables) -> DataFrame:
    rows = events(t).withColumn("e", F.col("s") + F.col("value") * 60)
    return O.islands(rows, ["user_id"], "s", "e", 3600.0).select("user_id", "island", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("""
WITH h AS (SELECT DISTINCT user_id, (epoch(ts)::BIGINT - 1704067200) // 86400 AS d FROM events), p AS (
  SELECT user_id, d, coalesce(lag(d) OVER (PARTITION BY user_id ORDER BY d) + 1, 0) AS f, lead(d) OVER (PARTITION BY user_id ORDER BY d) IS NULL AS tail FROM h
), g AS (
  SELECT user_id, f AS a, d - 1 AS b FROM p WHERE f < d UNION ALL SELECT user_id, d + 1, 29 FROM p WHERE tail AND d < 29
)
SELECT user_id, s AS "start", least(s + 1, b) AS "end" FROM (SELECT user_id, b, unnest(range(a, b + 1, 2)) AS s FROM g)
""".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def windows_between_key_windows(t: Tables) -> DataFrame:
    days = events(t).select("user_id", F.floor((F.floor("s") - 1704067200) / 86400).alias("d")).distinct().withColumn("e", F.col("d"))
    return O.filled_gaps(days, ["user_id"], "d", "e", F.lit(0).cast("long"), F.lit(29).cast("long"), 2)


@query(E + """
, r AS (SELECT *, sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY s, event_id) AS part FROM e)
SELECT event_id, (row_number() OVER (PARTITION BY user_id, part ORDER BY s, event_id) - CASE WHEN part = 0 THEN 0 ELSE 1 END)::INTEGER AS streak FROM r
""")
def streak_since_reset(t: Tables) -> DataFrame:
    rows = events(t).withColumn("reset", F.col("event_type") == "purchase")
    return O.streak(rows, ["user_id"], ["s", "event_id"], "reset").select("event_id", "streak")


@query("""
SELECT conv_id, max_by(role || ':' || length(text), turn) AS answer FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id
""")
def last_non_empty_answer(t: Tables) -> DataFrame:
    rows = t.conversations.where("role = 'assistant'").withColumn("a", F.when(F.trim("text") != "", F.concat("role", F.lit(":"), F.length("text").cast("string"))))
    return O.last_answer(rows, ["conv_id"], "turn", "a")


@query(E + """
, l AS (SELECT user_id, list(value ORDER BY s, event_id) AS v FROM e GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: a * 0.6 + x * 0.4), 6) AS final FROM l
""")
def smoothed_values(t: Tables) -> DataFrame:
    steps = events(t).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", "value"))).alias("x"))
    return steps.select("user_id", F.round(F.element_at(O.smoothed(F.transform("x", lambda r: r["value"]), 0.6), -1), 6).alias("final"))


@query("""
WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) - 0.5) / count(*) OVER (PARTITION BY lang) AS p FROM documents)
SELECT doc_id, CASE WHEN p <= 0.8 THEN 'train' WHEN p <= 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM r
""")
def split_by_midpoint_rank(t: Tables) -> DataFrame:
    rows = P.stratum_assignment(t.documents.select("doc_id", "lang"), ["lang"], "s", ["doc_id"], {"train": 0.8, "val": 0.1, "test": 0.1})
    return rows.select("doc_id", "split")


@query(E + """
, p AS (SELECT user_id, s AS t, event_id FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, s AS vt, value FROM e WHERE event_type = 'view')
SELECT p.event_id, v.value AS "value", round(v.vt, 3) AS found_time FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.vt
""")
def as_of_last_view(t: Tables) -> DataFrame:
    e = events(t)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("s").alias("t"))
    right = e.where("event_type = 'view'").select("user_id", "s", "value")
    found = O.as_of(left, right, ["user_id"], "t", "s", ["value"])
    return found.select("event_id", "value", F.round("found_time", 3).alias("found_time"))


@query("""
SELECT event_id, least(greatest(5 + greatest(0, ceil((value - 1e-9) * 2)::BIGINT - 1), 5), 104)::BIGINT AS frame, floor(value / 5)::BIGINT AS step FROM events
""")
def frame_and_step_of_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.frame_of(F.col("value"), 2.0, 5, F.lit(5), F.lit(104)).cast("long").alias("frame"), F.floor(F.col("value") / 5).alias("step"))


@query(E + """
SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1) / 5)::BIGINT AS group_no FROM e
""")
def tumbling_count_groups(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    return events(t).select("event_id", F.floor((F.row_number().over(w) - 1) / 5).alias("group_no"))
