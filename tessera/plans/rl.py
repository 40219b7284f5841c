"""Rollout queries: users are groups, event types trajectories, events turns, values scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import advantages as A
from tessera.operators import turns as U
from tessera.registry import Tables, query

S = "WITH s AS (SELECT event_id AS traj, user_id AS grp, value AS score, (event_id % 50 + 1)::DOUBLE AS length, (event_id // 3 % 4) AS turn, event_id % 7 <> 0 AS valid, event_type AS kind FROM events)"


def scores(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        e.alias("traj"), F.col("user_id").alias("group"), F.col("value").alias("score"), (e % 50 + 1).cast("double").alias("length"),
        (F.floor(e / 3) % 4).alias("turn"), (e % 7 != 0).alias("valid"), F.col("event_type").alias("kind"),
    )


def turns_of(t: Tables, traj: str = "kind") -> DataFrame:
    """scores with a position; trajectories are kinds of events, so that turns repeat, or single events."""
    rows = scores(t).withColumn("position", F.col("traj")).withColumn("id", F.col("traj"))
    return rows if traj == "traj" else rows.drop("traj").withColumnRenamed(traj, "traj")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("traj", F.round(F.col("advantage") + 0.00000031, 5).alias("advantage"))


@query(S + """
SELECT traj, round((score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END) / (CASE WHEN count(*) OVER w > 1 THEN stddev_samp(score) OVER w ELSE 1 END + 1e-6) + 0.00000031, 5) AS advantage FROM s WINDOW w AS (PARTITION BY grp)
""")
def advantage_grpo(t: Tables) -> DataFrame:
    return _rounded(A.advantage("grpo", scores(t)))


@query(S + """
SELECT traj, round(CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w * score - sum(score) OVER w) / (count(*) OVER w - 1) ELSE score END + 0.00000031, 5) AS advantage FROM s WINDOW w AS (PARTITION BY grp)
""")
def advantage_rloo(t: Tables) -> DataFrame:
    return _rounded(A.advantage("rloo", scores(t)))


@query(S + """
SELECT traj, round(CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w * score - sum(score) OVER w) / (count(*) OVER w - 1) ELSE 0 END + 0.00000031, 5) AS advantage FROM s WINDOW w AS (PARTITION BY grp)
""")
def advantage_rloo_vectorized(t: Tables) -> DataFrame:
    return _rounded(A.advantage("rloo_vectorized", scores(t)))


@query(S + """
SELECT traj, round(score - CASE WHEN count(*) OVER w > 1 THEN sum(length * score) OVER w / sum(length) OVER w ELSE 0 END + 0.00000031, 5) AS advantage FROM s WINDOW w AS (PARTITION BY grp)
""")
def advantage_opo(t: Tables) -> DataFrame:
    return _rounded(A.advantage("opo", scores(t)))


@query(S + """
SELECT traj, round((score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END) * count(*) OVER () / greatest(count_if(score <> 0) OVER (), 1) + 0.00000031, 5) AS advantage FROM s WINDOW w AS (PARTITION BY grp)
""")
def advantage_gpg(t: Tables) -> DataFrame:
    return _rounded(A.advantage("gpg", scores(t)))


@query(S + """
SELECT traj, round(CASE WHEN row_number() OVER w = 1 THEN score - nth_value(score, 2) OVER (PARTITION BY grp ORDER BY score DESC, traj ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE 0 END + 0.00000031, 5) AS advantage FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC, traj)
""")
def advantage_passk(t: Tables) -> DataFrame:
    return _rounded(A.advantage("passk", scores(t)))


@query(S + """
, c AS (SELECT traj, score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY grp))
SELECT traj, round((c - (SELECT avg(c) FROM c)) / sqrt((SELECT var_samp(c) FROM c) + 1e-8) + 0.00000031, 5) AS advantage FROM c
""")
def advantage_reinforce_baseline(t: Tables) -> DataFrame:
    return _rounded(A.advantage("reinforce_baseline", scores(t)))


@query(S + """
, v AS (SELECT *, CASE WHEN valid THEN score END AS x FROM s)
SELECT traj, round(CASE WHEN valid AND count(x) OVER w > 1 AND stddev_samp(x) OVER w >= 0.03 THEN (score - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6) ELSE 0 END + 0.00000031, 5) AS advantage FROM v WINDOW w AS (PARTITION BY grp, turn)
""")
def advantage_component(t: Tables) -> DataFrame:
    return _rounded(A.advantage("component", turns_of(t, traj="traj"), step="score", valid="valid", by_std=True))


@query(S + """
, u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp, kind, turn ORDER BY traj) = 1), f AS (SELECT grp, kind, max_by(score, turn) AS m FROM u GROUP BY ALL), z AS (
  SELECT grp, kind, CASE WHEN count(*) OVER w > 1 THEN (m - avg(m) OVER w) / (stddev_samp(m) OVER w + 1e-6) ELSE 0 END AS a FROM f WINDOW w AS (PARTITION BY grp))
SELECT traj, round(a + 0.00000031, 5) AS advantage FROM s JOIN z USING (grp, kind)
""")
def advantage_trajectory(t: Tables) -> DataFrame:
    return A.advantage("trajectory", turns_of(t)).select(F.col("id").alias("traj"), F.round(F.col("advantage") + 0.00000031, 5).alias("advantage"))


@query("""
WITH f AS (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY ALL), k AS (SELECT user_id FROM f GROUP BY user_id HAVING count(m) > 1 AND stddev_samp(m) > 40)
SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM k)
""")
def filter_low_spread_groups(t: Tables) -> DataFrame:
    best = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("m"))
    return U.group_filter(t.events.join(best, ["user_id", "event_type"]), "m", U.Keys("user_id", "event_type", position="event_id"), 40.0).select("event_id")


@query("""
SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / 1000 * 0.5, 0), 6)::DOUBLE AS penalty FROM documents
""".replace("(n_chars - (4000 - 1000)) / 1000", "(n_chars - (4000 - 1000)) / 1000.0::DOUBLE"))
def overlong_penalty(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(A.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5), 6).alias("penalty"))


@query("""
SELECT user_id, event_type, round(0.1 * avg((value > 5)::INTEGER) + 0.3 * avg(value / 100) + 0.6 * max((value > 150)::INTEGER) + 0.000000031, 6) AS reward FROM events GROUP BY ALL
""")
def trajectory_rewards(t: Tables) -> DataFrame:
    v = F.col("value")
    rows = t.events.select("user_id", "event_type", (v > 5).cast("int").alias("f"), (v / 100).alias("s"), (v > 150).cast("int").alias("x"))
    return A.trajectory_reward(rows, ["user_id", "event_type"], (0.1, 0.3, 0.6), "f", "s", "x").select("user_id", "event_type", F.round(F.col("reward") + 0.000000031, 6).alias("reward"))


@query("""
SELECT event_id, round(CASE WHEN event_type = 'view' THEN value / greatest(count_if(event_type = 'click') OVER (PARTITION BY user_id), 1) ELSE value END, 6) AS reward FROM events
""")
def silence_rewards(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.col("value").alias("reward"), (F.col("event_type") == "view").alias("quiet"), (F.col("event_type") == "click").alias("said"))
    return A.silence_renormalised(rows, ["user_id"], "reward", "quiet", "said").select("event_id", F.round("reward", 6).alias("reward"))


@query("""
WITH p AS (SELECT vec_id, i, embedding[i]::DOUBLE AS a, embedding[i + 32]::DOUBLE AS b FROM embeddings, (SELECT unnest(range(1, 33)) AS i))
SELECT vec_id, round(sum(a - b), 5) AS k1, round(sum(0.5 * (a - b) * (a - b)), 5) AS k2, round(sum(exp(b - a) - (b - a) - 1), 5) AS k3, round(sum(least(exp(a - b), 1.1)), 5) AS weights FROM p GROUP BY vec_id
""")
def token_divergences(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select("vec_id", F.slice(v, 1, 32).alias("a"), F.slice(v, 33, 32).alias("b"), F.array_repeat(F.lit(1.0), 32).alias("m"))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), 5)
    return rows.select(
        "vec_id", *(total(A.kl(F.col("a"), F.col("b"), k)).alias(k) for k in ("k1", "k2", "k3")),
        total(A.importance_weights(F.col("a"), F.col("b"), F.col("m"), "token", 1.1)).alias("weights"),
    )


@query("""
WITH RECURSIVE p AS (SELECT vec_id, i, embedding[i]::DOUBLE AS r, embedding[i + 8]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 9)) AS i)), g AS (
  SELECT vec_id, 9 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS nv FROM embeddings
  UNION ALL SELECT g.vec_id, p.i, p.r + 0.9 * g.nv - p.v + 0.9 * 0.95 * g.a, p.v FROM g JOIN p ON p.vec_id = g.vec_id AND p.i = g.i - 1
)
SELECT vec_id, round(sum(a), 5) AS total FROM g WHERE i < 9 GROUP BY vec_id
""")
def generalised_advantages(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    out = A.gae(F.slice(v, 1, 8), F.slice(v, 9, 8), F.array_repeat(F.lit(1), 8), 0.9, 0.95)
    return t.embeddings.select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""
WITH p AS (SELECT vec_id, embedding[i]::DOUBLE AS a, embedding[i + 16]::DOUBLE AS b, embedding[i + 32]::DOUBLE AS d FROM embeddings, (SELECT unnest(range(1, 17)) AS i)), l AS (
  SELECT vec_id, d, greatest(-d * exp(a - b), -d * least(greatest(exp(a - b), 0.8), 1.28)) AS x FROM p)
SELECT vec_id, round(sum(CASE WHEN d < 0 THEN least(-d * 3.0, x) ELSE x END) / (16 + 1e-8), 6) AS loss FROM l GROUP BY vec_id
""")
def clipped_policy_loss(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select("vec_id", F.slice(v, 1, 16).alias("a"), F.slice(v, 17, 16).alias("b"), F.slice(v, 33, 16).alias("d"), F.array_repeat(F.lit(1.0), 16).alias("m"))
    return rows.select("vec_id", F.round(A.clipped_loss(F.col("a"), F.col("b"), F.col("d"), F.col("m"), 0.2, 0.28), 6).alias("loss"))
