"""Turns that a batch repeats: users are groups, event types trajectories, and several events of a user share a type and a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import advantages as A
from tessera.operators import turns as U
from tessera.plans.rl import S, turns_of
from tessera.registry import Tables, query
from tessera.shipping import ship

FIRST = S + ", u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp, kind, turn ORDER BY traj) = 1)"
#: Credits of the first rows: an answer pays length / 10 where it is over 2.5, and 0.7 of the next turn's credit comes back.
CREDIT = FIRST + """, a AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY turn) AS i, CASE WHEN length > 25 THEN length / 10 ELSE 0 END AS answer FROM u), c AS (
  SELECT x.grp, x.kind, x.turn, x.score, x.valid, sum(y.answer * pow(0.7, y.i - x.i)) AS credit, bool_and(y.valid) AS later
  FROM a AS x JOIN a AS y ON x.grp = y.grp AND x.kind = y.kind AND y.i >= x.i GROUP BY ALL)"""


def _answers(t: Tables) -> DataFrame:
    return turns_of(t).withColumn("answer", F.when(F.col("length") > 25, F.col("length") / 10).otherwise(0.0))


def _of(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("id").alias("event_id"), *(F.round(F.col(c) + 0.00000031, 5).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes if c in columns))


@query(CREDIT + """
SELECT s.traj AS event_id, round(credit + 0.00000031, 5) AS credit, round(2 * c.score + 0.5 * credit + 0.00000031, 5) AS reward, later AS credit_valid FROM s JOIN c USING (grp, kind, turn)
""")
def credits_of_repeated_turns(t: Tables) -> DataFrame:
    ship(t.spark)
    rows = _answers(t)
    found = U.credits(rows, "score", "answer", "valid", step_weight=2.0, answer_weight=0.5)
    return _of(U.joined(rows, found.select("group", "traj", "turn", "credit", "reward", "credit_valid"), ["group", "traj", "turn"]), "credit", "reward", "credit_valid")


@query(CREDIT + """
, v AS (SELECT *, CASE WHEN valid THEN score END AS x, CASE WHEN later THEN credit END AS y FROM c), z AS (
  SELECT grp, kind, turn, coalesce(valid AND count(x) OVER w > 1 AND stddev_samp(x) OVER w > 0.03, false) AS sv, coalesce(later AND count(y) OVER w > 1 AND stddev_samp(y) OVER w > 0.03, false) AS av, x - avg(x) OVER w AS sa, y - avg(y) OVER w AS aa FROM v WINDOW w AS (PARTITION BY grp, turn))
SELECT s.traj AS event_id, round(CASE WHEN sv THEN sa ELSE 0 END + 0.00000031, 5) AS step_advantage, round(CASE WHEN av THEN aa ELSE 0 END + 0.00000031, 5) AS answer_advantage,
  round(CASE WHEN sv THEN sa ELSE 0 END + 0.4 * CASE WHEN av THEN aa ELSE 0 END + 0.00000031, 5) AS advantage, sv AS step_valid, av AS answer_valid, sv OR av AS update_valid FROM s JOIN z USING (grp, kind, turn)
""")
def components_of_repeated_turns(t: Tables) -> DataFrame:
    ship(t.spark)
    rows = A.advantage("component", _answers(t), step="score", answer="answer", valid="valid", answer_weight=0.4)
    return _of(rows, "step_advantage", "answer_advantage", "advantage", "step_valid", "answer_valid", "update_valid")


@query(FIRST + """
, f AS (SELECT grp, kind, sum(1.5 * score + 0.5 * length) AS m, bool_and(valid) AS ok FROM u GROUP BY ALL), x AS (SELECT *, CASE WHEN ok THEN m END AS y FROM f), z AS (
  SELECT grp, kind, CASE WHEN ok THEN m ELSE 0 END AS traj_score, ok AS traj_valid, coalesce(ok AND count(y) OVER w > 1 AND stddev_samp(y) OVER w > 20, false) AS signal_valid, m - avg(y) OVER w AS a FROM x WINDOW w AS (PARTITION BY grp))
SELECT s.traj AS event_id, round(1.5 * u.score + 0.5 * u.length + 0.00000031, 5) AS turn_reward, round(traj_score + 0.00000031, 5) AS traj_score, traj_valid, signal_valid, round(CASE WHEN signal_valid THEN a ELSE 0 END + 0.00000031, 5) AS advantage
FROM s JOIN z USING (grp, kind) JOIN u USING (grp, kind, turn)
""")
def trajectory_sums_of_repeated_turns(t: Tables) -> DataFrame:
    rows = A.advantage("trajectory_sum", turns_of(t), step="score", answer="length", valid="valid", step_weight=1.5, answer_weight=0.5, by_std=False, least_std=20.0)
    return _of(rows, "turn_reward", "traj_score", "traj_valid", "signal_valid", "advantage")


@query(FIRST + """
, f AS (SELECT grp, kind, max_by(score, turn) AS m FROM u GROUP BY ALL), o AS (SELECT grp, kind, CASE WHEN count(*) OVER w > 1 THEN m - avg(m) OVER w ELSE 0 END AS o FROM f WINDOW w AS (PARTITION BY grp)), z AS (
  SELECT grp, kind, turn, CASE WHEN count(*) OVER w > 1 THEN 0.3 * score + length - avg(0.3 * score + length) OVER w ELSE 0 END AS z FROM u WINDOW w AS (PARTITION BY grp, turn))
SELECT s.traj AS event_id, round(0.8 * o + 0.2 * z + 0.00000031, 5) AS advantage FROM s JOIN o USING (grp, kind) JOIN z USING (grp, kind, turn)
""")
def mixed_advantages_of_repeated_turns(t: Tables) -> DataFrame:
    return _of(A.advantage("mixed", turns_of(t), outcome="score", states={"score": 0.3, "length": 1.0}), "advantage")


#: Two tokens a turn, the second of which is masked in every fifth event.
TOKENS = FIRST + ", k AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY turn) AS i, score / 100 AS r, length / 50 AS v0, (traj % 7)::DOUBLE AS v1, traj % 5 <> 0 AS two FROM u)"
#: Their places among the tokens that count, of a trajectory, from the last.
PLACED = TOKENS + """, p AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY i DESC, j DESC) AS q FROM (
  SELECT grp, kind, turn, i, 0 AS j, r, v0 AS v FROM k UNION ALL SELECT grp, kind, turn, i, 1, 2 * r, v1 FROM k WHERE two))"""


def _tokens(t: Tables) -> DataFrame:
    r, e = F.col("score") / 100, F.col("position")
    return turns_of(t).withColumns({
        "rewards": F.array(r, 2 * r, F.lit(9.0)), "values": F.array(F.col("length") / 50, (e % 7).cast("double"), F.lit(3.0)), "mask": F.array(F.lit(1.0), F.when(e % 5 != 0, 1.0).otherwise(0.0), F.lit(0.0)),
    })


def _first_two(rows: DataFrame) -> DataFrame:
    at = lambda c, i: F.round(F.col(c)[i] + 0.00000031, 5)
    return rows.select(F.col("id").alias("event_id"), at("advantages", 0).alias("first_advantage"), at("advantages", 1).alias("second_advantage"), at("returns", 0).alias("first_return"))


@query(PLACED.replace("WITH s", "WITH RECURSIVE s", 1) + """
, g AS (SELECT grp, kind, turn, j, q, v, r - v AS a FROM p WHERE q = 1 UNION ALL SELECT p.grp, p.kind, p.turn, p.j, p.q, p.v, p.r + 0.9 * g.v - p.v + 0.9 * 0.8 * g.a FROM g JOIN p ON p.grp = g.grp AND p.kind = g.kind AND p.q = g.q + 1),
w AS (SELECT avg(a) AS m, sqrt(var_samp(a) + 1e-8) AS d FROM g)
SELECT s.traj AS event_id, round((x.a - m) / d + 0.00000031, 5) AS first_advantage, round(coalesce((y.a - m) / d, 0) + 0.00000031, 5) AS second_advantage, round(x.a + x.v + 0.00000031, 5) AS first_return
FROM s JOIN g AS x ON s.grp = x.grp AND s.kind = x.kind AND s.turn = x.turn AND x.j = 0 LEFT JOIN g AS y ON s.grp = y.grp AND s.kind = y.kind AND s.turn = y.turn AND y.j = 1, w
""")
def token_advantages_of_repeated_turns(t: Tables) -> DataFrame:
    ship(t.spark)
    return _first_two(A.advantage("step_gae", _tokens(t), gamma=0.9, lam=0.8))


@query(TOKENS.replace("WITH s", "WITH RECURSIVE s", 1) + """
, t AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY i DESC) AS q, CASE WHEN two THEN 3 * r ELSE r END AS tr, CASE WHEN two THEN v1 ELSE v0 END AS tv FROM k),
h AS (SELECT grp, kind, turn, q, tv, tr - tv AS g FROM t WHERE q = 1 UNION ALL SELECT t.grp, t.kind, t.turn, t.q, t.tv, t.tr + 0.95 * h.tv - t.tv + 0.95 * 0.8 * h.g FROM h JOIN t ON t.grp = h.grp AND t.kind = h.kind AND t.q = h.q + 1),
b AS (SELECT grp, kind, turn, v0, two, CASE WHEN two THEN g + tv - v1 END AS second, CASE WHEN two THEN 0.9 * v1 - v0 + 0.9 * 0.8 * (g + tv - v1) ELSE g + tv - v0 END AS first FROM h JOIN t USING (grp, kind, turn, q, tv)),
w AS (SELECT avg(a) AS m, sqrt(var_samp(a) + 1e-8) AS d FROM (SELECT first AS a FROM b UNION ALL SELECT second FROM b WHERE two))
SELECT s.traj AS event_id, round((first - m) / d + 0.00000031, 5) AS first_advantage, round(coalesce((second - m) / d, 0) + 0.00000031, 5) AS second_advantage, round(first + v0 + 0.00000031, 5) AS first_return FROM s JOIN b USING (grp, kind, turn), w
""")
def two_level_advantages_of_repeated_turns(t: Tables) -> DataFrame:
    ship(t.spark)
    return _first_two(A.advantage("two_level_gae", _tokens(t), gamma=0.9, lam=0.8, turn_gamma=0.95))


@query(S + """
, f AS (SELECT grp, kind, min_by(score, traj) AS m FROM s GROUP BY ALL), k AS (SELECT grp FROM f GROUP BY grp HAVING count(*) > 1 AND stddev_samp(m) > 25)
SELECT traj AS event_id FROM s WHERE grp IN (SELECT grp FROM k)
""")
def groups_that_spread_by_first_rows(t: Tables) -> DataFrame:
    return U.group_filter(turns_of(t), "score", least_std=25.0).select(F.col("id").alias("event_id"))


@query(CREDIT + """
, v AS (SELECT *, CASE WHEN valid THEN score END AS x, CASE WHEN later THEN credit END AS y FROM c), z AS (
  SELECT grp, kind, turn, coalesce(valid AND count(x) OVER w > 1 AND stddev_samp(x) OVER w > 60, false) OR coalesce(later AND count(y) OVER w > 1 AND stddev_samp(y) OVER w > 60, false) AS keep FROM v WINDOW w AS (PARTITION BY grp, turn))
SELECT s.traj AS event_id FROM s JOIN z USING (grp, kind, turn) WHERE keep
""")
def cohorts_with_a_signal(t: Tables) -> DataFrame:
    ship(t.spark)
    return U.cohort_filter(_answers(t), "score", "answer", "valid", least_std=60.0).select(F.col("id").alias("event_id"))
