"""Queries on acceptance, grouping and further rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import tools as X
from tessera.operators import acceptance as Q
from tessera.operators import advantages as A
from tessera.operators import grouping as G
from tessera.operators import relational as J
from tessera.plans.rl import S, scores, turns_of
from tessera.registry import Tables, query, seconds


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'realtime' WHEN 1 THEN 'forward' ELSE 'backward' END AS kind,
       (p_size % 7 <> 0) AND CASE p_size % 3 WHEN 0 THEN NOT (p_size % 2 = 0 AND p_size / 50.0 >= 0.5) AND p_retailprice % 10 >= 5.5 WHEN 1 THEN NOT (p_size % 2 = 0 AND p_size / 50.0 >= 0.55) AND p_retailprice % 10 >= 5.5 ELSE p_size % 2 = 0 AND p_size / 50.0 >= 0.55 END AS accepted
FROM part
""")
def accepted_questions(t: Tables) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "realtime").when(size % 3 == 1, "forward").otherwise("backward")
    options = F.struct(F.lit(True).alias("is_valid_mcq"), F.lit(True).alias("has_single_correct_answer"), (size % 7 == 0).alias("has_option_bias"), F.lit(True).alias("is_visual_question"))
    audit = lambda choice, sure, support: F.struct(
        choice.alias("choice"), sure.cast("double").alias("confidence"), F.lit(support).alias("support"),
        F.lit(False).alias("is_answer_available_before_ask_time"),
    )
    guess = F.when(size % 2 == 0, "A").otherwise("B")
    rows = t.part.select(
        "p_partkey", kind.alias("kind"), options.alias("o"), audit(guess, size / 50, "unsure").alias("text"),
        audit(F.lit("A"), (F.col("p_retailprice") % 10) / 10, "fully_supported").alias("visual"),
        audit(guess, size / 50, "partially_supported").alias("history"),
    )
    return rows.select("p_partkey", "kind", Q.accepted_question(F.col("kind"), F.lit("A"), F.col("o"), F.col("text"), F.col("visual"), F.col("history"), F.lit(True)).alias("accepted"))


@query("""
WITH s AS (SELECT user_id, event_id, value < 140 AS ok, event_type AS why, value > 60 AS hit, epoch(ts) AS t FROM events), g AS (
  SELECT user_id, bool_and(ok) AS all_ok, bool_or(hit) AS hit, min_by(why, (t, event_id)) FILTER (NOT ok) AS why FROM s GROUP BY user_id)
SELECT user_id, all_ok AND hit AS usable, CASE WHEN NOT all_ok THEN why WHEN NOT hit THEN 'answer_incorrect' END AS reason FROM g
""")
def trajectory_acceptance(t: Tables) -> DataFrame:
    steps = t.events.select("user_id", F.struct(seconds("ts"), F.col("event_id")).alias("o"), (F.col("value") < 140).alias("ok"), F.col("event_type").alias("why"), (F.col("value") > 60).alias("hit"))
    return Q.trajectories(steps, ["user_id"], "o", "ok", "why", "hit").select("user_id", "usable", "reason")


@query("""
WITH e AS (SELECT user_id, event_id, floor(epoch(ts) / 7200)::DOUBLE AS t, event_type, value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 99 END AS p FROM events), o AS (
  SELECT user_id, t, min_by(event_type, (p, event_id)) AS kind, min_by(value, (p, event_id)) AS v FROM e GROUP BY ALL)
SELECT user_id, count(*)::BIGINT AS n, count(CASE WHEN kind = 'purchase' THEN 1 END)::BIGINT AS purchases, max(v) AS widest FROM o GROUP BY user_id HAVING count(*) >= 2
""")
def group_events_of_a_source(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.floor(seconds("ts") / 7200).cast("double").alias("t"), F.col("event_type").alias("kind"), "value")
    out = G.grouped(rows, ["user_id"], "t", [G.priority(F.col("kind"), ["purchase", "click"]), F.col("event_id")], ["kind"], 1.0, 2, ["value"])
    return out.select(
        "user_id", F.size("events").cast("long").alias("n"), F.size(F.filter("events", lambda e: e["kind"] == "purchase")).cast("long").alias("purchases"),
        F.col("value").alias("widest"),
    )


@query("""
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS test_index, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 0, NULL FROM orders WHERE o_orderstatus <> 'F'
""")
def benchmark_rows_with_tests(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("tests"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderstatus", "tests")
    return G.benchmark_samples(rows, "tests", F.col("o_orderstatus") == "F", ["part"]).select("o_orderkey", "test_index", "part")


@query("""
SELECT user_id, event_id, CASE WHEN t THEN CASE WHEN k % 2 = 0 THEN 'answer' ELSE 'silence' END WHEN q THEN CASE WHEN k % 3 = 0 THEN 'answer' ELSE 'silence' END WHEN s THEN 'silence' ELSE 'none' END AS kind
FROM (SELECT user_id, event_id, event_id AS k, event_type = 'purchase' AS t, event_type = 'click' AS q, value > 50 AS s FROM events)
""")
def answer_supervision_kinds(t: Tables) -> DataFrame:
    k = F.col("event_id")
    x = A.answer_supervision(F.col("event_type") == "purchase", k % 2 == 0, F.col("event_type") == "click", k % 3 == 0, F.col("value") > 50)
    return t.events.select("user_id", "event_id", x["kind"].alias("kind"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_type = 'view' THEN 0.0 WHEN event_type = 'click' THEN CASE WHEN value > 30 THEN 0.0 ELSE 1.0 END WHEN value > 30 THEN 1.0 + 0.1 + (value >= 50)::INTEGER ELSE 0.0 END::DOUBLE AS reward FROM events
""")
def answer_rewards(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "none").when(F.col("event_type") == "click", "silence").otherwise("answer")
    status = F.when(F.col("event_id") % 11 == 0, "parser_invalid").otherwise("")
    return t.events.select("event_id", A.answer_reward(F.col("value") / 100, kind, F.col("value") > 30, status).alias("reward"))


@query("""
WITH r AS (SELECT event_id, value, value > 100 AS said, bool_or(event_type = 'click') OVER w AS q, bool_or(event_type = 'purchase') OVER w AS t, bool_or(value > 100) OVER w AS any_said FROM events WINDOW w AS (PARTITION BY user_id, event_id % 40))
SELECT event_id, NOT q AND NOT t AND any_said AS forced, CASE WHEN NOT q AND NOT t AND any_said THEN CASE WHEN said THEN 0.0 ELSE 1.0 END ELSE value END::DOUBLE AS reward FROM r
""")
def forced_answer_rewards(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", "user_id", (F.col("event_id") % 40).alias("turn"), (F.col("event_type") == "click").alias("q"),
        (F.col("event_type") == "purchase").alias("t"), (F.col("value") > 100).alias("said"), F.col("value").alias("reward"),
    )
    return A.forced_answers(rows, "user_id", "turn", "q", "t", "said", "reward").select("event_id", "forced", "reward")


@query(S + """
, g AS (SELECT traj, (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) AS a, (length - avg(length) OVER w) / (stddev_samp(length) OVER w + 1e-6) AS b FROM s WINDOW w AS (PARTITION BY grp)), c AS (SELECT traj, 0.7 * a + 0.3 * b AS c FROM g)
SELECT traj, round((c - (SELECT avg(c) FROM c)) / sqrt((SELECT var_samp(c) FROM c) + 1e-8), 5) AS advantage FROM c
""")
def advantage_gdpo(t: Tables) -> DataFrame:
    return A.advantage("gdpo", scores(t), scores={"score": 0.7, "length": 0.3}).select("traj", F.round("advantage", 5).alias("advantage"))


@query(S + """
, u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp, kind, turn ORDER BY traj) = 1), f AS (SELECT grp, kind, sum(score) AS m, bool_and(valid) AS ok FROM u GROUP BY ALL), x AS (SELECT *, CASE WHEN ok THEN m END AS y FROM f), z AS (
  SELECT grp, kind, CASE WHEN ok AND count(y) OVER w > 1 THEN (m - avg(y) OVER w) / (stddev_samp(y) OVER w + 1e-6) ELSE 0 END AS a FROM x WINDOW w AS (PARTITION BY grp))
SELECT traj, round(a, 5) AS advantage FROM s JOIN z USING (grp, kind)
""")
def advantage_trajectory_sum(t: Tables) -> DataFrame:
    return A.advantage("trajectory_sum", turns_of(t), step="score", valid="valid").select(F.col("id").alias("traj"), F.round("advantage", 5).alias("advantage"))


@query(S + """
SELECT traj, round(0.5 * (score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-6) + 0.5 * CASE WHEN count(*) OVER k > 1 THEN (length - avg(length) OVER k) / (stddev_samp(length) OVER k + 1e-6) ELSE 0 END, 5) AS advantage FROM s WINDOW g AS (PARTITION BY grp), k AS (PARTITION BY grp, turn)
""")
def advantage_mixed(t: Tables) -> DataFrame:
    rows = turns_of(t, traj="traj").withColumn("outcome", F.col("score")).withColumn("state", F.col("length"))
    return A.advantage("mixed", rows, alpha=0.5, by_std=True).select("traj", F.round("advantage", 5).alias("advantage"))


@query("""
WITH p AS (SELECT vec_id, embedding[i]::DOUBLE AS a, embedding[i + 16]::DOUBLE AS b, embedding[i + 32]::DOUBLE AS d FROM embeddings, (SELECT unnest(range(1, 17)) AS i)), q AS (
  SELECT vec_id, a, d, exp(least(sum(a - b) OVER (PARTITION BY vec_id) / (16 + 1e-8), 10)) AS r, least(greatest(exp(a - b), 0.8), 1.28) AS w FROM p)
SELECT vec_id, round(sum(greatest(-d * r, -d * least(greatest(r, 0.8), 1.28))) / (16 + 1e-8), 6) AS by_sequence, round(sum(-w * d * a) / (16 + 1e-8), 6) AS by_token, round(sum(-d * a) / (16 + 1e-8), 6) AS plain FROM q GROUP BY vec_id
""")
def further_policy_losses(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select("vec_id", F.slice(v, 1, 16).alias("a"), F.slice(v, 17, 16).alias("b"), F.slice(v, 33, 16).alias("d"), F.array_repeat(F.lit(1.0), 16).alias("m"))
    x = [F.col(c) for c in "abdm"]
    return rows.select(
        "vec_id", F.round(A.sequence_ratio_loss(*x, 0.2, 0.28), 6).alias("by_sequence"),
        F.round(A.weighted_likelihood_loss(*x, 0.2, 0.28), 6).alias("by_token"), F.round(A.weighted_likelihood_loss(*x), 6).alias("plain"),
    )


@query("""
SELECT event_id, round(greatest((CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE greatest(value / 50, 0) END) * CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 1.2 END + 0.1 * (event_id % 2), 0), 6)::DOUBLE AS reward FROM events
""")
def step_rewards(t: Tables) -> DataFrame:
    note = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(1.0)
    return t.events.select("event_id", F.round(A.step_reward(F.col("value") / 50, (F.col("event_id") % 2).cast("double"), note, w_note=0.2), 6).alias("reward"))


@query("""
WITH s AS (SELECT *, sum((event_type = 'view')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events), r AS (
  SELECT event_id, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) - CASE WHEN part = 0 THEN 0 ELSE 1 END AS streak FROM s)
SELECT event_id, CASE WHEN streak >= 3 THEN 'note_stale' END AS reason, CASE WHEN streak >= 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM r
""")
def note_frequency(t: Tables) -> DataFrame:
    rows = t.events.withColumn("notes", (F.col("event_type") == "view").cast("int"))
    return A.note_frequency(rows, ["user_id"], ["ts", "event_id"], "notes", most=2, stale=3).select("event_id", F.get("note_reasons", F.lit(0)).alias("reason"), F.col("note_score").alias("score"))


@query("""
WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY md5('b:0:' || doc_id), doc_id) - 1 AS r FROM documents)
SELECT doc_id, (r // 64)::BIGINT AS batch FROM b
""")
def seeded_minibatches(t: Tables) -> DataFrame:
    return J.minibatches(t.documents.select("doc_id"), ["doc_id"], 64, "b", 0).select("doc_id", "batch")


@query("""
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS p, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, p::BIGINT AS position, false AS padding FROM s UNION ALL SELECT s_suppkey, (n + p)::BIGINT, true FROM s WHERE p < (7 - n % 7) % 7
""")
def padded_to_multiple(t: Tables) -> DataFrame:
    return J.padded(t.supplier.select("s_suppkey"), ["s_suppkey"], 7)


@query("""
SELECT p_partkey, 'Action: find' || chr(10) || 'Action Input: {"size":' || p_size || '}' || chr(10) || 'Action: show' || chr(10) || 'Action Input: {"id":' || p_partkey || '}' AS text, 2::BIGINT AS n FROM part
""")
def tool_calls_round_trip(t: Tables) -> DataFrame:
    call = lambda name, key, c: F.struct(F.lit(name).alias("name"), F.concat(F.lit(f'{{"{key}":'), c.cast("string"), F.lit("}")).alias("arguments"))
    calls = F.array(call("find", "size", F.col("p_size")), call("show", "id", F.col("p_partkey")))
    rows = t.part.repartition(J.tasks_for(t.part, 1 << 14), "p_partkey").select("p_partkey", calls.alias("calls"))  # few bytes, much work
    same = [F.coalesce(X.read(X.written(F.col("calls"), d), d) == F.col("calls"), F.lit(False)) for d in ("action", "tagged", "listed", "array")]  # these keep the arguments as they are
    n = F.size(F.filter(F.array(*same), lambda x: ~x))
    return rows.select("p_partkey", X.written(F.col("calls")).alias("text"), (F.size("calls") - n).cast("long").alias("n"))
