"""Queries on canonical rows, summaries, sorts, frames and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.functions import text as T
from tessera.functions.scorers import difficulty
from tessera.operators import aggregates as G
from tessera.operators import batches as B
from tessera.operators import canonical as N
from tessera.operators import metrics as M
from tessera.operators import ordered as O
from tessera.operators import relational as L
from tessera.operators import summaries as S
from tessera.operators import timeline as K
from tessera.plans.prompts import UPDATES
from tessera.registry import Tables, query, seconds

DIFFICULTY = "CASE WHEN {0} IS NULL THEN 'unscored' WHEN {0} >= 1 THEN 'easy' WHEN {0} >= 2.0 / 3 - 1e-9 THEN 'medium' WHEN {0} >= 1.0 / 3 - 1e-9 THEN 'hard' ELSE 'unsolved' END"


@query("SELECT p_partkey, p_brand AS brand, p_type AS kind FROM part")
def projected_and_renamed(t: Tables) -> DataFrame:
    wanted, others = N.taken(N.without(t.part, ["p_name"]), ["p_partkey", "nothing", "p_brand", "p_type"])
    assert "p_brand" not in others.columns
    return N.renamed(N.projected(wanted, ["p_partkey", "p_brand", "missing", "p_type"]), {"p_brand": "brand", "p_type": "kind"})


@query(f"""
WITH e AS (SELECT conv_id, count(*) AS n, min_by(text, turn) AS q, list(struct_pack(t := turn, x := trim(text, ' ' || chr(10) || chr(9) || chr(13))) ORDER BY turn) AS a FROM conversations WHERE text IS NOT NULL AND length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) > 0 GROUP BY conv_id)
SELECT 'd' || conv_id AS dataset, 'v' || conv_id AS video_id, 'video/v' || conv_id AS video, 'video/v' || conv_id AS frames_dir, 2.0::DOUBLE AS sample_fps, floor(n * 1.5 + 0.5)::BIGINT AS frame_count, 0::BIGINT AS frame_id_base,
  'q0' AS qid, floor(conv_id / 4.0 + 0.5)::DOUBLE AS time, CASE WHEN n > 1 THEN '{UPDATES}' || chr(10) || chr(10) || trim(q, ' ' || chr(10) || chr(9) || chr(13)) ELSE trim(q, ' ' || chr(10) || chr(9) || chr(13)) END AS content,
  CASE WHEN conv_id % 2 = 0 THEN 'mcq' ELSE 'text' END AS answer_type, CASE WHEN n > 1 THEN 'update_when_changed' ELSE 'answer_when_asked' END AS policy, CASE WHEN conv_id % 2 = 0 THEN 'A' END AS gt, list_last(a).x AS last_content FROM e
""")
def canonical_rows(t: Tables) -> DataFrame:
    rows = t.conversations.where("text is not null").where(T.stripped(F.col("text")) != "")
    a = F.struct("turn", F.struct((F.col("turn") + 0.4).alias("time"), F.lit(" a").alias("gt"), F.col("text").alias("answer"), F.lit(" ").alias("content")).alias("x"))
    rows = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("q"), F.transform(F.array_sort(F.collect_list(a)), lambda s: s["x"]).alias("a"))
    options = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(" x "), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    asked = F.struct(
        F.lit(None).cast("string").alias("qid"), (F.col("conv_id") / 4).alias("time"), F.col("q").alias("content"), F.lit("").alias("answer_policy"),
        options.alias("options"), F.col("a").alias("answer_events"),
    )
    flat = rows.select(
        F.concat(F.lit("d"), "conv_id").alias("dataset"), F.lit(" ").alias("video_id"), F.concat(F.lit("v"), "conv_id").alias("sample_id"),
        F.lit(2.0).alias("fps"), (F.col("n") * 1.5).alias("duration"), F.array(asked).alias("query_events"),
    )
    q = F.col("query_events")[0]
    return N.canonical(flat).select(
        "dataset", "video_id", "video", "frames_dir", "sample_fps", "frame_count", "frame_id_base", q["qid"].alias("qid"), q["time"].alias("time"),
        q["content"].alias("content"), q["answer_type"].alias("answer_type"), q["answer_policy"].alias("policy"),
        F.element_at(q["answer_events"], -1)["gt"].alias("gt"), F.element_at(q["answer_events"], -1)["content"].alias("last_content"),
    )


@query("""
SELECT p_partkey, p_size::DOUBLE AS time, p_name || chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS content, 'B' AS gt, 'B. ' || p_type AS said FROM part WHERE p_size > 10
""")
def rows_from_flat_questions(t: Tables) -> DataFrame:
    rows = t.part.withColumns({"options": F.array("p_brand", "p_type"), "frames": F.when(F.col("p_size") > 10, F.col("p_size"))})
    q = F.col("query_events")[0]
    return N.from_flat(rows, "p_name", "options", "p_type", "frames").select(
        "p_partkey", q["time"].alias("time"), q["content"].alias("content"), q["answer_events"][0]["gt"].alias("gt"),
        q["answer_events"][0]["content"].alias("said"),
    )


@query(f"""
SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars <= 500 THEN '0-500s' WHEN n_chars <= 2000 THEN '500-2000s' ELSE '>2000s' END AS duration_bucket, {DIFFICULTY.format("quality")} AS difficulty, 'run7' AS run, 3::INTEGER AS version FROM documents LEFT JOIN labels USING (doc_id)
""")
def rows_with_buckets_and_manifest(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return N.with_manifest(
        N.with_buckets(rows, "n_chars", [500.0, 2000.0], "quality"), "made_by", run="run7", version=3,
    ).select("doc_id", "duration_bucket", "difficulty", "made_by.run", "made_by.version")


@query("""
SELECT p_partkey, NULL::INTEGER AS variant, p_name AS target FROM part UNION ALL SELECT p_partkey, 0, p_brand FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 1, p_type FROM part WHERE p_size % 3 = 0
""")
def rows_with_variants(t: Tables) -> DataFrame:
    v = lambda c, ok: F.struct(F.col(c).alias("target"), ok.alias("accepted"))
    rows = t.part.select("p_partkey", F.col("p_name").alias("target"), F.array(v("p_brand", F.col("p_size") % 2 == 0), v("p_type", F.col("p_size") % 3 == 0)).alias("variants"))
    return N.with_variants(rows, "target", "variants")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS target, (p_size % 6 = 0)::INTEGER AS more FROM part WHERE p_size % 5 <> 0 AND (p_size % 2 = 0 OR p_size % 3 = 0)
""")
def rows_rescued_by_variants(t: Tables) -> DataFrame:
    v = lambda c, ok: F.struct(F.col(c).alias("target"), ok.alias("correct"))
    rows = t.part.select(
        "p_partkey", F.col("p_name").alias("target"), F.array(v("p_brand", F.col("p_size") % 2 == 0), v("p_type", F.col("p_size") % 3 == 0)).alias("variants"),
        F.lit(True).alias("valid"), F.when(F.col("p_size") % 5 == 0, "step_invalid").otherwise("answer_incorrect").alias("reason"),
    )
    return N.rescued(rows, "target", "variants", "valid", "reason").select("p_partkey", "target", F.size("variants").alias("more"))


@query("SELECT n_nationkey AS id, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def united_tables(t: Tables) -> DataFrame:
    return N.united(
        [
            t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
            t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
        ]
    )


@query("SELECT s_suppkey AS id, s_name AS name, 7::INTEGER AS step FROM supplier UNION ALL SELECT c_custkey, c_name, 7 FROM customer")
def concatenated_batches(t: Tables) -> DataFrame:
    rows, notes = N.concatenated(
        [
            (t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), {"step": 7}),
            (t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")), {"step": 7, "more": 1}),
        ]
    )
    return rows.withColumn("step", F.lit(notes["step"]))


def _answers(t: Tables) -> DataFrame:
    """Orders as rows of queries (line numbers) with answers (lines)."""
    a = F.struct(F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("eval_runs"), F.when(F.col("l_quantity") > 10, F.col("l_tax") * 10).alias("eval_pass_rate"))
    q = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(a).alias("answer_events"))
    q = q.select("l_orderkey", F.struct(F.when(F.col("l_linenumber") % 2 == 0, "mcq").otherwise("text").alias("answer_type"), "answer_events").alias("q"))
    return q.groupBy("l_orderkey").agg(F.collect_list("q").alias("query_events")).withColumn("file", F.concat(F.lit("f"), (F.col("l_orderkey") % 3).cast("string")))


@query("""
WITH a AS (SELECT 'f' || l_orderkey % 3 AS file, l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_linenumber END AS runs, CASE WHEN l_quantity > 10 THEN l_tax * 10 END AS rate FROM lineitem)
SELECT 'rows' AS part, file AS name, count(DISTINCT l_orderkey)::BIGINT AS n FROM a GROUP BY file UNION ALL SELECT 'queries', file, count(DISTINCT (l_orderkey, l_linenumber)) FROM a GROUP BY file UNION ALL SELECT 'answers', file, count(*) FROM a GROUP BY file
UNION ALL SELECT 'scored', file, count(runs) FROM a GROUP BY file UNION ALL SELECT 'runs', coalesce(runs::VARCHAR, 'None'), count(*) FROM a GROUP BY runs UNION ALL SELECT 'pass_rate', CASE WHEN rate IS NULL THEN 'None' ELSE printf('%.4f', rate) END, count(*) FROM a GROUP BY 2
""")
def summary_of_sources(t: Tables) -> DataFrame:
    files, counts = S.of_sources(_answers(t), "file", "query_events")
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(c).alias("n")) for k, c in (("rows", "rows"), ("queries", "query_events"), ("answers", "answer_events"), ("scored", "scored_answer_events")))))
    return files.select("file", cells.alias("c")).select("c.part", F.col("file").alias("name"), "c.n").unionAll(counts)


@query(f"""
WITH d AS (SELECT lang AS split, quality::DOUBLE AS rate, source, {DIFFICULTY.format("quality")} AS difficulty FROM documents LEFT JOIN labels USING (doc_id))
SELECT split, 'rows' AS part, '' AS name, count(*)::BIGINT AS n, round(avg(rate), 6) AS rate FROM d GROUP BY split UNION ALL SELECT split, 'difficulty', difficulty, count(*), NULL FROM d GROUP BY ALL UNION ALL SELECT split, 'source', coalesce(source, 'None'), count(*), NULL FROM d GROUP BY ALL
""")
def summary_of_splits(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.col("lang").alias("split"), F.col("quality").cast("double").alias("rate"), "source", difficulty(F.col("quality")).alias("difficulty"))
    total, counts = S.of_splits(rows, "split", "rate", ["difficulty", "source"])
    return total.select(
        "split", F.lit("rows").alias("part"), F.lit("").alias("name"), "n", F.round("avg_pass_rate", 6).alias("rate"),
    ).unionAll(counts.select("split", "part", "name", "n", F.lit(None).cast("double")))


@query(f"""
WITH d AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'rl' ELSE 'sft' END AS target, value / 100 AS rate, event_type AS source, CASE WHEN value > 50 THEN 'high' END AS reason FROM events)
SELECT target, 'rows' AS part, '' AS name, count(*)::BIGINT AS n, round(avg(rate), 6) AS rate FROM d GROUP BY target UNION ALL SELECT target, 'difficulty', {DIFFICULTY.format("rate")}, count(*), NULL FROM d GROUP BY 1, 3
UNION ALL SELECT target, 'source', source, count(*), NULL FROM d GROUP BY ALL UNION ALL SELECT target, 'reason', coalesce(reason, 'None'), count(*), NULL FROM d GROUP BY 1, 3
""")
def summary_of_targets(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.when(F.col("user_id") % 3 == 0, "rl").otherwise("sft").alias("target"), (F.col("value") / 100).alias("rate"), F.col("event_type").alias("source"),
        F.when(F.col("value") > 50, "high").alias("reason"),
    )
    total, counts = S.of_targets(rows, "target", "rate", difficulty(F.col("rate")), "source", "reason")
    return total.select(
        "target", F.lit("rows").alias("part"), F.lit("").alias("name"), "n", F.round("avg_pass_rate", 6).alias("rate"),
    ).unionAll(counts.select("target", "part", "name", "n", F.lit(None).cast("double")))


@query("""
SELECT 'rows' AS part, '' AS name, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem UNION ALL SELECT 'questions', '', count(*) FROM lineitem UNION ALL SELECT 'flag', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'dataset', 'd' || l_orderkey % 4, count(*) FROM lineitem GROUP BY l_orderkey % 4 UNION ALL SELECT 'flat', '', count(*) FROM lineitem
""")
def summary_of_stage(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"))).alias("qa_list")).withColumns(
        {"dataset": F.concat(F.lit("d"), (F.col("l_orderkey") % 4).cast("string")), "flag": F.lit("of the row")}
    )
    total, counts = S.of_stage(rows, ["flag", "dataset"], "qa_list")
    flat, _ = S.of_stage(t.lineitem, ["l_returnflag"])
    return total.select(
        F.lit("rows").alias("part"), F.lit("").alias("name"), F.col("rows").alias("n"),
    ).unionAll(total.select(F.lit("questions"), F.lit(""), "questions")).unionAll(counts).unionAll(flat.select(F.lit("flat"), F.lit(""), "questions"))


@query("""
WITH v AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS candidates, count(*) FILTER (event_type = 'purchase' AND value > 50) AS accepted, count(*) FILTER (event_type = 'error' AND value > 90) AS errors FROM events GROUP BY user_id)
SELECT count(*)::BIGINT AS videos, count(*) FILTER (candidates > 0)::BIGINT AS videos_with_candidates, sum(candidates)::BIGINT AS total_candidates, count(*) FILTER (accepted > 0)::BIGINT AS videos_with_accepted, sum(accepted)::BIGINT AS total_accepted, count(*) FILTER (errors > 0)::BIGINT AS error_videos FROM v
""")
def summary_of_videos(t: Tables) -> DataFrame:
    e, v = F.col("event_type"), F.col("value")
    rows = t.events.groupBy("user_id").agg(
        F.count_if(e == "view").alias("candidates"), F.count_if((e == "purchase") & (v > 50)).alias("accepted"),
        F.count_if((e == "error") & (v > 90)).alias("errors"),
    )
    return S.of_videos(rows, ["candidates", "accepted"], "errors")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'mcq' ELSE 'text' END AS kind, CASE WHEN l_quantity > 10 THEN l_tax * 10 END AS rate FROM lineitem), q AS (SELECT DISTINCT l_orderkey, l_linenumber, kind FROM a), o AS (SELECT l_orderkey, count(*) AS answers, count(DISTINCT l_linenumber) AS queries FROM a GROUP BY l_orderkey)
SELECT 'rows' AS part, '' AS name, count(*)::BIGINT AS n FROM o UNION ALL SELECT 'query_events', '', count(*) FROM q UNION ALL SELECT 'answer_events', '', count(*) FROM a UNION ALL SELECT 'rows_with_multiple_queries', '', count(*) FILTER (queries > 1) FROM o UNION ALL SELECT 'rows_with_multiple_answers', '', count(*) FILTER (answers > 1) FROM o
UNION ALL SELECT 'dataset', 'f' || l_orderkey % 3, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'query_answer_type', kind, count(*) FROM q GROUP BY kind UNION ALL SELECT 'answer_type', kind, count(*) FROM a GROUP BY kind UNION ALL SELECT 'pass_rate', CASE WHEN rate IS NULL THEN 'None' ELSE printf('%.4f', rate) END, count(*) FROM a GROUP BY 2
""")
def summary_of_grouped_rows(t: Tables) -> DataFrame:
    total, counts = S.of_grouped_rows(_answers(t), "file", "query_events")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.lit("").alias("name"), F.col(c).alias("n")) for c in total.columns)))
    return total.select(cells.alias("c")).select("c.*").unionAll(counts)


@query("""
SELECT count(*)::BIGINT AS pairs, (2 * count(*))::BIGINT AS rows, count(*)::BIGINT AS yes, count(*)::BIGINT AS no, min(p_size)::BIGINT AS frame_count_min, (max(p_size + 15 + p_size % 7))::BIGINT AS frame_count_max, min(15 + p_size % 7)::BIGINT AS gap_min, max(15 + p_size % 7)::BIGINT AS gap_max, 3::INTEGER AS excluded, 9::INTEGER AS available_candidates FROM part
""")
def summary_of_pairs(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("long")
    rows = t.part.select(
        "p_partkey",
        F.explode(
            F.array(F.struct(F.lit("No").alias("answer"), s.alias("frames")), F.struct(F.lit("Yes").alias("answer"), (s + 15 + s % 7).alias("frames")))
        ).alias("r"),
    ).select("p_partkey", "r.*")
    return S.of_pairs(rows, "p_partkey", "answer", "frames", 3, 9)


@query("""
SELECT count(*)::BIGINT AS samples, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS accepted, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0)::BIGINT AS errors, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1)::BIGINT AS failed,
  (5 * count(*) FILTER (o_orderstatus <> 'P'))::BIGINT AS attempted_steps, (2 * count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS exported_steps, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 > 0)::BIGINT AS rescued FROM orders
""")
def summary_of_jobs(t: Tables) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    rows = t.orders.select(
        F.when(k % 2 == 0, "error").alias("status"), F.when(s == "F", True).when(s == "O", False).alias("usable"), F.lit(5).alias("tried"),
        F.when(s == "F", 2).otherwise(0).alias("out"), F.when(s == "F", k % 3).otherwise(0).alias("variants"),
    )
    return S.of_jobs(rows, "status", "usable", "tried", "out", "variants")


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def jobs_by_status(t: Tables) -> DataFrame:
    return S.by_status(t.orders.select(F.col("o_orderstatus").alias("status")), "status")


@query("""
WITH k AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS ks FROM lineitem GROUP BY l_orderkey), r AS (SELECT ks, list_filter(ks, lambda x: x % 2 = 1) AS kept, list_bool_or(list_transform(range(1, len(ks)), lambda i: ks[i + 1] - ks[i] <= 1)) AS a FROM k)
SELECT count(*)::BIGINT AS rows, count(*) FILTER (len(ks) <> len(kept))::BIGINT AS rows_changed, sum(len(ks))::BIGINT AS keyframes_before, sum(len(kept))::BIGINT AS keyframes_after, count(*) FILTER (a)::BIGINT AS adjacent_before, 0::BIGINT AS adjacent_after FROM r
""")
def summary_of_keyframes(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ks"))
    return S.of_keyframes(rows.withColumn("kept", F.filter("ks", lambda x: x % 2 == 1)), "ks", "kept")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 4")
def examples_of_reasons(t: Tables) -> DataFrame:
    return S.examples(t.events, "event_type", ["ts", "event_id"], 4).select("event_type", "event_id")


@query("SELECT event_id FROM events WHERE value >= 20 AND user_id >= 50")
def rows_that_reach_thresholds(t: Tables) -> DataFrame:
    return S.enough(t.events.withColumn("none", F.lit(None).cast("double")), {"value": 20.0, "user_id": 50.0, "none": 0.0}).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def rows_with_questions(t: Tables) -> DataFrame:
    q = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, "  ")
    return S.with_questions(t.part.withColumn("question", q), "question").select("p_partkey")


@query(
    "SELECT event_id, rank::INTEGER AS rank, (row_number() OVER (ORDER BY rank, value, event_id) - 1)::BIGINT AS position FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 99 END AS rank FROM events)"
)
def sorted_by_priority(t: Tables) -> DataFrame:
    rows = S.by_priority(t.events, "event_type", {"purchase": 0, "click": 1}, ["value", "event_id"])
    return L.with_position(rows, ["rank", "value", "event_id"]).select("event_id", "rank", F.col("position").cast("long").alias("position"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_brand, p_partkey)::BIGINT - 1 AS position FROM part")
def sorted_by_several_keys(t: Tables) -> DataFrame:
    return L.with_position(t.part, ["p_size", "p_brand", "p_partkey"]).select("p_partkey", F.col("position").cast("long").alias("position"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS position FROM part")
def sorted_naturally(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", T.natural_key(F.concat(F.lit("clip_"), F.col("p_partkey").cast("string"), F.lit("_x"))).alias("k"))
    return L.with_position(rows, ["k"]).select("p_partkey", F.col("position").cast("long").alias("position"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 4")
def last_frames_of_videos(t: Tables) -> DataFrame:
    from tessera.streaming.windows import latest

    return latest(t.events, ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id")


@query("SELECT vec_id, ((SELECT count(*) FROM embeddings) - 1 - vec_id)::BIGINT AS place, vec_id AS back FROM embeddings")
def reordered_and_restored(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.col("vec_id").alias("place"))
    order = rows.select(F.col("vec_id").alias("old"), (rows.count() - 1 - F.col("vec_id")).alias("at"))
    moved = B.reordered(rows, "place", order, "old")
    back = B.reordered(moved.withColumnRenamed("place", "p"), "p", B.inverse(order, "old", "at"), "old").select("vec_id", F.col("p").alias("back"))
    return moved.join(back, "vec_id")


@query("""
WITH m AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id), l AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN hi ELSE least(greatest(greatest(0, ceil((user_id * 30 - 1e-9) * 2)::BIGINT - 1) + 0, lo), hi) END AS last FROM m)
SELECT event_id FROM events JOIN l USING (user_id) WHERE event_id <= last AND value > 10
""")
def frames_until_target(t: Tables) -> DataFrame:
    targets = t.events.select("user_id").distinct().where("user_id % 3 <> 0").withColumn("at", (F.col("user_id") * 30).cast("double"))
    rows = K.until_target(t.events, "user_id", "event_id", targets, "at", 2.0, 0)
    return K.from_start(rows, "value", F.lit(10.0)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 2 = 0")
def rows_with_frames(t: Tables) -> DataFrame:
    listing = t.events.where("user_id % 2 = 0").select("user_id")
    return K.with_frames(t.events, ["user_id"], listing).select("event_id")


@query("""
WITH l AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS frames FROM lineitem GROUP BY l_orderkey), f AS (SELECT l_orderkey, frames, frames[1] AS k1, frames[-1] AS k2 FROM l)
SELECT l_orderkey, 0::INTEGER AS place, k1 AS keyframe, array_to_string(list_sort(list_intersect([1, 2, 9], frames)), ',') AS evidence, 'other' AS category FROM f WHERE len(list_intersect([1, 2, 9], frames)) > 0
UNION ALL SELECT l_orderkey, 1, CASE WHEN abs(k1 - k2) <= 0 OR abs(k1 - k2) >= 0 THEN k2 END, k2::VARCHAR, 'c' FROM f
""")
def caption_facts(t: Tables) -> DataFrame:
    """Facts of an order: the first lies on its first frame, the second's keyframe is not allowed and is found by its evidence, the others have no text or evidence."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("frames"))
    ends = F.array_distinct(F.array(F.element_at("frames", 1), F.element_at("frames", -1)))
    fact = lambda text, category, key, evidence: F.struct(
        F.lit(text).alias("fact"), F.lit(None).cast("string").alias("answer"), F.lit(category).cast("string").alias("category"),
        key.cast("int").alias("source_keyframe_id"), evidence.cast("array<int>").alias("evidence_frame_ids"),
    )
    facts = F.array(
        fact("a", None, F.element_at("frames", 1), F.array(F.lit(2), F.lit(1), F.lit(9))), fact(" b ", "c", F.lit(-5), F.array(F.element_at("frames", -1), F.element_at("frames", -1))),
        fact(" ", "c", F.lit(1), F.col("frames")), fact("d", "c", F.lit(1), F.array(F.lit(77))), fact("e", "c", F.lit(1), F.lit(None).cast("array<int>")),
    )
    rows = rows.select("l_orderkey", "frames", ends.alias("keyframes"), facts.alias("facts"))
    cleaned = rows.select("l_orderkey", F.explode(S.cleaned_facts(rows, "facts", "keyframes", "frames")).alias("f"))
    return cleaned.select(
        "l_orderkey", F.col("f.place").cast("int").alias("place"), F.col("f.source_keyframe_id").alias("keyframe"),
        F.array_join(F.col("f.evidence_frame_ids").cast("array<string>"), ",").alias("evidence"), "f.category",
    )


@query("SELECT doc_id FROM documents WHERE n_chars % 7 <> 0 AND n_chars <= 1500 AND n_chars <= 1000")
def rows_within_tokens(t: Tables) -> DataFrame:
    from tessera.operators import acceptance as A

    length = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars"))
    return A.within_tokens(A.within_tokens(t.documents, length, 1500), F.col("n_chars"), 1000).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 2 = 0")
def valid_training_examples(t: Tables) -> DataFrame:
    from tessera.operators import conversations as C

    m = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: C.message("user", i.cast("string")))
    rows = t.embeddings.select(
        "vec_id", m(F.lit(1) + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(2 * (F.col("vec_id") % 2))).alias("_prompt"),
        m(F.lit(1) + (F.col("vec_id") % 2)).alias("_response"),
    )
    return C.valid_examples(rows).select("vec_id")


@query("""
WITH g AS (SELECT vec_id, [embedding[1]::DOUBLE - embedding[5], embedding[2]::DOUBLE - embedding[6], embedding[3]::DOUBLE - embedding[7]] AS x FROM embeddings)
SELECT vec_id, len(list_filter(x, lambda v: v BETWEEN -0.1 AND 0.1))::INTEGER AS k1, len(list_filter(x, lambda v: 0.5 * v * v BETWEEN 0 AND 0.01))::INTEGER AS k2, len(list_filter(x, lambda v: exp(v) - v - 1 BETWEEN 0 AND 0.01))::INTEGER AS k3,
  CASE WHEN list_sum(x) BETWEEN -0.2 AND 0.2 THEN 3 ELSE 0 END::INTEGER AS seq_sum, CASE WHEN list_sum(x) / (3 + 1e-8) BETWEEN -0.1 AND 0.1 THEN 3 ELSE 0 END::INTEGER AS seq_mean, CASE WHEN greatest(abs(x[1]), abs(x[2]), abs(x[3])) BETWEEN 0 AND 0.2 THEN 3 ELSE 0 END::INTEGER AS seq_max FROM g
""")
def rejection_masks(t: Tables) -> DataFrame:
    v, ones = F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(1.0), 3)
    new, old = F.slice(v, 1, 3), F.slice(v, 5, 3)
    bounds = {"token_k1": (-0.1, 0.1), "token_k2": (0, 0.01), "token_k3": (0, 0.01), "seq_sum": (-0.2, 0.2), "seq_mean": (-0.1, 0.1), "seq_max": (0, 0.2)}
    kept = lambda m: F.aggregate(m, F.lit(0.0), lambda a, x: a + x).cast("int")
    return t.embeddings.select("vec_id", *(kept(M.rejection_mask(new, old, ones, k, *b)).alias(k.replace("token_", "")) for k, b in bounds.items()))


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0")
def overlap_of_splits(t: Tables) -> DataFrame:
    return L.disjoint(t.documents.where("doc_id % 2 = 0"), t.documents.where("doc_id % 3 = 0"), ["doc_id"])


@query("SELECT round(sum(value) * 1000 / sum(user_id), 6) AS ms_per_token, round(sum(user_id) / (sum(value) * 4), 6) AS tokens_per_second FROM events")
def timings_per_token(t: Tables) -> DataFrame:
    out = M.timings(t.events, "value", "user_id", 4)
    return out.select(F.round("ms_per_token", 6).alias("ms_per_token"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("""
SELECT event_id, count(*) OVER w AS group_n, round(CASE WHEN count(*) OVER w > 1 THEN avg(value) OVER w ELSE 0 END, 6) AS group_mean, round(CASE WHEN count(*) OVER w > 1 THEN sqrt(greatest(var_samp(value) OVER w, 400)) ELSE 1 END, 6) AS group_std FROM events WINDOW w AS (PARTITION BY user_id, event_type)
""")
def statistics_of_groups(t: Tables) -> DataFrame:
    out = G.group_statistics(t.events, ["user_id", "event_type"], "value", 400.0)
    return out.select("event_id", "group_n", F.round("group_mean", 6).alias("group_mean"), F.round("group_std", 6).alias("group_std"))


@query("SELECT event_id, round(sum(value * (1 + event_id % 3)) OVER w / sum(1 + event_id % 3) OVER w, 9) AS mean_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def running_means(t: Tables) -> DataFrame:
    out = B.running_mean(t.events.withColumn("w", 1 + F.col("event_id") % 3), ["user_id"], ["ts", "event_id"], "value", "w")
    return out.select("event_id", F.round("mean_so_far", 9).alias("mean_so_far"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds, round(list_sum(list(value ORDER BY event_id)), 4) AS total FROM events GROUP BY user_id")
def gathered_metrics(t: Tables) -> DataFrame:
    out = B.gathered(t.events, ["user_id"], ["event_type", "value"], "event_id")
    return out.select("user_id", F.array_join("event_type", ",").alias("kinds"), F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""
WITH w AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS ks FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_filter(ks, lambda k: k * 10 + 5 <= 35))::INTEGER AS before, CASE WHEN list_contains(ks, 3) THEN 3 END AS holding,
  CASE WHEN list_contains(ks, 3) THEN '3' || coalesce(list_aggregate(list_transform(list_filter(ks, lambda k: k > 3)[-2:], lambda k: ',' || k::VARCHAR), 'string_agg', ''), '') END AS history FROM w
""")
def windows_before_and_around(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ks"))
    windows = F.transform("ks", lambda k: F.struct(k.alias("k"), (k * 10 + 5).alias("end"), F.array(k).alias("frames")))
    history = K.history_frames(F.array(F.lit(3)), F.filter("ks", lambda k: k >= 3), 3)
    three = F.array_contains("ks", F.lit(3))
    return rows.select(
        "l_orderkey", F.size(K.before(windows, F.lit(35))).alias("before"), K.holding(windows, F.lit(3))["k"].alias("holding"),
        F.when(
            three, F.concat(F.lit("3"), F.concat_ws("", F.transform(F.filter(history, lambda k: k > 3), lambda k: F.concat(F.lit(","), k.cast("string"))))),
        ).alias("history"),
    )


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber * 2.0 AS a, l_linenumber * 2.0 + 1 AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), g AS (SELECT l_orderkey, coalesce(lag(b) OVER w, 0.0) AS s, a AS e FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY a) UNION ALL SELECT l_orderkey, max(b), 20.0 FROM n GROUP BY l_orderkey)
SELECT l_orderkey, s::DOUBLE AS gap_start, e::DOUBLE AS gap_end FROM g WHERE e > s
""")
def gaps_between_notes(t: Tables) -> DataFrame:
    notes = F.array_sort(F.collect_set(F.struct((F.col("l_linenumber") * 2.0).alias("start"), (F.col("l_linenumber") * 2.0 + 1).alias("end"))))
    rows = t.lineitem.groupBy("l_orderkey").agg(notes.alias("notes"))
    return rows.select(
        "l_orderkey", F.explode(K.complement(F.col("notes"), F.lit(0.0), F.lit(20.0))).alias("g"),
    ).select("l_orderkey", F.col("g.start").alias("gap_start"), F.col("g.end").alias("gap_end"))


@query("SELECT user_id, event_id, round(epoch(ts) % 1000, 3) AS second FROM events WHERE value > 30 AND event_type IN ('view', 'click')")
def rollouts_found(t: Tables) -> DataFrame:
    """Rollout rows by a word and a condition, as a viewer shows them."""
    rows = t.events.where("value > 30").where(F.col("event_type").rlike("^(view|click)$"))
    return rows.select("user_id", "event_id", F.round(seconds("ts") % 1000, 3).alias("second"))


@query("SELECT p_partkey, least(greatest(p_size - 10, 0), 20)::INTEGER AS clamped, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 ELSE 7.5 END AS declared FROM part")
def clamped_and_declared(t: Tables) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    declared = R.declared_seconds(F.when(even, F.col("p_size")), F.lit(2.0), F.when(~even, 7.5), F.lit(1.0))
    return t.part.select("p_partkey", R.clamp(F.col("p_size") - 10, 0, 20).cast("int").alias("clamped"), declared.cast("double").alias("declared"))


@query(
    "SELECT p_partkey, 'say ' || p_name || ' and ' || p_brand || ' {{name}}' AS filled, left(p_name || ' ' || p_name, 12) || CASE WHEN length(p_name || ' ' || p_name) > 12 THEN '...' ELSE '' END AS preview, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'timeout' ELSE 'other' END AS error FROM part"
)
def templates_previews_errors(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 1, "Request TIMED OUT after 5 s").when(F.col("p_size") % 3 == 2, "strange")
    return t.part.select(
        "p_partkey", T.filled("say {{name}} and {{brand}} {{name}}", name=F.col("p_name"), brand=F.col("p_brand")).alias("filled"),
        T.preview(F.concat("p_name", F.lit("\n  "), "p_name"), 12).alias("preview"),
        T.error_class(text, [("timed out", "timeout"), ("refused", "connection")]).alias("error"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN 0.0 ELSE (event_id % 2)::DOUBLE END AS score FROM events")
def scores_with_silence(t: Tables) -> DataFrame:
    from tessera.functions import scorers as C

    k = F.col("event_id")
    answer = F.when(k % 3 == 0, " ").when(k % 3 == 1, "said").otherwise(F.when(k % 2 == 1, "Gold.").otherwise("lead"))
    return t.events.select("event_id", C.score_event(answer, F.lit("gold"), F.when(k % 3 < 2, False)).alias("score"))


@query("SELECT event_id, event_id % 4 IN (0, 2) AS match FROM events")
def answers_all_match(t: Tables) -> DataFrame:
    from tessera.operators import acceptance as A

    k = F.col("event_id") % 4
    said = F.when(k == 0, F.array(F.lit("A) gold"), F.lit(" "))).when(k == 1, F.array(F.lit("gold"), F.lit("lead"))).when(k == 2, F.array(F.lit(" "))).otherwise(F.array(F.lit("gold")))
    return t.events.select("event_id", A.answers_match(said, F.when(k < 2, "Gold.").otherwise("")).alias("match"))


@query("""
WITH e AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id, count(*)::INTEGER AS n, max(value) AS best FROM e WHERE r <= 3 GROUP BY user_id
""")
def best_spread_without_distance(t: Tables) -> DataFrame:
    """spread_best with distance zero is the top of each video, which SQL can say."""
    items = t.events.groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("score"), F.col("event_id").cast("double").alias("at"))).alias("x"), F.max("value").alias("best"))
    return items.select("user_id", F.size(O.spread_best(F.col("x"), 0.0, 3)).alias("n"), "best")
