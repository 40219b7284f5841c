"""Queries on scripted steps: each nation is a video with the same few steps, whose memory, repairs and grades are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import judging as J
from tessera.functions import tools
from tessera.operators import annotations as A
from tessera.operators import conversations as C
from tessera.operators import packing as K
from tessera.plans.prompts import _cases, _quoted, _sql_cases
from tessera.registry import Tables, query
from tessera.shipping import ship
from tessera.streaming import memory, tagged

HEAD = "<state>s</state><answer></answer>"
#: (start, end, question, output): a note and a bridge; the bridge goes on; two bridges around a note; nothing, long after.
STEPS = [
    (0.0, 5.0, None, HEAD + '<anchor t="0-1"></anchor><delta t="1-5">one</delta>'),
    (5.0, 10.0, "what?", HEAD + '<delta t="1-10">two</delta>'),
    (10.0, 15.0, None, "<state>s</state><answer>yes</answer>" + '<anchor t="12-13"></anchor><delta t="10-12">x</delta><delta t="13-15">y</delta>'),
    (130.0, 135.0, None, HEAD),
]
#: Notes, bridges, notes still seen, start of the open tail, repairs.
AFTER = [(1, 1, 1, 1.0, 0), (1, 1, 1, 1.0, 0), (2, 2, 2, 13.0, 2), (2, 2, 0, 13.0, 1)]
SHOWN = [
    '<anchor t="0.0-1.0">[image]</anchor>\n<delta t="1.0-5.0">one</delta>',
    '<anchor t="0.0-1.0">[image]</anchor>\n<delta t="1.0-10.0">two</delta>',
    '<anchor t="0.0-1.0">[image]</anchor>\n<delta t="1.0-12.0">two x</delta>\n<anchor t="12.0-13.0">[image]</anchor>\n<delta t="13.0-15.0">y</delta>',
    '<anchor t="0.0-1.0"></anchor>\n<delta t="1.0-12.0">two x</delta>\n<anchor t="12.0-13.0"></anchor>\n<delta t="13.0-135.0">y</delta>',
]


def scripted(t: Tables) -> DataFrame:
    steps = t.spark.createDataFrame([(i, *s) for i, s in enumerate(STEPS)], "step_index long, step_start double, step_end double, question string, raw string")
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("video_id")).crossJoin(F.broadcast(steps))  # a script of four steps
    return tagged.recovered(tagged.parsed(rows))


def _literal(rows: list[tuple], names: str) -> str:
    item = lambda v: "NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(item, r)) + ")" for r in rows) + f") AS v({names})"


@query(
    "SELECT n_nationkey::BIGINT AS video_id, step_index::BIGINT AS step_index, n_notes, n_bridges, n_seen, tail_start::DOUBLE AS tail_start, n_repairs, memory FROM nation, " + _literal(
        [(i, *a, s) for i, (a, s) in enumerate(zip(AFTER, SHOWN, strict=True))], "step_index, n_notes, n_bridges, n_seen, tail_start, n_repairs, memory",
    )
)
def memory_of_scripted_videos(t: Tables) -> DataFrame:
    ship(t.spark)
    return memory.replay(scripted(t))


@query("SELECT n_nationkey::BIGINT AS video_id, policy, memory FROM nation, " + _literal([
    ("anchor_only", '<anchor t="0.0-1.0"></anchor>\n<anchor t="12.0-13.0"></anchor>'), ("delta_only", '<delta t="1.0-12.0">two x</delta>\n<delta t="13.0-135.0">y</delta>'), ("none", ""),
], "policy, memory"))
def memory_by_policy(t: Tables) -> DataFrame:
    """What each policy shows at the end."""
    ship(t.spark)
    out = None
    for p in ("anchor_only", "delta_only", "none"):
        part = memory.replay(scripted(t), p).where("step_index = 3").select(
            "video_id", F.lit(p).alias("policy"),
            F.when(F.lit(p == "anchor_only"), F.regexp_replace("memory", r"\n?<delta.*?</delta>", "")).otherwise(F.col("memory")).alias("memory"),
        )
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT n_nationkey::BIGINT AS video_id, query_id::BIGINT AS query_id, memory FROM nation, " + _literal([(1, ""), (2, SHOWN[0]), (3, SHOWN[2])], "query_id, memory"))
def memory_at_queries(t: Tables) -> DataFrame:
    """Queries before the first step ends, in the second and after the third: one run of the steps serves all."""
    ship(t.spark)
    asked = t.spark.createDataFrame([(1, 3.0), (2, 7.0), (3, 50.0)], "query_id long, at double")
    queries = t.nation.select(F.col("n_nationkey").cast("long").alias("video_id")).crossJoin(F.broadcast(asked))  # three queries
    return memory.snapshots(scripted(t), queries)


#: (output of a step from 0 to 5, its issues, issues of the text-only form beyond them).
OUTPUTS = [
    (HEAD + '<anchor t="0-1"></anchor><delta t="1-5">a</delta>', "", "anchor_not_allowed,delta_time_mismatch"), (HEAD + '<delta t="0-5">a</delta>', "", ""), (HEAD + '<delta t="0-5"> </delta>', "", "empty_delta"), ("nothing", "text_outside_tags,no_tags", "delta_count"),
    (HEAD + '<delta t="0-2">a</delta><delta t="2-5">b</delta>', "", "delta_count,delta_time_mismatch,delta_time_mismatch"), ('<state><b>x</b></state><answer></answer><delta t="0-5">a</delta>', "state_contains_xml", ""), ('<answer></answer><state>s</state><delta t="0-5">a</delta>', "tag_order", ""),
]


def _outputs(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return tagged.parsed(t.nation.select("n_nationkey", _cases(k, [o[0] for o in OUTPUTS]).alias("raw"), F.lit(0.0).alias("step_start"), F.lit(5.0).alias("step_end")))


@query(
    f"SELECT n_nationkey, {_sql_cases('n_nationkey', [o[1] for o in OUTPUTS])} AS issues, {_sql_cases('n_nationkey', [','.join(x for x in (o[1], o[2]) if x) for o in OUTPUTS])} AS text_only FROM nation"
)
def issues_of_outputs(t: Tables) -> DataFrame:
    ship(t.spark)
    plain = _outputs(t)
    text = tagged.with_quality(plain, text_only=True)
    return text.select("n_nationkey", F.array_join("issues", ",").alias("issues"), F.array_join("quality.issues", ",").alias("text_only"))


@query(
    "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '- Answer with the tags only.' || chr(10) || '- Write exactly one <state>.' WHEN 1 THEN '' ELSE '- Mind: new_code' END AS feedback FROM nation"
)
def feedback_on_issues(t: Tables) -> DataFrame:
    k, codes = F.col("n_nationkey") % 3, lambda *c: F.array(*map(F.lit, c)).cast("array<string>")
    issues = F.when(k == 0, codes("no_tags", "state_count", "no_tags")).when(k == 1, codes()).otherwise(codes("new_code"))
    return t.nation.select("n_nationkey", tagged.feedback(issues).alias("feedback"))


#: (output, events with those from malformed tags, how many of them).
MALFORMED = [
    ('<anchor t="0-1"/>', "note 0.0-1.0", 1), ('<anchor t="0-1"></anchor><anchor t="0-1"/>', "note 0.0-1.0", 0), (
        '<anchor kind="x" t="1 - 2">z</anchor><delta t="2-5">b</delta>', "bridge 2.0-5.0,note 1.0-2.0", 1,
    ), ('<anchor frame="3" t="0-1"/>', "", 0),
    ('<anchor t="3-1"/><anchor/>', "", 0), ('<anchor t="1-2"/><anchor t="1-2"/>', "note 1.0-2.0", 1),
]


@query(f"SELECT n_nationkey, {_sql_cases('n_nationkey', [o[1] for o in MALFORMED])} AS events, {_sql_cases('n_nationkey', [o[2] for o in MALFORMED], '::INTEGER')} AS n FROM nation")
def malformed_notes(t: Tables) -> DataFrame:
    rows = tagged.recovered(tagged.parsed(t.nation.select("n_nationkey", _cases(F.col("n_nationkey"), [o[0] for o in MALFORMED]).alias("raw"))))
    text = F.transform("events", lambda e: F.concat(e["kind"], F.lit(" "), e["start"].cast("string"), F.lit("-"), e["end"].cast("string")))
    return rows.select("n_nationkey", F.array_join(text, ",").alias("events"), F.col("n_recovered").alias("n"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS children FROM lineitem GROUP BY l_orderkey")
def children_nested(t: Tables) -> DataFrame:
    rows = A.nested(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_returnflag", "l_partkey"], "c")
    return rows.select(
        "l_orderkey",
        F.array_join(
            F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_returnflag"])), ",",
        ).alias("children"),
    )


GOLD_CALL = '[{"name": "f", "parameters": {"a": 1, "b": 2}}]'
#: (calls made, likeness to the gold call): the same; one value other; another name; no calls; no JSON.
CALLS = [(GOLD_CALL, 3.0), (GOLD_CALL.replace("2", "3"), 6 * 3 / 4 - 3), (GOLD_CALL.replace('"f"', '"g"'), -3.0), ("[]", -3.0), ("nonsense", -3.0)]
#: (text, 1 if it is thinking and then one call).
FORMATS = [("<think>x</think>\n<tool_call>\n{}\n</tool_call>", 1.0), ("<tool_call>\n{}\n</tool_call>", 0.0), ("<think>x</think>\n<tool_call>\n{}\n</tool_call>\n<tool_call>\n{}\n</tool_call>", 0.0)]


@query(f"SELECT p_partkey, round({_sql_cases('p_partkey', [c[1] for c in CALLS], '::DOUBLE')}, 6) AS likeness, {_sql_cases('p_partkey', [c[1] for c in FORMATS], '::DOUBLE')} AS shape FROM part")
def tool_call_rewards(t: Tables) -> DataFrame:
    ship(t.spark)
    k = F.col("p_partkey")
    made, text = _cases(k, [c[0] for c in CALLS]), _cases(k, [c[0] for c in FORMATS])
    return t.part.select("p_partkey", F.round(J.tool_calls(made, F.lit(GOLD_CALL)), 6).alias("likeness"), tools.format_reward(text, F.lit(True), F.lit(False)).alias("shape"))


@query(
    "SELECT p_partkey, 'user:' || p_name || coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, '') || ':0.0,assistant:' || p_type || ':1.0' AS alpaca, 'system:a:0.0,user:' || p_name || ':0.0,assistant:' || p_type || ':1.0,tool:t:0.0' AS sharegpt FROM part"
)
def weighted_messages(t: Tables) -> DataFrame:
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"], m["loss_weight"].cast("string"))), ",")
    a = C.weighted_alpaca(t.part.withColumn("input", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))), "p_name", "input", "p_type").select("p_partkey", text.alias("alpaca"))
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    turns = F.array(turn("system", F.lit("a")), turn("human", F.col("p_name")), turn("stranger", F.lit("x")), turn("gpt", F.col("p_type")), turn("observation", F.lit("t")))
    return a.join(C.weighted_sharegpt(t.part.withColumn("conversations", turns)).select("p_partkey", text.alias("sharegpt")), "p_partkey")


@query("SELECT doc_id // 500 AS batch, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS total, true AS even FROM documents GROUP BY 1")
def balance_of_sums(t: Tables) -> DataFrame:
    """Parts of nearly equal sums hold each row once; no part is further from the mean than the longest row."""
    ship(t.spark)
    rows = t.documents.select("doc_id", "n_chars")
    parts = K.balanced(rows, "doc_id", "n_chars", F.floor(F.col("doc_id") / 500), 8).join(rows, "doc_id").groupBy("batch", "part").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("most"),
    )
    out = parts.groupBy("batch").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.max("s").alias("hi"), F.min("s").alias("lo"), F.max("most").alias("most"))
    return out.select("batch", "n", "total", (F.col("hi") - F.col("lo") <= F.col("most")).alias("even"))
