"""Queries on training rows: chat templates, tool dialects, labels, packs, preference pairs, batches, further advantages, plugins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import plugins
from tessera.functions import templates as H
from tessera.functions import tools
from tessera.operators import advantages as A
from tessera.operators import batches as B
from tessera.operators import conversations as C
from tessera.operators import metrics as M
from tessera.operators import packing as K
from tessera.registry import Tables, query
from tessera.shipping import ship

DIALECTS = sorted(tools.DIALECTS)


@query(
    "SELECT p_partkey, dialect, n::INTEGER AS n, p_name AS name, p_size::VARCHAR AS size, p_type AS kind, '[\"a\",1]' AS tags, 'true' AS flag FROM part, (VALUES " + ", ".join(
        f"('{d}', {1 if d == 'two_lines' else 2})" for d in DIALECTS
    ) + ") AS v(dialect, n)"
)
def tool_dialects(t: Tables) -> DataFrame:
    """Two calls through every dialect and back (one that holds one call only: the first)."""
    arguments = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit(', "kind": "'), "p_type", F.lit('", "tags": ["a",1], "flag": true}'))
    call = lambda name: F.struct(F.lit(name).alias("name"), arguments.alias("arguments"))
    out = None
    for d in DIALECTS:
        calls = F.array(call("get_part")) if d == "two_lines" else F.array(call("get_part"), call("other"))
        rows = t.part.select("p_partkey", tools.read(tools.written(calls, d), d).alias("c"))
        get = lambda k: F.get_json_object(F.col("c")[0]["arguments"], f"$.{k}")
        part = rows.select(
            "p_partkey", F.lit(d).alias("dialect"), F.when(F.col("c")[0]["name"] == "get_part", F.size("c")).alias("n"), get("name").alias("name"),
            get("size").alias("size"), get("kind").alias("kind"), get("tags").alias("tags"), get("flag").alias("flag"),
        )
        out = part if out is None else out.unionAll(part)
    return out


def _messages(t: Tables) -> DataFrame:
    rows = t.conversations.where("text is not null")
    m = F.struct("turn", C.message(F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"), F.col("text")).alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("messages"))


def _rendered(user: str, assistant: str, lead: str = "", first: str | None = None) -> str:
    """SQL of a conversation's text; first: the form of the first user turn."""
    def put(form: str) -> str:
        before, after = form.split("{content}")
        return f"'{before}' || text || '{after}'"

    return f"string_agg(CASE WHEN i = 1 THEN '{lead}' || {put(first or user)} WHEN i % 2 = 1 THEN {put(user)} ELSE {put(assistant)} END, '' ORDER BY turn)".replace("\n", "' || chr(10) || '")


@query(f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, count(*) AS n,
  {_rendered(H.TEMPLATES["llama3"].user, H.TEMPLATES["llama3"].assistant, H.TEMPLATES["llama3"].start + H.TEMPLATES["llama3"].system.replace("{content}", "Be kind."))} AS llama3,
  {_rendered(H.TEMPLATES["mistral"].user, H.TEMPLATES["mistral"].assistant, H.TEMPLATES["mistral"].start, H.TEMPLATES["mistral"].user.replace("{content}", H.TEMPLATES["mistral"].system.replace("{content}", "Be kind.") + "{content}"))} AS mistral,
  {_rendered(H.TEMPLATES["qwen"].user, H.TEMPLATES["qwen"].assistant, H.TEMPLATES["qwen"].system.replace("{content}", "Be kind."))} AS qwen FROM m GROUP BY conv_id)
SELECT conv_id, llama3, mistral, qwen, ((n + 1) // 2)::INTEGER AS pairs FROM c
""")
def chat_templates(t: Tables) -> DataFrame:
    rows = _messages(t)
    said = F.lit("Be kind.")
    return rows.select("conv_id", *(H.whole(F.col("messages"), said, n).alias(n) for n in ("llama3", "mistral", "qwen")), F.size(H.turns(F.col("messages"), said, "yi")).alias("pairs"))


@query("""
WITH m AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, '<|system|>' || chr(10) || 'You are Zephyr, a helpful assistant.</s>' || string_agg(CASE WHEN i % 2 = 1 THEN '<|user|>' || chr(10) || text || '</s><|assistant|>' || chr(10) ELSE text || '</s>' END, '' ORDER BY turn) FILTER (i < n OR n % 2 = 1) AS source, max(CASE WHEN i = n AND n % 2 = 0 THEN text || '</s>' END) AS target FROM m GROUP BY conv_id
""")
def last_turns(t: Tables) -> DataFrame:
    return _messages(t).select("conv_id", H.one_turn(F.col("messages"), F.lit(None).cast("string"), "zephyr").alias("p")).select("conv_id", "p.source", "p.target")


def _ids(n: Column, first: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (first + i).cast("int"))


@query("""
WITH r AS (SELECT p_partkey, 3 + p_size % 40 AS s, 2 + p_size % 23 AS g FROM part), t AS (SELECT *, least(g, CASE WHEN g * 2 < 30 THEN 30 WHEN s * 2 < 30 THEN 30 - s ELSE trunc(30.0::DOUBLE * g / (s + g))::INTEGER END) AS t FROM r)
SELECT p_partkey, (t + least(greatest(30 - t, 0), s))::INTEGER AS n, least(greatest(30 - t, 0), s)::INTEGER AS ignored, (2000 + t)::INTEGER AS last FROM t
""")
def masked_label_rows(t: Tables) -> DataFrame:
    s, g = 3 + F.col("p_size") % 40, 2 + F.col("p_size") % 23
    labels = C.masked_labels(_ids(s, F.lit(1)), _ids(g, F.lit(2001)), 30)
    kept = F.filter(labels, lambda x: x != -100)
    return t.part.select("p_partkey", F.size(labels).alias("n"), F.size(F.filter(labels, lambda x: x == -100)).alias("ignored"), F.element_at(kept, -1).alias("last"))


@query(
    "SELECT p_partkey, 10 + least(p_size % 7 + 3, 10)::INTEGER AS n, (10 - 5 + least(p_size % 7 + 3, 10) - least(p_size % 7 + 3, 5))::INTEGER AS learnt, 10::INTEGER AS n_last, 6::INTEGER AS learnt_last FROM part"
)
def labels_over_turns(t: Tables) -> DataFrame:
    """Two turns within a budget of 20 tokens; then the last turn first, within one of 10, of which it takes all."""
    k = F.col("p_size") % 7 + 3
    pairs = F.array(
        F.struct(_ids(F.lit(5), F.lit(1)).alias("source"), _ids(F.lit(5), F.lit(11)).alias("target")),
        F.struct(
            _ids(F.least(k, F.lit(5)), F.lit(21)).alias("source"),
            F.when(k > 5, _ids(F.greatest(k - 5, F.lit(1)), F.lit(31))).otherwise(F.array().cast("array<int>")).alias("target"),
        ),
    )
    whole = K.turn_labels(pairs, 20)
    last = F.array(pairs[0], F.struct(_ids(F.lit(4), F.lit(1)).alias("source"), _ids(F.lit(6), F.lit(11)).alias("target")))
    masked = K.turn_labels(last, 10, mask_history=True)
    learnt = lambda x: F.size(F.filter(x["labels"], lambda v: v != -100))
    return t.part.select("p_partkey", F.size(whole["input_ids"]).alias("n"), learnt(whole).alias("learnt"), F.size(masked["input_ids"]).alias("n_last"), learnt(masked).alias("learnt_last"))


@query(
    "SELECT p_partkey, 4 + 3::INTEGER AS chosen, 4 + (1 + p_size % 3)::INTEGER AS rejected, 3::INTEGER AS learnt, (p_size % 3 + 1)::INTEGER AS learnt_rejected, 4::INTEGER AS prompt, 3::INTEGER AS answer FROM part"
)
def preference_pairs(t: Tables) -> DataFrame:
    p = K.pairwise(_ids(F.lit(4), F.lit(1)), _ids(F.lit(3), F.lit(11)), _ids(1 + F.col("p_size") % 3, F.lit(21)), 50)
    u = K.unsupervised(_ids(F.lit(4), F.lit(1)), _ids(F.lit(3), F.lit(11)), 50)
    learnt = lambda x: F.size(F.filter(x, lambda v: v != -100))
    return t.part.select(
        "p_partkey", F.size(p["chosen_ids"]).alias("chosen"), F.size(p["rejected_ids"]).alias("rejected"), learnt(p["chosen_labels"]).alias("learnt"),
        learnt(p["rejected_labels"]).alias("learnt_rejected"), F.size(u["input_ids"]).alias("prompt"), F.size(u["labels"]).alias("answer"),
    )


@query("""
WITH d AS (SELECT p_partkey, p_partkey // 100 AS b, p_size % 9 + 1 AS n FROM part), s AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY p_partkey, i) - 1 AS j, CASE WHEN i = n THEN -1 ELSE p_partkey END AS id FROM d, (SELECT unnest(range(0, 11)) AS i) WHERE i <= n)
SELECT b AS batch, (j // 16)::INTEGER AS block, sum(id)::BIGINT AS total FROM s GROUP BY b, j // 16 HAVING count(*) = 16
""")
def pretraining_blocks(t: Tables) -> DataFrame:
    n = F.col("p_size") % 9 + 1
    rows = t.part.select("p_partkey", F.array_repeat(F.col("p_partkey").cast("int"), n).alias("ids"))
    out = K.pretraining(rows, "ids", "p_partkey", F.floor(F.col("p_partkey") / 100), 16, -1)
    return out.select("batch", "block", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""
WITH d AS (SELECT p_partkey, p_partkey // 200 AS b, p_size % 12 + 1 AS n FROM part)
SELECT b AS batch, count(*)::BIGINT AS examples, sum(n)::BIGINT AS tokens, sum(n * p_partkey)::BIGINT AS ids, sum(n * (n - 1) / 2)::BIGINT AS positions, true AS in_order, true AS full FROM d GROUP BY b
""")
def packed_training_rows(t: Tables) -> DataFrame:
    """Totals over the packs of each batch, which no packing may change; examples are numbered from 1 in each pack, and every pack is full."""
    ship(t.spark)
    n = F.col("p_size") % 12 + 1
    ids = F.array_repeat(F.col("p_partkey").cast("int"), n)
    rows = t.part.select("p_partkey", ids.alias("ids"), ids.alias("labels"))
    out = K.packed_examples(rows, "p_partkey", "ids", "labels", F.floor(F.col("p_partkey") / 200), 64, 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    on = F.size(F.filter("attention", lambda a: a > 0))
    labels = total(F.filter("labels", lambda v: v != -100))
    out = out.select(
        "batch", "n", on.alias("tokens"), total("input_ids").alias("ids"), total("position_ids").alias("positions"),
        ((F.array_max("attention") == F.col("n")) & (F.size("input_ids") == 64) & (labels == total("input_ids"))).alias("ok"),
        F.size("attention").alias("size"),
    )
    return out.groupBy("batch").agg(
        F.sum("n").alias("examples"), F.sum("tokens").alias("tokens"), F.sum("ids").alias("ids"), F.sum("positions").alias("positions"),
        F.bool_and("ok").alias("in_order"), F.bool_and(F.col("size") == 64).alias("full"),
    )


@query("SELECT p_partkey, ((1 + p_size % 4) * (2 + p_size % 4) / 2 + 6)::BIGINT AS seen FROM part")
def block_masks(t: Tables) -> DataFrame:
    n = 1 + F.col("p_size") % 4
    attention = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(2), 3), F.array(F.lit(0), F.lit(0)))
    mask = K.block_mask(attention)
    return t.part.select("p_partkey", F.aggregate(F.flatten(mask), F.lit(0).cast("long"), lambda a, x: a + x).alias("seen"))


@query("SELECT p_partkey, CASE WHEN p_size > 8 THEN 8 ELSE p_size END::INTEGER AS n, CASE WHEN p_size > 8 THEN 0 ELSE 8 - p_size END::INTEGER AS pads FROM part")
def padded_batches(t: Tables) -> DataFrame:
    x = K.padded_batch(_ids(F.col("p_size"), F.lit(1)), 8, 0, left=True)
    return t.part.select("p_partkey", F.size(F.filter(x, lambda v: v > 0)).alias("n"), F.size(F.filter(x, lambda v: v == 0)).alias("pads"))


@query("SELECT d.b AS batch, count(*)::BIGINT AS rows, sum(n)::BIGINT AS tokens, true AS whole FROM (SELECT doc_id // 100 AS b, least(n_chars, 5000) AS n FROM documents) d GROUP BY d.b")
def token_budgets(t: Tables) -> DataFrame:
    """Micro-batches hold every row once and restore the order."""
    ship(t.spark)
    rows = t.documents.select("doc_id", F.least("n_chars", F.lit(5000)).alias("n"))
    out = B.with_micro_batches(rows, F.floor(F.col("doc_id") / 100), "doc_id", "n", 40_000).join(rows, "doc_id")
    back = out.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("back", "doc_id"))).alias("b"), F.count("*").alias("rows"), F.sum("n").alias("tokens"),
        F.count_distinct("place").alias("places"),
    )
    ordered = F.transform("b", lambda x: x["doc_id"])
    return back.select("batch", "rows", "tokens", ((F.array_sort(ordered) == ordered) & (F.col("places") == F.col("rows"))).alias("whole"))


@query("SELECT doc_id // 250 AS batch, count(DISTINCT doc_id % 50)::BIGINT AS groups, true AS dealt_whole FROM documents GROUP BY 1")
def balanced_group_counts(t: Tables) -> DataFrame:
    """Each group of a batch lies in one part."""
    ship(t.spark)
    rows = t.documents.select("doc_id", (F.col("doc_id") % 50).alias("g"), "n_chars")
    out = K.balanced_groups(rows, "doc_id", "g", "n_chars", F.floor(F.col("doc_id") / 250), 5)
    per = out.groupBy("batch", "g").agg(F.count_distinct("part").alias("k")).groupBy("batch").agg(F.count("*").alias("groups"), F.max("k").alias("k"))
    return per.select("batch", "groups", (F.col("k") == 1).alias("dealt_whole"))


@query("SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS most, (max(s) - min(s))::BIGINT AS spread, round(avg(s), 6) AS mean FROM (SELECT sum(n_chars) AS s FROM documents GROUP BY doc_id % 7)")
def imbalance_of_parts(t: Tables) -> DataFrame:
    return K.imbalance(t.documents.withColumn("part", F.col("doc_id") % 7), "part", "n_chars").select("least", "most", "spread", F.round("mean", 6).alias("mean"))


@query(
    "WITH n AS (SELECT count(*) // 7 AS size, count(*) % 7 AS more FROM embeddings) SELECT vec_id, (CASE WHEN vec_id < more * (size + 1) THEN vec_id // (size + 1) ELSE more + (vec_id - more * (size + 1)) // size END)::INTEGER AS chunk FROM embeddings, n"
)
def chunked_rows(t: Tables) -> DataFrame:
    return B.chunked(t.embeddings.select("vec_id"), "vec_id", t.embeddings.count(), 7).select("vec_id", "chunk")


@query('SELECT v.j::INTEGER AS "at", vec_id FROM embeddings JOIN (VALUES (0, 5), (1, 5), (2, (SELECT max(vec_id) FROM embeddings)), (3, 0)) AS v(j, place) ON vec_id = place')
def selected_rows(t: Tables) -> DataFrame:
    return B.selected(t.embeddings.select("vec_id"), "vec_id", [5, 5, -1, 0]).select("at", "vec_id")


@query(
    "SELECT vec_id, false AS padding FROM embeddings UNION ALL SELECT (SELECT count(*) FROM embeddings) + vec_id, true FROM embeddings WHERE vec_id < (64 - (SELECT count(*) FROM embeddings) % 64) % 64"
)
def padded_to_divisor(t: Tables) -> DataFrame:
    rows = B.padded(t.embeddings.select("vec_id"), "vec_id", t.embeddings.count(), 64)
    assert B.unpadded(rows).columns == ["vec_id"]
    return rows


@query("SELECT vec_id, (vec_id // ((SELECT count(*) FROM embeddings) // 4))::INTEGER AS worker, label + 1 AS label FROM embeddings")
def dealt_to_workers(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label")

    def work(pdf):
        return pdf.assign(label=pdf.label + 1)

    return B.worked(rows, "vec_id", 4, work, "vec_id long, label int, worker int", rest=True)


@query('SELECT event_id, (i // 300)::INTEGER AS batch, (i % 300)::INTEGER AS "at" FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i >= 600')
def resumed_reading(t: Tables) -> DataFrame:
    return B.resumed(t.events.select("event_id", "ts"), ["ts", "event_id"], 300, 2).select("event_id", "batch", "at")


@query("SELECT sum(n)::BIGINT AS rows, round(avg(m), 6) AS value FROM (SELECT count(*) AS n, avg(value) AS m FROM events GROUP BY event_id % 3)")
def assembled_batch(t: Tables) -> DataFrame:
    rows, means = B.assembled([t.events.where(F.col("event_id") % 3 == k).select("event_id", "value") for k in range(3)], ["value"])
    return rows.agg(F.count("*").alias("rows")).crossJoin(means.select(F.round("value", 6).alias("value")))  # one row each


@query("SELECT n_nationkey AS place, n_name AS name FROM nation UNION ALL SELECT 25 + r_regionkey, r_name FROM region")
def appended_dataset(t: Tables) -> DataFrame:
    return B.appended(t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name")), "place")


@query("""
WITH p AS (SELECT vec_id, vec_id % 25 AS g, i, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS j, embedding[i]::DOUBLE AS r, abs(embedding[i + 8]::DOUBLE) AS w FROM embeddings, (SELECT unnest(range(1, 9)) AS i) WHERE (i + vec_id) % 3 > 0 AND i <= 3 + vec_id % 6), s AS (
  SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY i) AS ww, sum(r) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gg FROM p), n AS (SELECT g, count(DISTINCT vec_id) AS rows FROM p GROUP BY g)
SELECT vec_id, (i - 1)::INTEGER AS place, round(gg - CASE WHEN rows > 1 THEN sum(gg * ww) OVER x / (sum(ww) OVER x + 1e-8) ELSE 0 END, 6) AS advantage, round(gg - CASE WHEN rows > 1 AND count(*) OVER x > 1 THEN sum(gg * ww) OVER x / (sum(ww) OVER x + 1e-8) ELSE 0 END, 6) AS without_tail
FROM s JOIN n USING (g) WINDOW x AS (PARTITION BY g, j)
""")
def multi_turn_baseline(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    on = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(((i + F.col("vec_id")) % 3 > 0) & (i <= 3 + F.col("vec_id") % 6), 1.0).otherwise(0.0))
    rows = t.embeddings.select("vec_id", (F.col("vec_id") % 25).alias("g"), F.slice(v, 1, 8).alias("r"), F.transform(F.slice(v, 9, 8), F.abs).alias("w"), on.alias("m"))
    plain = M.token_baseline(rows, "vec_id", "g", "r", "w", "m").select("vec_id", "place", F.round("advantage", 6).alias("advantage"))
    tail = M.token_baseline(rows, "vec_id", "g", "r", "w", "m", zero_tail=True).select("vec_id", "place", F.round("advantage", 6).alias("without_tail"))
    return plain.join(tail, ["vec_id", "place"])


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 5), lambda i: (1 - 2 * exp(-abs(embedding[i]::DOUBLE)) + 0.5) * 4)), 6) AS total FROM embeddings")
def weights_of_paths(t: Tables) -> DataFrame:
    logp = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda x: -F.abs(x))
    w = M.path_weights(logp, F.array_repeat(F.lit(0.5), 4), F.array_repeat(F.lit(2.0), 4))
    return t.embeddings.select("vec_id", F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * 5) AS z FROM embeddings), p AS (SELECT vec_id, z, list_sum(list_transform(z, lambda x: exp(x))) AS s FROM e)
SELECT vec_id, round(z[3] - ln(s), 6) AS logp, round(-list_sum(list_transform(z, lambda x: exp(x) / s * (x - ln(s)))), 6) AS entropy, round(list_sum(list_transform(z, lambda x: pow(exp(x) / s, 2))), 6) AS sum_pi_squared FROM p
""")
def softmax_values(t: Tables) -> DataFrame:
    z = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x: x * 5)
    return t.embeddings.select("vec_id", M.softmax_statistics(z, F.lit(2)).alias("s")).select("vec_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("logp", "entropy", "sum_pi_squared")))


@query("""
WITH RECURSIVE t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id, value / 100 AS r, (event_id % 7)::DOUBLE AS v0, (event_id % 5)::DOUBLE AS v1 FROM events), n AS (SELECT user_id, max(i) AS n FROM t GROUP BY user_id),
h AS (SELECT t.user_id, t.i, t.event_id, 2 * r - v1 AS g, v1, v0, r FROM t JOIN n ON t.user_id = n.user_id AND t.i = n.n
  UNION ALL SELECT t.user_id, t.i, t.event_id, 2 * t.r + 0.87 * h.v1 - t.v1 + 0.87 * 0.53 * h.g, t.v1, t.v0, t.r FROM h JOIN t ON t.user_id = h.user_id AND t.i = h.i - 1)
SELECT event_id, round(g, 8) AS last_advantage, round(0.8 * v1 - v0 + 0.8 * 0.53 * g, 8) AS first_advantage, round(g + v1, 8) AS last_return FROM h
""")
def two_level_advantages(t: Tables) -> DataFrame:
    """Two tokens a turn: the last one's reward is the turn's return over turns."""
    ship(t.spark)
    r = F.col("value") / 100
    rows = t.events.select(
        "user_id", "event_id", F.array(r, r, F.lit(9.0)).alias("r"),
        F.array((F.col("event_id") % 7).cast("double"), (F.col("event_id") % 5).cast("double"), F.lit(3.0)).alias("v"),
        F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("m"),
    )
    out = A.two_level_gae(rows, ["user_id"], "event_id", "r", "v", "m", 0.8, 0.53, 0.87)
    return out.select(
        "event_id", F.round(F.col("advantages")[1], 8).alias("last_advantage"), F.round(F.col("advantages")[0], 8).alias("first_advantage"),
        F.round(F.col("returns")[1], 8).alias("last_return"),
    )


@query(
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS naive, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 1 THEN 1.0 WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN 1.0 WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS by_source, round(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END + least(-(p_size * 20 - 800) / 200.0, 0), 6) AS overlong FROM part"
)
def reward_managers(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("not "), "p_name")).alias("a"), F.col("p_name").alias("g"),
        F.when(F.col("p_size") % 3 == 0, "loose").otherwise("strict").alias("s"), (F.col("p_size") * 20).alias("length"),
    )
    make = lambda name, **more: plugins.MANAGERS.find(name)(rows, "a", "g", "s", **more).select("p_partkey", F.round("reward", 6).alias(name))
    return make("naive").join(make("by_source", rules={"loose": "subem", "strict": "em"}), "p_partkey").join(make("overlong"), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM part")
def scorers_by_path(t: Tables) -> DataFrame:
    f = plugins.scorer_of("tessera.functions.scorers:exact")
    return t.part.select("p_partkey", f(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("x"), F.col("p_name"), None).alias("score"))


@query(
    "WITH e AS (SELECT event_id, user_id, epoch(ts)::DOUBLE % 5000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::DOUBLE % 5000, event_id) AS i FROM events) SELECT event_id, round(max(s - i / 0.01) OVER (PARTITION BY user_id ORDER BY s, event_id) + i / 0.01, 3) AS admitted FROM e"
)
def rate_limited_calls(t: Tables) -> DataFrame:
    from tessera.registry import seconds

    rows = t.events.select("event_id", "user_id", (seconds("ts") % 5000).alias("s"))
    return plugins.admitted(rows, ["user_id"], "s", 0.01, ["event_id"]).select("event_id", F.round("admitted", 3).alias("admitted"))


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN 'seven' ELSE 'other' END AS generated FROM part")
def generated_by_backend(t: Tables) -> DataFrame:
    ship(t.spark)
    backend = plugins.BACKENDS.find("mock")({"part 7": "seven"}, "other")
    return plugins.generated(t.part.select("p_partkey", F.concat(F.lit("part "), F.col("p_size").cast("string")).alias("q")), "q", backend).select("p_partkey", "generated")


@query("SELECT event_type AS source, round(0.5 + 0.5 * greatest(0.1, 4 * p * (1 - p)), 6) AS weight FROM (SELECT event_type, avg((value > 30)::INTEGER) AS p FROM events GROUP BY event_type)")
def curriculum_weights(t: Tables) -> DataFrame:
    names = [r.event_type for r in t.events.select("event_type").distinct().collect()]  # few names
    weights = plugins.Curriculum(names).update(t.events, "event_type", F.col("value") > 30)
    return t.spark.createDataFrame(sorted(weights.items()), "source string, weight double").select("source", F.round("weight", 6).alias("weight"))


@query(
    "SELECT conv_id, CASE WHEN n % 2 = 0 THEN n - 1 ELSE 0 END::INTEGER AS prompt, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS response, 2::INTEGER AS answers FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"
)
def openai_and_pairs(t: Tables) -> DataFrame:
    calls = "array<struct<name:string,arguments:string>>"
    m = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit(None).cast(calls).alias("tool_calls")))
    rows = _messages(t)
    a = C.openai(rows.withColumn("messages", m)).select("conv_id", F.size("_prompt").alias("prompt"), F.size("_response").alias("response"))
    b = C.pairs(rows.withColumns({"chosen": F.lit("x"), "rejected": F.lit("y")})).select("conv_id", F.size("_response").alias("answers"))
    return a.join(b, "conv_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT // 64 AS buffer FROM documents")
def shuffle_buffers(t: Tables) -> DataFrame:
    from tessera.streaming import windows

    out = windows.buffer_shuffled(t.documents.select("doc_id"), ["doc_id"], 64, "b")
    return out.select("doc_id", F.col("place.buffer").alias("buffer"))


@query("SELECT event_id FROM events WHERE user_id >= 120")
def fresh_rows(t: Tables) -> DataFrame:
    from tessera.streaming import windows

    return windows.in_step(t.events, "user_id", 149, 29).select("event_id")


@query("""
WITH m AS (SELECT doc_id // 50 AS batch, doc_id // 10 % 5 AS micro, sum(n_chars) AS cost FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY cost, micro) - 1 AS r, count(*) OVER (PARTITION BY batch) AS n FROM m)
SELECT batch, micro, CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END::BIGINT AS "at" FROM r
""")
def small_ends_order(t: Tables) -> DataFrame:
    """Micro-batches of ten documents: of each batch of five, the cheapest at both ends."""
    costs = t.documents.groupBy(F.floor(F.col("doc_id") / 50).alias("batch"), (F.floor(F.col("doc_id") / 10) % 5).alias("micro")).agg(F.sum("n_chars").alias("cost"))
    return K.ends_first(costs, ["batch"], "cost", "micro").select("batch", "micro", "at")


@query("""
SELECT event_id, round(0.2 * exp(sum(ln(1 + least(greatest(value / 20 - 1, -0.2), 0.2) * 64 / 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 9) AS penalty FROM events
""")
def adaptive_penalty(t: Tables) -> DataFrame:
    """A coefficient for each user that follows a divergence of 20: values are divergences, 64 steps each."""
    return A.adaptive_penalties(t.events, ["user_id"], ["ts", "event_id"], "value", 0.2, 20.0, 1000, 64).select("event_id", F.round("penalty", 9).alias("penalty"))
