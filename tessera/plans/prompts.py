"""Queries on prompts, benchmark scores, judges and mathematics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import benchmarks as B
from tessera.functions import judges as J
from tessera.functions import judging
from tessera.functions import mathematics as X
from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.registry import Tables, query
from tessera.shipping import ship

UPDATES = P.UPDATES.replace("'", "''")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(key: Column, values: list) -> Column:
    """values by key modulo their number."""
    out = None
    for i, v in enumerate(values):
        k = key % len(values) == i
        out = F.when(k, F.lit(v)) if out is None else out.when(k, F.lit(v))
    return out


def _sql_cases(key: str, values: list, cast: str = "") -> str:
    item = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else _quoted(v)
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {item(v)}" for i, v in enumerate(values)) + " END)" + cast


@query(f"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{UPDATES}' || chr(10) || chr(10) || p_name ELSE '{UPDATES}' || chr(10) || chr(10) || '{UPDATES}x' END AS content, p_name AS question,
  'Based on the video so far, ' || lower(p_name[1]) || p_name[2:] AS realtime, 'Based on the video so far, answer the question.' AS empty FROM part
""")
def questions_with_prefix(t: Tables) -> DataFrame:
    name, odd = F.col("p_name"), F.col("p_size") % 2 == 1
    content = P.with_updates(P.with_updates(name))
    tail = F.when(odd, F.concat(name, F.lit("\nOptions:\nA. x"))).otherwise(F.concat(name, F.lit(" \n\nUpdate your answer when it changes.\nOptions:\nB. y")))
    return t.part.select("p_partkey", F.when(odd, P.with_updates(F.lit(f"{P.UPDATES}\n\n{P.UPDATES}x"))).otherwise(content).alias("content"), P.question_only(P.with_updates(tail)).alias("question"), P.realtime_question(F.concat(F.lit(" "), F.initcap(name), F.lit("\n"))).alias("r"), P.realtime_question(F.lit(" ")).alias("empty"), name.alias("n")).select("p_partkey", "content", "question", F.concat(F.substring("r", 1, len(P.SO_FAR)), F.substring("n", 1, 1), F.substring("n", 2, 1 << 30)).alias("realtime"), "empty")


@query(f"""
SELECT p_partkey, {_quoted(P.CHOICE.split('{question}')[0])} || p_name || {_quoted(P.CHOICE.split('{question}')[1].split('{options}')[0])} || 'A. ' || p_brand || '; B. ' || p_type || '; C. {{x}};' || {_quoted(P.CHOICE.split('{options}')[1])} AS choice,
  CASE p_size % 4 WHEN 0 THEN {_quoted(P.COUNTING.split('{activity}')[0])} || p_name || {_quoted(P.COUNTING.split('{activity}')[1])} WHEN 1 THEN {_quoted(P.STEP.split('{step}')[0])} || p_type || {_quoted(P.STEP.split('{step}')[1])}
    WHEN 2 THEN {_quoted(P.CLUE.split('{question}')[0])} || p_brand || {_quoted(P.CLUE.split('{question}')[1])} END AS forward FROM part
""")
def benchmark_prompts(t: Tables) -> DataFrame:
    task = _cases(F.col("p_size"), ["REC", "SSR", "CRR", "OCR"])
    return t.part.select(
        "p_partkey", P.choice_prompt(F.col("p_name"), F.array("p_brand", "p_type", F.lit("{x}"))).alias("choice"),
        P.forward_prompt(task, F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("forward"),
    )


#: (gold, answer, source letter, index that is expected of the options red car, Blue car., green).
GOLD = [
    ("A", "", None, 0), ("c", "", None, 2), ("D", "", None, None), ("1", "", None, 1), ("1", " RED car", None, 0), ("3", "", None, 2), ("0", "green", None, 0),
    ("9", "", None, None), ("blue  CAR", "", None, 1), ("none", "", None, None), ("2", "", "b", 1), ("2", "", "Z", 2), (None, "", None, None),
    ("-1", "", None, None),
]


@query(f"""
SELECT p_partkey, {_sql_cases('p_partkey', [g[3] for g in GOLD], '::INTEGER')} AS expected FROM part
""")
def expected_options(t: Tables) -> DataFrame:
    gt, answer, source = (_cases(F.col("p_partkey"), [g[i] for g in GOLD]).cast("string") for i in range(3))
    options = F.array(F.lit("red car"), F.lit("Blue car."), F.lit("green"))
    return t.part.select("p_partkey", P.expected_option(gt, options, answer, source).alias("expected"))


#: (task, answer, gold, score).
TASKS = [
    ("EPM", "The answer is B.", "B", 1), ("OCR", "2", "b", 1), ("OJR", "about 7 or 3", "C", 1), ("HLD", "F", "F", 0), ("REC", "1 then 2", "12", 1),
    ("REC", "none", "", 0), ("REC", "3 times", "3", 1), ("SSR", "Yes, yes.", "1", 1), ("CRR", "no", "0", 1), ("CRR", "yes or no", "1", 0), ("SSR", "", "0", 0),
    ("XYZ", "A", "A", None), ("ATR", None, "A", 0),
]


@query(f"""
SELECT event_id, {_sql_cases('event_id', [c[3] for c in TASKS], '::INTEGER')} AS score, {_sql_cases('event_id', [next((k for k, v in B.CATEGORIES.items() if c[0] in v), None) for c in TASKS], '::VARCHAR')} AS category FROM events
""")
def scores_by_task(t: Tables) -> DataFrame:
    task, answer, gold = (_cases(F.col("event_id"), [c[i] for c in TASKS]).cast("string") for i in range(3))
    rows = t.events.select("event_id", task.alias("task"), answer.alias("response"), gold.alias("gold"))
    return B.scored_runs(rows, "tasks").select("event_id", "score", B.category(F.col("task")).alias("category"))


#: (response, raw output, gold, opens with it, mentions it, first one said).
YES_NO = [
    ("Yes.", "", "yes", 1, 1, "yes"), (" yes", "", "Yes", 0, 1, "yes"), ("No, but yes", "", "yes", 0, 1, "no"), ("Nothing", "", "no", 1, 0, ""),
    ("", "no way", "no", 1, 1, "no"), ("maybe", "yes", "yes", 0, 0, ""), (None, None, "no", 0, 0, ""), ("yes", "", "maybe", 0, 0, "yes"),
]


@query(f"""
SELECT event_id, {_sql_cases('event_id', [c[3] for c in YES_NO], '::INTEGER')} AS opens_with, {_sql_cases('event_id', [c[4] for c in YES_NO], '::INTEGER')} AS mentions, {_sql_cases('event_id', [c[5] for c in YES_NO])} AS first FROM events
""")
def yes_no_rules(t: Tables) -> DataFrame:
    response, raw, gold = (_cases(F.col("event_id"), [c[i] for c in YES_NO]).cast("string") for i in range(3))
    rows = t.events.select("event_id", response.alias("response"), raw.alias("raw"), gold.alias("gold"))
    one = B.scored_runs(rows, "opens_with").select("event_id", F.col("score").alias("opens_with"))
    return one.join(B.scored_runs(rows, "mentions").select("event_id", F.col("score").alias("mentions"), F.col("prediction").alias("first")), "event_id")


@query("""
SELECT p_partkey, 'B' AS truth, (p_size % 3 = 1)::INTEGER AS score, (p_size % 3 = 1)::INTEGER AS by_letter, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS prediction FROM part
""")
def scored_choices(t: Tables) -> DataFrame:
    options = F.array("p_brand", "p_type")
    response = _cases(F.col("p_size"), ["I say A", "it is 2, or A?x B", "C D"])
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_size") % 3 == 1, "number 2").otherwise(response).alias("response"), F.col("p_type").alias("gold"),
        options.alias("options"), F.lit("").alias("answer"), F.lit(None).cast("string").alias("source_letter"),
    )
    found = B.scored_runs(rows, "options").select("p_partkey", F.col("ground_truth").alias("truth"), "score", "prediction")
    letters = B.scored_runs(rows.withColumn("gold", F.lit("B. this")), "letters").select("p_partkey", F.col("score").alias("by_letter"))
    return found.join(letters, "p_partkey")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 7)::VARCHAR END AS first, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN (event_id % 7)::VARCHAR ELSE 'last' END AS last FROM events
""")
def answer_elements(t: Tables) -> DataFrame:
    k = (F.col("event_id") % 7).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, "no element").when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("x<answer> "), k, F.lit("\n</answer>")),
    ).otherwise(F.concat(F.lit("<answer>"), k, F.lit("</answer> and <answer>last</answer>")))
    return t.events.select("event_id", B.first_answer_tag(text).alias("first"), T.last_answer_tag(text).alias("last"))


#: (text, number after ####, last number).
SUMS = [("so 3+4 #### 7", "7", "7"), ("#### 1,234", "1234", "1234"), ("it is 5.", None, "5."), ("#### 2 or #### -3", "-3", "-3"), ("none", None, None), ("", None, None), ("1 and .", None, "1")]


@query(f"""
SELECT event_id, {_sql_cases('event_id', [c[1] for c in SUMS], '::VARCHAR')} AS strict, {_sql_cases('event_id', [c[2] for c in SUMS], '::VARCHAR')} AS flexible FROM events
""")
def numbers_of_answers(t: Tables) -> DataFrame:
    text = _cases(F.col("event_id"), [c[0] for c in SUMS])
    return t.events.select("event_id", T.hash_answer(text).alias("strict"), T.hash_answer(text, strict=False).alias("flexible"))


#: (judge's text, form, score, first score, issues).
JUDGED = [
    ('{"keyframe_selection": 1, "bridge_quality": {"score": 0.5, "reason": "short"}, "semantic_alignment": "0.5", "state_factuality": 7}', "step", 0.75, 1.0, ""),
    ('Well: {"overall": {"rating": 0.25}, "keyframe_selection": -1, "issues": ["late", " "], "caps_applied": "one"} done', "step", 0.25, 0.0, "late|cap: one"),
    ("no object", "step", None, None, None),
    ('{"answer_reward": {"value": 0.5, "reason": "half"}, "issues": "x"}', "answer", 0.5, 0.5, "x"),
    ('{"delta_groundedness": 1, "note_keyframe": {"score": 1}, "semantic_alignment": 0.5, "state_groundedness": true}', "process", 1.75, 1.0, ""),
    (
        '{"semantic_alignment": {"checks": {"semantic_output_coherent": "yes", "semantic_text_anchor_express_current_frames": {"pass": true}, "semantic_no_cross_step_contradiction": 0.4}}, "delta_groundedness": 1}',
        "process", 0.4, 0.0, "",
    ),
    (
        '{"semantic_alignment": {"checks": {"semantic_output_coherent": true, "semantic_text_anchor_express_current_frames": "fail", "semantic_no_cross_step_contradiction": 1}}}',
        "process", 0.0, 0.0, "",
    ),
]


@query(f"""
SELECT event_id, round({_sql_cases('event_id', [c[2] for c in JUDGED], '::DOUBLE')}, 6) AS score, round({_sql_cases('event_id', [c[3] for c in JUDGED], '::DOUBLE')}, 6) AS first, {_sql_cases('event_id', [c[4] for c in JUDGED], '::VARCHAR')} AS issues FROM events
""")
def judge_scores(t: Tables) -> DataFrame:
    ship(t.spark)
    rows = t.events.select("event_id", _cases(F.col("event_id"), [c[0] for c in JUDGED]).alias("raw"), _cases(F.col("event_id"), [c[1] for c in JUDGED]).alias("form"))
    out = None
    for form, rules in J.FORMS.items():
        part = rows.where(F.col("form") == form).select("event_id", J.judged_scores(F.col("raw"), form).alias("j"))
        part = part.select(
            "event_id", F.round("j.score", 6).alias("score"), F.round(F.element_at("j.scores", F.lit(rules.scores[0])), 6).alias("first"),
            F.when(F.col("j.score").isNotNull(), F.array_join("j.issues", "|")).alias("issues"),
        )
        out = part if out is None else out.unionAll(part)
    return out


@query("""
SELECT p_partkey, p_size % 2 = 1 AND p_size % 3 = 0 AS asked, p_size % 2 = 0 OR (p_size % 3 = 0 AND p_size % 5 = 0) AS correct FROM part
""")
def judge_fallback(t: Tables) -> DataFrame:
    size, none = F.col("p_size"), F.array().cast("array<string>")
    options = F.when(size % 3 == 1, F.array(F.lit("x"))).otherwise(none)
    asked = J.needs_judge(size % 2 == 0, F.lit(True), F.when(size % 3 == 2, "A").otherwise(" "), options, F.col("p_name"), F.col("p_brand"))
    return t.part.select("p_partkey", asked.alias("asked"), J.with_fallback(size % 2 == 0, asked, size % 5 == 0).alias("correct"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '3,x' WHEN 3 THEN event_id::VARCHAR WHEN 4 THEN 'plain id' ELSE 'q' END AS ids, CASE event_id % 2 WHEN 0 THEN 2 ELSE 0 END::INTEGER AS objects FROM events
""")
def id_lists_and_objects(t: Tables) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 6 == 0, None).when(e % 6 == 1, "[]").when(e % 6 == 2, '[3, "x"]').when(e % 6 == 3, e.cast("string")).when(e % 6 == 4, "plain id").otherwise('"q"')
    rows = F.when(e % 2 == 0, '{"rows": [{"a": 1}, {"b": [2]}]}').otherwise('{"other": 1}')
    return t.events.select("event_id", F.array_join(J.id_list(text), ",").alias("ids"), F.size(J.json_objects(rows, "rows")).alias("objects"))


#: (answer, gold, whether they are the same).
MATH = [
    (r"\text{Evelyn}", r"\text{Evelyn}", True), (r"\text{Evelyn}", r"\text{Ann}", False), ("1,2", "12", False), ("1,234", "1234", True), ("12,34", "1234", False), (r"5\text{ cm}", "5", True), (r"\frac12", "0.5", True), ("x=3", "3", True),
    (r"2\sqrt{3}", r"\sqrt{12}", True), ("(x+1)^2", "x^2+2x+1", True), ("x+1", "x+2", False), (r"\frac{\pi}{2}", r"\pi/2", True), ("(1, 2)", "(1,2.0)", True), ("(1,2)", "[1,2]", False), ("(1,2)", "(2,1)", False), ("", "", False), (r"90^\circ", "90", True),
    (r"\{1,2\}", r"\{1,\frac{4}{2}\}", True), (r"\sin(x)^2+\cos(x)^2", "1", True), ("3x", "x*3", True), ("1/0", "2", False),
]


@query(f"""
SELECT p_partkey, {_sql_cases('p_partkey', [c[2] for c in MATH])} AS same FROM part
""")
def equal_mathematics(t: Tables) -> DataFrame:
    ship(t.spark)
    return t.part.select("p_partkey", X.math_equal(_cases(F.col("p_partkey"), [c[0] for c in MATH]), _cases(F.col("p_partkey"), [c[1] for c in MATH])).alias("same"))


#: (solution, gold, right, final form of the gold).
STATED = [
    ("so\nAnswer: 42", "42", True, "42"), ("Answer: 1\nAnswer: $x = 1,000$ dollars", "1000", True, "1000"), ("the answer is 3", "3", False, "3"),
    (r"Answer: \boxed{7}", "7 units", True, "7"), (r"answer: \frac12", r"\frac{1}{2}", True, r"\frac{1}{2}"),
    ("Answer: an apple", r"\text{apple}", True, "apple"), ("Answer: 5", "6", False, "6"),
]


@query(f"""
SELECT p_partkey, {_sql_cases('p_partkey', [c[2] for c in STATED])} AS correct, {_sql_cases('p_partkey', [c[3] for c in STATED])} AS final FROM part
""")
def stated_answers(t: Tables) -> DataFrame:
    ship(t.spark)
    text, gold = (_cases(F.col("p_partkey"), [c[i] for c in STATED]) for i in range(2))
    return t.part.select("p_partkey", X.stated_correct(text, gold).alias("correct"), X.final_form(gold).alias("final"))


#: (solution, content of the box, gold, right).
BOXES = [
    (r"so \boxed{\frac{1}{2}}.", r"\frac{1}{2}", "0.5", True), (r"\boxed{3} then \fbox{4}", "3", "3", True), (r"only \fbox{4}", "4", "5", False),
    ("none", None, "1", False), (r"\boxed 7$ end", "7", "7", True), (r"\boxed{1} and \boxed{2}", "2", "2", True), (r"\boxed{open", None, "open", False),
]


@query(f"""
SELECT p_partkey, {_sql_cases('p_partkey', [c[1] for c in BOXES], '::VARCHAR')} AS box, {_sql_cases('p_partkey', [c[3] for c in BOXES])} AS correct FROM part
""")
def boxed_answers(t: Tables) -> DataFrame:
    ship(t.spark)
    text, gold = _cases(F.col("p_partkey"), [c[0] for c in BOXES]), _cases(F.col("p_partkey"), [c[2] for c in BOXES])
    return t.part.select("p_partkey", judging.boxed_answer(text).alias("box"), X.boxed_correct(text, gold).alias("correct"))


#: (answer, gold, same): one for each rule.
OPEN = [
    ("A) The red car.", "the red car", True), ("I cannot answer that", "a red car", False), ("", "x", False), ("red car", "blue car", False), (
        "there is a red car on the road today", "a red car on the road", True,
    ),
    ("the man opens the big door", "the man opened the big door", True), ("two people sit at the table near a window", "two people sit near a window at the table", True),
    ("A vehicle is moving outside in the snow", "cars in motion outdoors, snowing", True), ("a dog runs over the green field", "the chef cuts onions in a kitchen", False), ("there is no clear evidence", "a red car stops", False), ("no clear evidence", "not enough information", False),
]


@query(f"""
SELECT p_partkey, {_sql_cases('p_partkey', [c[2] for c in OPEN])} AS same FROM part
""")
def open_answer_rules(t: Tables) -> DataFrame:
    ship(t.spark)
    return t.part.select("p_partkey", judging.open_answer(_cases(F.col("p_partkey"), [c[0] for c in OPEN]), _cases(F.col("p_partkey"), [c[1] for c in OPEN])).alias("same"))
