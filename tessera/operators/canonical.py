"""Rows of one canonical form from rows of several: columns that are there, aliases, nested events, legacy rows, answer variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.functions import text as T
from tessera.functions.prompts import with_updates

#: The two ways of answering.
ONCE, UPDATED = "answer_when_asked", "update_when_changed"
ANSWERS = "array<struct<time:double,gt:string,answer:string,content:string>>"


def projected(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of names that df has, in their order."""
    return df.select(*(F.col(f"`{n}`") for n in names if n in df.columns))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without nested parts."""
    return df.drop(*names)


def taken(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """df cut in two: the named columns, and the others."""
    return projected(df, names), df.drop(*names)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; a name that df lacks, or two columns of one name, raise an error."""
    missing = [k for k in names if k not in df.columns]
    out = [names.get(c, c) for c in df.columns]
    if missing or len(set(out)) < len(out):
        raise ValueError(f"can't rename: missing {missing}, columns {out}")
    return df.withColumnsRenamed(names)


def first_given(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first column of names that df has and that isn't null or blank."""
    values = [F.col(f"`{n}`").cast(kind) for n in names if n in df.columns]
    return F.coalesce(*(F.when(T.stripped(v.cast("string")) != "", v) for v in values)) if values else F.lit(None).cast(kind)


def _needed(value: Column, name: str) -> Column:
    return F.when(T.stripped(F.coalesce(value.cast("string"), F.lit(""))) != "", T.stripped(value.cast("string"))).otherwise(F.raise_error(f"{name} is missing"))


def whole_seconds(value: Column, name: str = "time") -> Column:
    """Half up to whole seconds; negative times fail the job."""
    return F.when(value < 0, F.raise_error(F.concat(F.lit(f"negative {name}: "), value.cast("string"))).cast("double")).otherwise(R.half_up(value).cast("double"))


def canonical_columns(df: DataFrame) -> list[Column]:
    """The eight canonical columns from rows under any of their aliases, with events() applied to query_events; missing texts fail the job."""
    video_id = _needed(first_given(df, ["video_id", "sample_id"]), "video_id")
    video = F.coalesce(first_given(df, ["video", "frames_dir"]), F.concat(F.lit("video/"), video_id))
    return [
        _needed(first_given(df, ["dataset"]), "dataset").alias("dataset"), video_id.alias("video_id"), video.alias("video"), F.coalesce(
            first_given(df, ["frames_dir", "video"]), video,
        ).alias("frames_dir"),
        F.coalesce(first_given(df, ["sample_fps", "fps"], "double"), F.lit(1.0)).alias("sample_fps"), whole_seconds(
            first_given(df, ["frame_count", "realtime", "duration"], "double"), "frame_count",
        ).cast("long").alias("frame_count"),
        F.coalesce(first_given(df, ["frame_id_base"], "long"), F.lit(0)).alias("frame_id_base"), events(F.col("query_events")).alias("query_events"),
    ]


def canonical(df: DataFrame) -> DataFrame:
    """Rows of canonical_columns()."""
    return df.select(*canonical_columns(df))


def events(queries: Column) -> Column:
    """Queries (qid, time, content, answer_policy, options, answer_events) in canonical form: their number as a name, whole seconds, the policy that their answers imply."""
    def one(q: Column, i: Column) -> Column:
        options = F.filter(F.transform(F.coalesce(q["options"], F.array().cast("array<string>")), T.stripped), lambda o: o != "")
        found = F.coalesce(q["answer_events"], F.array().cast(ANSWERS))
        policy = F.coalesce(F.when(T.stripped(q["answer_policy"]) != "", T.stripped(q["answer_policy"])), F.when(F.size(found) > 1, UPDATED).otherwise(ONCE))
        policy = F.when(policy.isin(ONCE, UPDATED), policy).otherwise(F.raise_error(F.concat(F.lit("unknown policy: "), policy)))
        content = _needed(q["content"], "content")
        kind = F.when(F.size(options) > 0, "mcq").otherwise("text")
        return F.struct(
            F.coalesce(q["qid"].cast("string"), F.concat(F.lit("q"), i.cast("string"))).alias("qid"), whole_seconds(F.coalesce(q["time"].cast("double"), F.lit(0.0))).alias("time"),
            F.when(policy == UPDATED, with_updates(content)).otherwise(content).alias("content"), kind.alias("answer_type"), policy.alias("answer_policy"),
            F.when(F.size(options) > 0, options).alias("options"), answers(found, kind == "mcq").alias("answer_events"),
        )

    return F.transform(queries, one)


def answers(found: Column, lettered: Column) -> Column:
    """Answers (time, gt, answer, content): whole seconds, gold letters where there are options, content from the answer if it has none."""
    filled = lambda x: F.when(T.stripped(x) != "", T.stripped(x))

    def one(a: Column) -> Column:
        gt = F.upper(T.stripped(F.coalesce(a["gt"].cast("string"), F.lit(""))))
        letter = F.when(lettered, F.when(gt.rlike(r"(?U)^\p{L}$"), gt).otherwise(F.raise_error(F.concat(F.lit("no gold letter: "), gt))))
        return F.struct(
            whole_seconds(F.coalesce(a["time"].cast("double"), F.lit(0.0))).alias("time"), letter.alias("gt"), filled(a["answer"]).alias("answer"),
            F.coalesce(filled(a["content"]), filled(a["answer"])).alias("content"),
        )

    return F.transform(found, one)


def from_flat(df: DataFrame, question: str, options: str, gold: str, frames: str) -> DataFrame:
    """Flat questions with options as rows of one query, asked and answered at the last frame (columns gt, answer, query_events added)."""
    letter = T.ground_truth_letter(F.col(gold).cast("string"), F.col(options))
    answer = F.get(F.col(options), F.ascii(letter) - 65)
    at = F.col(frames).cast("double")
    said = F.struct(at.alias("time"), letter.alias("gt"), answer.alias("answer"), F.concat(letter, F.lit(". "), answer).alias("content"))
    asked = F.struct(
        F.lit("q0").alias("qid"), at.alias("time"), T.question_with_options(F.col(question), F.col(options)).alias("content"),
        F.lit("mcq").alias("answer_type"), F.lit(ONCE).alias("answer_policy"), F.col(options).alias("options"), F.array(said).alias("answer_events"),
    )
    return df.where(F.col(frames) > 0).withColumn("query_events", F.array(asked))


def with_manifest(df: DataFrame, name: str, **values) -> DataFrame:
    """Adds what made the rows as a struct of constants."""
    return df.withColumn(name, F.struct(*(F.lit(v).alias(k) for k, v in values.items())))


def with_buckets(df: DataFrame, duration: str, bounds: list[float], rate: str) -> DataFrame:
    """Adds duration_bucket and difficulty."""
    from tessera.functions.scorers import difficulty

    return df.withColumns({"duration_bucket": R.duration_bucket(F.col(duration), bounds), "difficulty": difficulty(F.col(rate))})


def with_variants(df: DataFrame, target: str, variants: str, accepted: str = "accepted") -> DataFrame:
    """Each row, and one more for each accepted variant (structs with target and accepted) in its place; variant: its number, null for the row itself."""
    base = df.select(*(c for c in df.columns if c != variants), F.lit(None).cast("int").alias("variant"))
    more = df.select("*", F.posexplode(variants).alias("variant", "_v")).where(F.col(f"_v.{accepted}"))
    return base.unionByName(more.select(*(F.col(f"_v.{target}").alias(c) if c == target else F.col(c) for c in df.columns if c != variants), "variant"))


def rescued(df: DataFrame, target: str, variants: str, valid: str, reason: str, correct: str = "correct") -> DataFrame:
    """Failed rows whose steps are all valid and whose only fault is the answer: the first right variant becomes the target, the other right ones stay variants."""
    right = F.filter(F.col(variants), lambda v: v[correct])
    rows = df.where(F.col(valid) & (F.col(reason) == "answer_incorrect")).withColumn("_r", right).where(F.size("_r") > 0)
    return rows.withColumns({target: F.col("_r")[0][target], variants: F.slice("_r", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0)))}).drop("_r")


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts by column name; a column that a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def concatenated(parts: list[tuple[DataFrame, dict[str, object]]]) -> tuple[DataFrame, dict[str, object]]:
    """Batches of the same columns one after another, and what their notes say together; notes that contradict each other raise an error."""
    notes: dict[str, object] = {}
    for df, said in parts:
        if set(df.columns) != set(parts[0][0].columns):
            raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(parts[0][0].columns))}")
        for k, v in said.items():
            if notes.setdefault(k, v) != v:
                raise ValueError(f"batches say different things of {k}")
    return reduce(lambda a, b: a.unionByName(b), (df for df, _ in parts)), notes
