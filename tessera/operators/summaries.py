"""Summaries of datasets, stages and jobs. Counts by name come as (part, name, n) rows, so that no map grows on one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rounding import rate_key


def _counts(df: DataFrame, parts: dict[str, Column], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, part, name, n): how often each value of each part occurs; null counts as the text None."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.coalesce(v.cast("string"), F.lit("None")).alias("name")) for k, v in parts.items())))
    return df.select(*keys, pairs.alias("p")).groupBy(*keys, "p.part", "p.name").agg(F.count("*").alias("n"))


def of_sources(df: DataFrame, file: str, queries: str) -> tuple[DataFrame, DataFrame]:
    """Per file rows, query and answer events and scored ones; and counts of runs and of pass rates (four digits) over all answers."""
    found = F.flatten(F.transform(queries, lambda q: F.coalesce(q["answer_events"], F.expr("cast(array() as array<struct<eval_runs:int,eval_pass_rate:double>>)"))))
    rows = df.select(file, F.coalesce(F.size(queries), F.lit(0)).alias("_q"), F.coalesce(found, F.expr("cast(array() as array<struct<eval_runs:int,eval_pass_rate:double>>)")).alias("_a"))
    files = rows.groupBy(file).agg(
        F.count("*").alias("rows"), F.sum("_q").alias("query_events"), F.sum(F.size("_a")).alias("answer_events"),
        F.sum(F.size(F.filter("_a", lambda a: a["eval_runs"].isNotNull()))).alias("scored_answer_events"),
    )
    answers = rows.select(F.explode("_a").alias("a"))
    return files, _counts(answers, {"runs": F.col("a.eval_runs"), "pass_rate": rate_key(F.col("a.eval_pass_rate"))})


def of_splits(df: DataFrame, split: str, rate: str, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per split its rows and mean pass rate; and counts of buckets, difficulties, categories and tasks by split."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.avg(rate).alias("avg_pass_rate")), _counts(df, {p: F.col(p) for p in parts}, [split])


def of_targets(df: DataFrame, target: str, rate: str, difficulty: Column, source: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Per target of an allocation its rows and mean pass rate; and counts of difficulties, sources and reasons."""
    return df.groupBy(target).agg(F.count("*").alias("n"), F.avg(rate).alias("avg_pass_rate")), _counts(df, {"difficulty": difficulty, "source": F.col(source), "reason": F.col(reason)}, [target])


def of_stage(df: DataFrame, parts: list[str], nested: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and questions of a stage, which are rows or children of rows (their fields before the row's); and counts over questions."""
    rows = df.select("*", F.explode(nested).alias("_c")) if nested else df
    inner = {f.name for f in df.schema[nested].dataType.elementType.fields} if nested else set()
    of = lambda p: F.col(f"_c.{p}") if p in inner else F.col(p)
    total = df.agg(F.count("*").alias("rows"), F.sum(F.greatest(F.size(nested), F.lit(0)) if nested else F.lit(1)).alias("questions"))
    return total, _counts(rows, {p: of(p) for p in parts})


def of_videos(df: DataFrame, names: list[str], errors: str) -> DataFrame:
    """Videos, and for each count the videos that have some and their sum; videos with errors."""
    each = [x for c in names for x in (F.count_if(F.col(c) > 0).alias(f"videos_with_{c}"), F.sum(c).alias(f"total_{c}"))]
    return df.agg(F.count("*").alias("videos"), *each, F.count_if(F.col(errors) > 0).alias("error_videos"))


def of_grouped_rows(df: DataFrame, dataset: str, queries: str) -> tuple[DataFrame, DataFrame]:
    """Rows, events, rows with several; and counts of datasets, answer types of queries and of answers, and pass rates."""
    answers = F.aggregate(queries, F.lit(0), lambda a, q: a + F.greatest(F.size(q["answer_events"]), F.lit(0)))
    total = df.agg(
        F.count("*").alias("rows"), F.sum(F.size(queries)).alias("query_events"), F.sum(answers).alias("answer_events"),
        F.count_if(F.size(queries) > 1).alias("rows_with_multiple_queries"), F.count_if(answers > 1).alias("rows_with_multiple_answers"),
    )
    asked = df.select(F.explode(queries).alias("q"))
    said = asked.select(F.col("q.answer_type").alias("kind"), F.explode("q.answer_events").alias("a"))
    return total, reduce(
        DataFrame.unionAll,
        [
            _counts(df, {"dataset": F.col(dataset)}), _counts(asked, {"query_answer_type": F.col("q.answer_type")}),
            _counts(said, {"answer_type": F.col("kind"), "pass_rate": rate_key(F.col("a.eval_pass_rate"))}),
        ],
    )


def of_pairs(df: DataFrame, pair: str, answer: str, frames: str, excluded: int, candidates: int) -> DataFrame:
    """Pairs of a No and a Yes row: rows, answers, least and greatest frames, and gaps between the two of a pair."""
    gaps = df.groupBy(pair).agg(
        (F.max(frames) - F.min(frames)).alias("gap"), F.count("*").alias("n"), F.count_if(F.col(answer) == "Yes").alias("yes"),
        F.count_if(F.col(answer) == "No").alias("no"), F.min(frames).alias("lo"), F.max(frames).alias("hi"),
    )
    return gaps.agg(
        F.count("*").alias("pairs"), F.sum("n").alias("rows"), F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.min("lo").alias("frame_count_min"), F.max("hi").alias("frame_count_max"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"),
    ).withColumns({"excluded": F.lit(excluded), "available_candidates": F.lit(candidates)})


def of_jobs(jobs: DataFrame, status: str, usable: str, attempted: str, exported: str, variants: str) -> DataFrame:
    """Finished jobs: accepted, failed and broken samples, steps tried and exported, and rows that variants rescued. Jobs without a record (usable null) count as samples only."""
    done, ok = F.col(usable).isNotNull(), F.col(usable)
    return jobs.agg(
        F.count("*").alias("samples"), F.count_if(done & ok).alias("accepted"), F.count_if(done & ~ok & (F.col(status) == "error")).alias("errors"), F.count_if(
            done & ~ok & F.coalesce(F.col(status) != "error", F.lit(True))
        ).alias("failed"),
        F.coalesce(F.sum(F.when(done, F.col(attempted))), F.lit(0)).alias("attempted_steps"), F.coalesce(F.sum(F.when(done, F.col(exported))), F.lit(0)).alias("exported_steps"), F.count_if(done & (F.col(variants) > 0)).alias("rescued"),
    )


def by_status(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs by status, and all of them (status null)."""
    return jobs.rollup(status).agg(F.count("*").alias("n"))


def of_keyframes(df: DataFrame, frames: str, kept: str) -> DataFrame:
    """Before and after thinning: rows, rows changed, keyframes, rows with adjacent ones."""
    adjacent = lambda c: F.exists(
        F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: b - a),
        lambda d: d <= 1,
    )
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.size(frames) != F.size(kept)).alias("rows_changed"), F.sum(F.size(frames)).alias("keyframes_before"), F.sum(F.size(kept)).alias("keyframes_after"),
        F.count_if(adjacent(frames)).alias("adjacent_before"), F.count_if(adjacent(kept)).alias("adjacent_after"),
    )


def examples(df: DataFrame, reason: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each reason."""
    w = Window.partitionBy(reason).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def enough(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """Rows whose values reach all thresholds; null counts as zero."""
    return df.where(reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit(0.0)) >= v for c, v in least.items()), F.lit(True)))


def with_questions(df: DataFrame, question: str) -> DataFrame:
    """Rows with a question that isn't blank."""
    return df.where(F.trim(F.coalesce(question, F.lit(""))) != "")


def by_priority(df: DataFrame, kind: str, order: dict[str, int], then: list[str], unknown: int = 99) -> DataFrame:
    """Rows sorted by the rank of their kind, then by columns."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col(kind)), F.lit(unknown))
    return df.withColumn("rank", rank).orderBy("rank", *then)


def cleaned_facts(df: DataFrame, facts: str, keyframes: str, frames: str) -> Column:
    """Facts (fact, answer, category, source_keyframe_id, evidence_frame_ids) that have a text and evidence among the frames, with the evidence sorted.

    A fact whose keyframe isn't allowed takes the only one, or the one nearest to the evidence's middle (the earlier of two); without any it goes.
    """
    def one(f: Column, i: Column) -> Column:
        evidence = F.array_sort(F.array_intersect(F.coalesce(f["evidence_frame_ids"], F.array().cast("array<int>")), F.col(frames)))
        middle = F.aggregate(evidence, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(evidence), F.lit(1))
        near = F.array_sort(F.transform(keyframes, lambda k: F.struct(F.abs(k - middle).alias("d"), k.alias("k"))))
        source = F.when(F.array_contains(keyframes, f["source_keyframe_id"]), f["source_keyframe_id"]).otherwise(F.get(near, F.lit(0))["k"])
        text = lambda c, other="": F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(other))
        return F.struct(
            i.alias("place"), source.alias("source_keyframe_id"), text(f["fact"]).alias("fact"), text(f["answer"]).alias("answer"),
            text(f["category"], "other").alias("category"), evidence.alias("evidence_frame_ids"),
        )

    return F.filter(F.transform(facts, one), lambda f: (f["fact"] != "") & (F.size(f["evidence_frame_ids"]) > 0) & f["source_keyframe_id"].isNotNull())
