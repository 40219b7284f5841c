"""Annotated videos with nested query and answer events: normalising, filtering with reasons, nesting and flattening."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rounding as R
from tessera.functions import text as T


@dataclass(frozen=True)
class Limits:
    least_video: float = 20.0
    most_video: float = 110.0
    least_gap: float = 7.0
    most_tail: float = 1.0


def on_grid(events: Column, fps: Column) -> Column:
    """Query events with all times on the frame grid, answers sorted by time."""
    return F.transform(
        events,
        lambda q: q.withField("time", R.to_fps(q["time"], fps)).withField(
            "answer_events", F.array_sort(F.transform(q["answer_events"], lambda a: a.withField("time", R.to_fps(a["time"], fps))))
        ),
    )


def answer_times(events: Column) -> Column:
    return F.array_sort(F.flatten(F.transform(events, lambda q: F.transform(q["answer_events"], lambda a: a["time"]))))


def duplicate_options(events: Column) -> Column:
    return F.exists(events, lambda q: F.size(F.array_distinct(F.transform(q["options"], T.option_text))) < F.size(q["options"]))


def least_gap(events: Column) -> Column:
    """Least gap between neighbouring answers of one query; null if no query has two."""
    gaps = F.transform(
        events,
        lambda q: F.array_min(
            F.transform(
                F.slice(q["answer_events"], 2, F.greatest(F.lit(0), F.size(q["answer_events"]) - 1)),
                lambda a, i: a["time"] - F.get(q["answer_events"], i)["time"],
            )
        ),
    )
    return F.array_min(gaps)


def before_cutoff(events: Column, cutoff: Column) -> Column:
    """Answers up to the cutoff, and queries that keep one."""
    cut = F.transform(events, lambda q: q.withField("answer_events", F.filter(q["answer_events"], lambda a: a["time"] <= cutoff)))
    return F.filter(cut, lambda q: F.size(q["answer_events"]) > 0)


def first_failing_reason(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds reason (kept, or the first check that fails) and the pruned events.

    rows: fps, video_seconds and query_events (qid, time, options, answer_events(time, ...)). One pass without a shuffle.
    """
    L = limits
    kept = [c for c in rows.columns if c != "query_events"]
    df = rows.select(*kept, on_grid(F.col("query_events"), F.col("fps")).alias("query_events"))
    df = df.select(
        "*", answer_times(F.col("query_events")).alias("_times"), F.array_min(F.transform("query_events", lambda q: q["time"])).alias("_asked"),
        (F.col("video_seconds") > L.most_video).alias("_long"),
    )
    cutoff = F.when(F.col("_long"), L.most_video).otherwise(float("inf"))
    df = df.select("*", before_cutoff(F.col("query_events"), cutoff).alias("_left"))
    df = df.select("*", least_gap(F.col("_left")).alias("_gap"), F.array_max(answer_times(F.col("_left"))).alias("_last"))
    end = R.declared_end(F.col("_last"))
    reason = (
        F.when(F.coalesce(F.size("query_events"), F.lit(0)) <= 0, "missing_query_events")
        .when(duplicate_options(F.col("query_events")), "duplicate_options")
        .when(F.col("_asked").isNull(), "missing_query_time")
        .when(F.size("_times") == 0, "missing_answer_events")
        .when(F.col("video_seconds") < L.least_video, "original_video_too_short")
        .when(F.col("_long") & (F.col("_asked") > L.most_video), "query_after_max_cutoff")
        .when(F.col("_long") & (F.get("_times", F.lit(0)) > L.most_video), "first_answer_after_max_cutoff")
        .when(F.size("_left") == 0, "no_answers_before_cutoff")
        .when(F.col("_gap") < L.least_gap - 1e-6, "answer_gap_too_small")
        .when(end < L.least_video, "final_video_too_short")
        .when(end > L.most_video, "final_video_too_long")
        .when((end - F.col("_last") < 0) | (end - F.col("_last") > L.most_tail + 1e-6), "final_frame_not_aligned")
        .otherwise("kept")
    )
    return df.select(*kept, F.col("_left").alias("query_events"), reason.alias("reason"), end.alias("end_seconds"))


def all_failing_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds reasons: the names of all checks that are true."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))))


def flattened(parents: DataFrame, children: str, shared: list[str]) -> DataFrame:
    """One row for each child with its index; a child's value of a shared column comes before the parent's."""
    rows = parents.select(*[c for c in parents.columns if c != children], F.posexplode(children).alias("child_index", "_child"))
    fields = [f.name for f in parents.schema[children].dataType.elementType.fields]
    own = [F.coalesce(F.col(f"_child.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in shared]
    rest = [c for c in parents.columns if c != children and c not in shared]
    return rows.select(*rest, *own, "child_index", *(F.col(f"_child.{f}").alias(f) for f in fields if f not in shared))


def nested(rows: DataFrame, key: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """Children of each key as an ordered array of structs."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key; partial results are combined before the shuffle."""
    keys = [k if isinstance(k, Column) else F.col(k) for k in key]
    row = F.struct(*rows.columns)
    best = rows.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))).alias("_row"))
    return best.select("_row.*")


def yes_no_pairs(rows: DataFrame, low: float = 15.0, high: float = 30.0) -> DataFrame:
    """Two questions, No at the query time and Yes at the answer time, of rows whose gap lies within bounds."""
    ok = rows.where(F.col("gap").between(low, high))
    return ok.select("*", F.inline(F.array(F.struct(F.lit("No").alias("answer"), F.col("asked").alias("time")), F.struct(F.lit("Yes").alias("answer"), F.col("answered").alias("time")))))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n) of the rows that break each check; empty if all hold."""
    found = all_failing_reasons(df, checks)
    return found.select(F.explode("reasons").alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def unable_option(index: Column, n: Column, *key: Column) -> Column:
    """Another option than `index`, picked by a hash of the key; null for fewer than two options."""
    draw = F.conv(F.substring(F.sha1(F.concat_ws("\t", *key)), 1, 8), 16, 10).cast("long") % (n - 1)
    return F.when(n > 1, F.when(draw >= index, draw + 1).otherwise(draw))
