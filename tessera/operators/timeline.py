"""Lookups between events, steps and windows of a video, and scores written back into nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def neighbours(times: Column, at: Column) -> Column:
    """struct(previous, next) of the times strictly before and after."""
    return F.struct(F.array_max(F.filter(times, lambda x: x < at)).alias("previous"), F.array_min(F.filter(times, lambda x: x > at)).alias("next"))


def step_at(steps: DataFrame, events: DataFrame, key: list[str], time: str, start: str = "step_start", end: str = "step_end", index: str = "step_index") -> DataFrame:
    """Each event with the step that holds it (start < t <= end), else the first that ends later, else the last.

    Steps of one key become one array (a video's length bounds it), searched without a join of all pairs.
    """
    lists = steps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(start).alias("a"), F.col(end).alias("b")))).alias("_steps"))
    rows = events.join(lists, key, "left")
    t = F.col(time)
    inside = F.get(F.filter("_steps", lambda s: (s["a"] < t) & (t <= s["b"])), F.lit(0))["i"]
    later = F.get(F.filter("_steps", lambda s: s["b"] >= t), F.lit(0))["i"]
    return rows.withColumn(index, F.coalesce(inside, later, F.element_at("_steps", -1)["i"])).drop("_steps")


def before(windows: Column, t: Column) -> Column:
    """Windows that end by t."""
    return F.filter(windows, lambda w: w["end"] <= t)


def holding(windows: Column, frame: Column) -> Column:
    """The first window that lists the frame."""
    return F.get(F.filter(windows, lambda w: F.array_contains(w["frames"], frame)), F.lit(0))


def history_frames(evidence: Column, seen: Column, most: int) -> Column:
    """Evidence, then the latest others, up to `most`, in order."""
    rest = F.array_except(seen, evidence)
    room = F.greatest(F.lit(most) - F.size(evidence), F.lit(0))
    latest = F.slice(rest, F.greatest(F.size(rest) - room + 1, F.lit(1)), room)
    return F.array_sort(F.array_union(F.slice(evidence, 1, most), latest))


def around(evidence: Column, t: Column, first: Column, last: Column, reach: int = 2) -> Column:
    """Evidence, or else the frames around t, within bounds."""
    near = F.sequence(F.greatest(t - reach, first), F.greatest(F.least(t + reach, last), F.greatest(t - reach, first)))
    return F.when(F.size(evidence) > 0, F.array_sort(F.array_distinct(evidence))).otherwise(near)


def complement(intervals: Column, start: Column, end: Column, slack: float = 1e-6) -> Column:
    """What sorted, disjoint intervals leave of [start, end]: the gaps between each and the one before, and at both ends."""
    a, b = start.cast("double"), end.cast("double")
    begins = F.concat(F.transform(intervals, lambda x: x["start"].cast("double")), F.array(b))
    ends = F.concat(F.array(a), F.transform(intervals, lambda x: x["end"].cast("double")))
    return F.filter(F.zip_with(ends, begins, lambda x, y: F.struct(x.alias("start"), y.alias("end"))), lambda g: g["end"] > g["start"] + slack)


def within(t: Column, start: Column, end: Column, slack: float) -> Column:
    """Whether [t - slack, t + slack] meets [start, end]."""
    return (t + slack >= start) & (t - slack <= end)


def first_answer_in_time(steps: DataFrame, key: list[str], order: str, answer: str, start: str, end: str, due: str, slack: float = 2.0) -> DataFrame:
    """The first non-empty answer of each key, and whether its step meets the time it is due."""
    said = F.trim(F.coalesce(answer, F.lit(""))) != ""
    row = F.struct(F.col(answer).alias("answer"), F.col(start).alias("a"), F.col(end).alias("b"), F.col(due).alias("due"))
    first = steps.groupBy(*key).agg(F.min_by(F.when(said, row), F.when(said, F.col(order))).alias("_f"))
    hit = F.coalesce(within(F.col("_f.due"), F.col("_f.a"), F.col("_f.b"), slack), F.lit(False))
    return first.select(*key, F.col("_f.answer").alias("answer"), hit.alias("in_time"))


def item_kind(df: DataFrame, names: list[str]) -> StructType:
    return StructType([df.schema[n] for n in names])


def scores_written_back(rows: DataFrame, key: list[str], children: str, scores: DataFrame, index: str, values: list[str]) -> DataFrame:
    """Children of each row with the values of scores (key, index, values...), null where there is none."""
    fields = [f.name for f in rows.schema[children].dataType.elementType.fields]
    item = F.struct(F.col(index).cast("int").alias("i"), F.struct(*values).alias("v"))
    lists = scores.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    # scores by place: places without one are filled, so that each child finds its own at once
    most, at = F.element_at("_l", -1)["i"], F.transform("_l", lambda x: x["i"])
    lists = lists.withColumn("_l", F.when(F.size(F.array_distinct(at)) == F.size(at), F.col("_l")).otherwise(F.raise_error(F.lit("two scores for one child"))))
    gaps = F.transform(F.array_except(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), at), lambda i: F.struct(i.alias("i"), F.lit(None).cast(item_kind(scores, values)).alias("v")))
    lists = lists.withColumn("_s", F.transform(F.filter(F.array_sort(F.concat("_l", gaps)), lambda x: x["i"] >= 0), lambda x: x["v"])).drop("_l")
    joined = rows.join(lists, key, "left")
    new = F.transform(
        children,
        lambda c, i: F.struct(
            *(c[f].alias(f) for f in fields if f not in values),
            *(F.when(F.col("_s").isNotNull(), F.get("_s", i)[v]).alias(v) for v in values),
        ),
    )
    return joined.withColumn(children, new).drop("_s")


def until_target(frames: DataFrame, video: str, frame: str, targets: DataFrame, target: str, fps: float, base: int) -> DataFrame:
    """Frames up to the one that is on at the video's target time; times beyond the frames are clamped, videos without a target keep all."""
    from tessera.functions.rounding import frame_of

    ends = frames.groupBy(video).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi")).join(targets.select(video, F.col(target).alias("_t")), video, "left")
    last = ends.select(video, F.when(F.col("_t").isNull(), F.col("_hi")).otherwise(frame_of(F.col("_t"), fps, base, F.col("_lo"), F.col("_hi"))).alias("_last"))
    return frames.join(last, video).where(F.col(frame) <= F.col("_last")).drop("_last")


def from_start(frames: DataFrame, end: str, start: Column) -> DataFrame:
    """Frames that end after the start; no start keeps all."""
    return frames.where(start.isNull() | (F.col(end) > start))


def with_frames(df: DataFrame, key: list[str], listing: DataFrame) -> DataFrame:
    """Rows whose frames exist, by a listing of what there is."""
    return df.join(listing.select(*key).distinct(), key, "left_semi")
