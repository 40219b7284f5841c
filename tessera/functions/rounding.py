"""Rounding rules and times; the three rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def truncated(x: Column) -> Column:
    return x.cast("long")


def to_fps(t: Column, fps: Column) -> Column:
    """The time on the frame grid; a rate of zero or less counts as one."""
    rate = F.when(fps > 0, fps).otherwise(F.lit(1.0))
    return F.floor(t * rate + 0.5) / rate


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def declared_seconds(frame_count: Column, fps: Column, realtime: Column, duration: Column) -> Column:
    return F.when((frame_count > 0) & (fps > 0), frame_count / fps).otherwise(F.coalesce(realtime, duration, F.lit(0.0)))


def declared_end(t: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(t - 1e-9))


def clock_seconds(text: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS; null if malformed."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(F.size(parts).between(1, 3), total)


def duration_bucket(x: Column, bounds: list[float]) -> Column:
    """Label of the first bound that isn't below x; beyond the last: >bound; null: unknown."""
    out, before = F.when(x.isNull(), "unknown"), 0.0
    for b in bounds:
        out = out.when(x <= b, f"{before:g}-{b:g}s")
        before = b
    return out.otherwise(f">{before:g}s")


def frame_of(t: Column, fps: float, base: int, first: Column, last: Column) -> Column:
    """Frame that is on at t, intervals open to the left: clamped to the frames there are."""
    ahead = F.greatest(F.lit(0), F.ceil((t - 1e-9) * fps).cast("long") - 1)
    return F.least(F.greatest(F.lit(base) + ahead, first), last)


def rate_key(x: Column) -> Column:
    return F.when(x.isNull(), "None").otherwise(F.format_string("%.4f", x))
