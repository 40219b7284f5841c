"""Structured Streaming forms of the window operators; each works on static tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_of(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, size: str, slide: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that a stream has now to Parquet, and ends."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key: a queue that drops its oldest rows when it is full."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def in_step(df: DataFrame, version: str, now: int, most: int) -> DataFrame:
    """Rows made at most `most` versions ago; older ones are stale."""
    return df.where(F.lit(now) - F.col(version) <= most)


def buffer_shuffled(df: DataFrame, order: list[str], size: int, seed: str) -> DataFrame:
    """Adds place: rows shuffled within buffers of `size` in order, as a stream's shuffle buffer does."""
    from tessera.operators.relational import with_position

    rows = with_position(df, order)
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("position").cast("string")))
    return rows.withColumn("place", F.struct(F.floor(F.col("position") / size).alias("buffer"), draw.alias("draw"))).drop("position")
