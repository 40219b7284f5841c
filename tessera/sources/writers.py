"""Sinks: JSON lines, one folder per split, summaries, exports; existing outputs are kept unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, mode: str = "errorifexists", one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", False).json(path)


def by_split(df: DataFrame, path: str, split: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(split).parquet(path)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def per_batch(path: str):
    """For foreachBatch: each micro-batch once, in a folder of its number, so that a repeated one replaces itself."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


def markdown(rows: DataFrame) -> str:
    """A small table, such as a summary, as text."""
    names = rows.columns
    body = ["| " + " | ".join("" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |" for r in rows.collect()]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body])


def training_rows(df: DataFrame, prompt: str, answer: str, source: str, ability: str, index: str, split: str) -> DataFrame:
    """Rows as trainers read them: data_source, prompt, ability, reward_model and extra_info."""
    return df.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col(answer).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"),
    )


def sharegpt_rows(df: DataFrame, prompt: str, answer: str, images: str, mark: str = "<image>") -> DataFrame:
    """Two messages and images; the job fails where marks and images differ in number."""
    n = F.size(F.split(prompt, mark)) - 1
    text = F.when(n == F.size(images), F.col(prompt)).otherwise(F.raise_error(F.concat(F.lit("image marks: "), n.cast("string"))))
    user, said = (F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("user", text), ("assistant", F.col(answer))))
    return df.select(F.array(user, said).alias("messages"), F.col(images).alias("images"))
