"""A training corpus from raw documents: five stages, each one operator of tessera.llm.

Rows are told apart by doc_id and text, so that ids may be null or repeat; other columns, whatever their names, pass
through. An empty table gives empty tables. Each stage first deletes the tables that the stage before it left, whose result
is stored by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard, language_id, sentencepiece_codec, substring_dedup
from tessera.llm.common import discard_later, row_of, sent_side, table, written

#: A document stays if one language has at least this mean marginal.
LEAST_SCORE = 0.4


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, own): the row number, and the whole row as a struct."""
    return docs.select(row_of(F.col("doc_id"), F.col("text")).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or in no one language, go. Repeated rows fare alike."""
    with discard_later(spark):
        found = language_id.predict(docs, language_id.train(docs.where(~language_id.held_out())))
        return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("rest.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (Jaccard of 5-word shingles of 0.8 or more), one document stays: that with the smallest doc_id, a null one last.

    Of different texts that share a doc_id, each belongs to its own group; of rows that are equal in both, one stays; all texts without words are one group.
    """
    with discard_later(spark):
        groups = jaccard.near_groups(docs)
        first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")).select("first.row")
        times = groups.groupBy("row").agg(F.count("*").alias("times"))
        kept = written(first.join(times, "row"), "kept")
        found = _numbered(docs).join(sent_side(kept), "row")
        return found.where("times = 1").select("own.*").unionAll(found.where("times > 1").dropDuplicates(["row"]).select("own.*"))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur elsewhere too go; other documents stay as they are (null and empty texts too), emptied ones go."""
    with discard_later(spark):
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]
        own = F.struct(F.col("text").isNull().alias("no_text"), F.col("n_chars").alias("n_chars"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
        found = substring_dedup.substring_dedup(docs.select("doc_id", "text", own.alias("own")), carry=("own",), whole=True).where("n_removed = 0 or kept <> ''")
        new = {"text": F.when(~F.col("own.own.no_text"), F.col("kept")), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("own.own.n_chars"))}
        return found.select(*(new.get(c, F.col(f"own.own.rest.`{c}`")).alias(c) for c in docs.columns))


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whatever their doc_id; null and empty texts hold none."""
    with discard_later(spark):
        per_doc, _ = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
        hit = written(per_doc.where("n_hit > 0").select("row").distinct(), "hit")
        return _numbered(docs).join(sent_side(hit), "row", "left_anti").select("own.*")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the text as it is decoded (null: empty), and n_tokens and ids of its pieces, which take the place of columns of these names."""
    with discard_later(spark):
        found = sentencepiece_codec.round_trip(docs, sentencepiece_codec.send(spark), carry=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids")))
        return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text", "own.*")


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", no_repeated_passages),
    ("benchmark_decontamination", no_benchmark_passages),
    ("sentencepiece", as_pieces),
]

#: SQL can't express the stages' models; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
