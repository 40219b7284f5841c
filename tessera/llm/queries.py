"""The operators of this package as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    decontamination, html_extraction, language_id, lexical_search, license_scan, lm_scoring, sentencepiece_codec, simhash, substring_dedup, suffix_dedup, token_alignment, topk, url_filter,
)
from tessera.llm.common import table
from tessera.llm.oracle import ORACLE_SQL


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = sentencepiece_codec.MODEL) -> DataFrame:
    return sentencepiece_codec.digest(sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), sentencepiece_codec.send(spark, model)))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.digest(html_extraction.main_text(table(spark, sf_dir, "pages")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), ~lm_scoring.held_out())


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(simhash.fingerprints(table(spark, sf_dir, "documents"))))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(*decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model, carry=False)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str, a_file: str = token_alignment.A_FILE, b_file: str = token_alignment.B_FILE) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), token_alignment.send(spark, a_file, b_file))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its number says so: toxic, or of low quality."""
    rules = url_filter.rules_table(spark, url_filter.RULES)
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), rules, bad=bad)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_dedup, op2_sentencepiece, op3_html_extraction, op4_lm_scoring, op5_exact_top_k, op6_license_scan, op7_simhash, op8_decontamination,
        op9_substring_dedup, op10_language_id, op11_token_alignment, op12_lexical_search, op13_url_filter,
    )
}
ORACLES: dict[str, str] = {k: v for k, v in ORACLE_SQL.items() if k in QUERIES}
