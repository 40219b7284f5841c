"""Scoring rules of video benchmarks, and the result row of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.prompts import expected_option

# Tasks by category.
CATEGORIES = {"backward": ("EPM", "ASI", "HLD"), "realtime": ("OCR", "ACR", "ATR", "STU", "FPD", "OJR"), "forward": ("REC", "SSR", "CRR")}


def category(task: Column) -> Column:
    """The task's category, null for an unknown task."""
    out = None
    for name, tasks in CATEGORIES.items():
        out = F.when(task.isin(*tasks), name) if out is None else out.when(task.isin(*tasks), name)
    return out


def choice_of(answer: Column, n: Column) -> Column:
    """The first of n letters that stands alone, else the letter of the first whole number from 1 to n; null without either."""
    said = F.filter(F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit(T.LEFT + "([A-Z])" + T.RIGHT), F.lit(1)), lambda x: F.ascii(x) - 65 < n)
    numbers = F.filter(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(T.LEFT + r"(\d+)" + T.RIGHT), F.lit(1)), lambda d: d.try_cast("int")), lambda d: d.between(1, n))
    return F.coalesce(F.get(said, F.lit(0)), T.option_letter(F.get(numbers, F.lit(0)) - 1))


def leading_yes_no(answer: Column) -> Column:
    """yes or no if the text begins with it, white space counting; else empty."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no").otherwise("")


def first_yes_no(answer: Column) -> Column:
    """The first yes or no that stands alone; else empty."""
    return F.regexp_extract(F.lower(F.coalesce(answer, F.lit(""))), T.LEFT + "(yes|no)" + T.RIGHT, 1)


def says(answer: Column, gold: Column) -> Column:
    """1 if the gold yes or no stands anywhere in the text."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    hit = F.when(gold == "yes", low.rlike(T.LEFT + "yes" + T.RIGHT)).when(gold == "no", low.rlike(T.LEFT + "no" + T.RIGHT))
    return F.coalesce(hit, F.lit(False)).cast("int")


def first_answer_tag(text: Column) -> Column:
    """Content of the first <answer> element, empty without one."""
    return T.stripped(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)<answer>(.*?)</answer>", 1))


def task_score(task: Column, answer: Column, gold: Column) -> Column:
    """1 or 0 by the rule of the task's kind: a letter of five, all digits as one number, or yes (1) and no (0)."""
    value = T.stripped(gold.cast("string"))
    polarity = F.when(T.yes_no(answer) == "YES", 1).when(T.yes_no(answer) == "NO", 0)
    hit = F.when(
        category(task).isin("backward", "realtime"), choice_of(answer, F.lit(5)) == F.upper(value),
    ).when(task == "REC", (T.digits(answer) != "") & (T.digits(answer) == value)).when(task.isin("SSR", "CRR"), polarity == value.try_cast("int"))
    return F.when(category(task).isNotNull(), F.coalesce(hit, F.lit(False)).cast("int"))


def scored_runs(df: DataFrame, kind: str) -> DataFrame:
    """Adds prediction, ground_truth and score to runs, by the benchmark's rule.

    tasks: columns task, response, gold; options: response, gold, options, answer, source_letter (score null without options or a gold
    one); opens_with and mentions: response, raw, gold (the raw output counts where nothing was answered); letters: response, gold, options.
    """
    said = F.coalesce(F.col("response"), F.lit(""))
    text = F.when(said != "", said).otherwise(F.coalesce(F.col("raw"), F.lit(""))) if kind in ("opens_with", "mentions") else said
    if kind == "tasks":
        truth, pred, score = F.col("gold").cast("string"), said, task_score(F.col("task"), said, F.col("gold"))
    elif kind == "options":
        truth = T.option_letter(expected_option(F.col("gold"), F.col("options"), F.col("answer"), F.col("source_letter")))
        known = truth.isNotNull() & (F.size("options") > 0)
        pred = F.when(known, choice_of(said, F.size("options")))
        score = F.when(known, F.coalesce(pred == truth, F.lit(False)).cast("int"))
    elif kind == "letters":
        n = F.when(F.size("options") > 0, F.size("options")).otherwise(5)
        truth, pred = choice_of(F.col("gold"), n), choice_of(said, n)
        score = F.coalesce(pred == truth, F.lit(False)).cast("int")
    else:
        truth = F.lower(T.stripped(F.coalesce(F.col("gold"), F.lit(""))))
        pred = leading_yes_no(text) if kind == "opens_with" else first_yes_no(text)
        score = ((pred != "") & (pred == truth)).cast("int") if kind == "opens_with" else says(text, truth)
    return df.withColumns({"prediction": pred, "ground_truth": truth, "score": score})
