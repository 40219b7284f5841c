"""Acceptance of generated questions and of trajectories: audits, first failing steps, required answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Least confidence of a leak through text, of visual support, of a leak through history, and of a guess from it.
TEXT_LEAK, SUPPORT, LANGUAGE_LEAK, GUESS = 0.50, 0.55, 0.55, 0.70
SUPPORTED = ("fully_supported", "partially_supported")


def sound_options(audit: Column) -> Column:
    flag = lambda n: F.coalesce(audit[n], F.lit(False))
    return flag("is_valid_mcq") & flag("has_single_correct_answer") & ~flag("has_option_bias") & flag("is_visual_question")


def _said(audit: Column, gt: Column, least: float) -> tuple[Column, Column]:
    hit = F.coalesce(T.choice(audit["choice"]) == gt, F.lit(False))
    return hit, F.coalesce(audit["confidence"], F.lit(0.0)) >= least


def leaked_by_text(audit: Column, gt: Column) -> Column:
    hit, sure = _said(audit, gt, TEXT_LEAK)
    return hit & (sure | F.coalesce(audit["support"].isin(*SUPPORTED), F.lit(False)))


def supported(audit: Column, gt: Column) -> Column:
    hit, sure = _said(audit, gt, SUPPORT)
    return hit & sure & F.coalesce(audit["support"].isin(*SUPPORTED), F.lit(False))


def leaked_by_history(audit: Column, gt: Column) -> Column:
    hit, likely = _said(audit, gt, LANGUAGE_LEAK)
    _, sure = _said(audit, gt, GUESS)
    early = F.coalesce(audit["is_answer_available_before_ask_time"], F.lit(False))
    return early | (hit & likely & (F.coalesce(audit["support"], F.lit("")) != "not_supported")) | (hit & sure)


def accepted_question(kind: Column, gt: Column, options: Column, text: Column, visual: Column, history: Column, in_time: Column) -> Column:
    """Whether a question passes the audits of its kind: realtime, forward or backward."""
    return F.when(~gt.isin("A", "B", "C", "D") | gt.isNull(), False).otherwise(
        sound_options(options) & F.coalesce(in_time, F.lit(False)) & F.when(kind == "realtime", ~leaked_by_text(text, gt) & supported(visual, gt)).when(
            kind == "forward", ~leaked_by_history(history, gt) & supported(visual, gt),
        ).when(kind == "backward", supported(history, gt)).otherwise(False)
    )


def kept_per_video(df: DataFrame, video: str, order: list, k: int) -> DataFrame:
    """The first k rows of each video."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(video).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def trajectories(steps: DataFrame, key: list[str], order: str, valid: str, reason: str, correct: str) -> DataFrame:
    """usable if all steps are valid and the answer is right; reason: the first failing step's, else answer_incorrect."""
    bad = ~F.coalesce(F.col(valid), F.lit(False))
    found = steps.groupBy(*key).agg(
        F.bool_and(F.coalesce(F.col(valid), F.lit(False))).alias("all_valid"), F.min_by(F.when(bad, F.col(reason)), F.when(bad, F.col(order))).alias("_why"),
        F.bool_or(F.coalesce(F.col(correct), F.lit(False))).alias("correct"), F.min(F.when(bad, F.col(order))).alias("failed_at"),
    )
    why = F.when(~F.col("all_valid"), F.coalesce("_why", F.lit("step_invalid"))).when(~F.col("correct"), "answer_incorrect")
    return found.select(*key, (F.col("all_valid") & F.col("correct")).alias("usable"), why.alias("reason"), "failed_at")


def branches(branches_: DataFrame, prefixes: DataFrame, key: list[str], valid: str, correct: str) -> DataFrame:
    """Right branches of samples whose prefix is valid."""
    return branches_.where(F.col(correct)).join(prefixes.where(F.col(valid)).select(*key), key, "left_semi")


def answer_duty(step_end: Column, asked: Column, due: Column, slack: float = 0.51) -> Column:
    """required at the step that holds the due time, forbidden before a question or the due time, optional after."""
    return F.when(asked.isNull(), "forbidden").when(F.abs(step_end - due) <= slack, "required").when(step_end < due - slack, "forbidden").otherwise("optional")


def answers_match(answers: Column, gold: Column) -> Column:
    """All given answers are right; none may be given where there is no gold answer."""
    said = F.filter(answers, lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    return F.when(F.coalesce(gold, F.lit("")) == "", F.size(said) == 0).otherwise((F.size(said) > 0) & F.forall(said, lambda a: T.answer_text(a) == T.answer_text(gold)))


def within_tokens(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most `most` tokens; a length that can't be told is too long."""
    return df.where(F.coalesce(length <= most, F.lit(False)))
