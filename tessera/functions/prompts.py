"""Questions as prompts and back: prefixes, options, texts for benchmark tasks, the gold option of a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import answer_plain, option_letter, stripped

# Texts that prompts must have word for word.
UPDATES = "Please answer the following question based on the video content. You may update your answer multiple times."
CUTS = ("\nOptions:", "\n\nUpdate your answer", "\nUpdate your answer")
SO_FAR, NO_QUESTION = "Based on the video so far, ", "Based on the video so far, answer the question."
CHOICE = """Question: {question}
Options:
{options}

Respond only with the letter corresponding to your chosen option.
Do not include any additional text or explanation in your response.
You must answer with one of the option letters.
"""
COUNTING = """You're watching a video in which people may perform a certain type of action repetitively.
The person performing this kind of action is referred to as "they" in the following statement.
Your task is to track the running total of how many times different people in the video have performed this kind of action in total.
One complete motion counts as one.
Target counting question: How many times did they {activity}?
Keep this target action in mind throughout the video.
Whenever the running total changes, answer with the updated total count as a single number (e.g., 0, 1, 2, 3...).
If the running total has not changed in the current frames, keep <answer></answer> empty and preserve useful counting evidence in Memory.
The final non-empty answer should be the total count up to the latest observed frame.
"""
STEP = """You're watching a tutorial video which contains a sequence of steps.
The following is one step from the whole procedure:
{step}
Decide whether the current visual content contains visual clues related to this step.
Answer only with "Yes" or "No".
Do not include any additional text or explanation in your response.
"""
CLUE = """You're responsible for answering questions based on the video content.
The following question is relevant to the latest frames, i.e. the end of the video.
{question}
Decide whether the existing visual content, especially the latest frames near the end of the video, contains visual clues related to the question.
Do not answer the question itself; only judge whether it is answerable.
Answer only with "Yes" or "No".
Do not include any additional text or explanation in your response.
"""


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def put_in(template: str, **values: Column) -> Column:
    """The template with each {name} replaced, in the order of values, which are taken literally."""
    parts: list[Column] = []
    for name, value in values.items():
        before, template = template.split("{" + name + "}")
        parts += [F.lit(before), _text(value)]
    return F.concat(*parts, F.lit(template))


def with_updates(content: Column) -> Column:
    """The content after the sentence that allows updates, which it gets once."""
    return F.when(content.startswith(UPDATES), content).otherwise(F.concat(F.lit(UPDATES + "\n\n"), content))


def question_only(content: Column) -> Column:
    """The question without that sentence, its options, and what asks for updates."""
    text = stripped(content)
    bare = F.when(text.startswith(UPDATES), stripped(F.substring(text, len(UPDATES) + 1, 1 << 30))).otherwise(text)
    return reduce(lambda x, cut: stripped(F.substring_index(x, cut, 1)), CUTS, bare)


def realtime_question(question: Column) -> Column:
    """The question as one on the video so far, its first letter small."""
    text = stripped(question)
    return F.when(text == "", NO_QUESTION).otherwise(F.concat(F.lit(SO_FAR), F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))


def options_line(options: Column) -> Column:
    """Options with letters in one line, each closed by a semicolon."""
    return F.concat(F.array_join(F.transform(options, lambda o, i: F.concat(option_letter(i), F.lit(". "), o)), "; "), F.lit(";"))


def choice_prompt(question: Column, options: Column) -> Column:
    return put_in(CHOICE, question=question, options=options_line(options))


def forward_prompt(task: Column, activity: Column, step: Column, question: Column) -> Column:
    """The prompt of a counting (REC), step (SSR) or clue (CRR) task; null for other tasks."""
    return F.when(task == "REC", put_in(COUNTING, activity=activity)).when(task == "SSR", put_in(STEP, step=step)).when(task == "CRR", put_in(CLUE, question=question))


def expected_option(gt: Column, options: Column, answer: Column, source_letter: Column) -> Column:
    """0-based index of the gold option, null if none fits: the source's letter, then the gold value as a letter, a number or an option's text.

    A number may count from 0 or from 1: where both fit, the one whose option is the answer, else the one from 0.
    """
    n, value = F.size(options), stripped(gt.cast("string"))
    letter = lambda x: F.when(F.upper(x).rlike("^[A-Z]$"), F.ascii(F.upper(x)) - 65)
    within = lambda i: F.when((i >= 0) & (i < n), i)
    plain = F.transform(options, answer_plain)
    number = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("int"))
    reads = F.array_compact(F.array(within(number), within(number - 1)))
    said = F.filter(reads, lambda i: (answer_plain(answer) != "") & (F.get(plain, i) == answer_plain(answer)))
    by_text = F.array_position(plain, answer_plain(value)).cast("int") - 1
    by_value = F.when(letter(value).isNotNull(), within(letter(value))).when(number.isNotNull(), F.coalesce(F.get(said, F.lit(0)), F.get(reads, F.lit(0)))).otherwise(F.when(by_text >= 0, by_text))
    return F.coalesce(within(letter(stripped(F.coalesce(source_letter, F.lit(""))))), by_value)
