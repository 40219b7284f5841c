"""Chat examples: format converters, checks, rendering and row preparation for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}
MESSAGES = "array<struct<role:string,content:string>>"


def converter(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CONVERTERS[name] = f
        return f

    return add


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _none() -> Column:
    return F.array().cast(MESSAGES)


def _or_none(items: Column, ok: Column) -> Column:
    return F.when(ok, items).otherwise(_none())


@converter("alpaca")
def alpaca(df: DataFrame, instruction: str = "instruction", input_: str = "input", output: str = "output", history: str | None = None, system: str | None = None) -> DataFrame:
    """Instruction and input, joined by a line break, after the history's turns; the output is the response."""
    past = F.flatten(F.transform(history, lambda h: F.array(message("user", h[0]), message("assistant", h[1])))) if history else _none()
    asked = F.concat_ws("\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in (instruction, input_)))
    prompt = F.concat(F.coalesce(past, _none()), F.when(asked != "", F.array(message("user", asked))).otherwise(_none()))
    response = F.when(F.coalesce(output, F.lit("")) != "", F.array(message("assistant", F.col(output)))).otherwise(_none())
    return df.withColumns({"_prompt": prompt, "_response": response, "_system": F.coalesce(F.col(system), F.lit("")) if system else F.lit("")})


@converter("sharegpt")
def sharegpt(df: DataFrame, messages: str = "messages", user: str = "user", assistant: str = "assistant", system: str = "system") -> DataFrame:
    """Turns that alternate and end with an answer; a leading system turn is taken out; broken rows are empty, not dropped."""
    all_ = F.col(messages)
    led = F.coalesce(F.get(all_, F.lit(0))["role"] == system, F.lit(False))
    turns = F.when(led, F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(all_)
    ok = (F.size(turns) > 0) & (F.size(turns) % 2 == 0) & F.forall(F.transform(turns, lambda m, i: m["role"] == F.when(i % 2 == 0, user).otherwise(assistant)), lambda x: x)
    named = F.transform(turns, lambda m: message(F.when(m["role"] == user, "user").otherwise("assistant"), m["content"]))
    prompt, response = F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))), F.slice(named, F.greatest(F.size(named), F.lit(1)), 1)
    return df.withColumns({"_prompt": _or_none(prompt, ok), "_response": _or_none(response, ok), "_system": F.when(led, F.get(all_, F.lit(0))["content"]).otherwise("")})


@converter("pairs")
def pairs(df: DataFrame, messages: str = "messages", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """A ranked pair: the shared prompt and two answers."""
    return df.withColumns({"_prompt": F.col(messages), "_response": F.array(message("assistant", F.col(chosen)), message("assistant", F.col(rejected))), "_system": F.lit("")})


def _weighted(role: Column | str, content: Column, weight: float | Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), (F.lit(weight) if isinstance(weight, float) else weight).alias("loss_weight"))


@converter("weighted_alpaca")
def weighted_alpaca(df: DataFrame, instruction: str = "instruction", input_: str = "input", output: str = "output", system: str | None = None) -> DataFrame:
    """Messages with loss weights, of which only answers have some: instruction and input without anything between, the output; null parts are left out."""
    asked = F.when(F.col(instruction).isNotNull() | F.col(input_).isNotNull(), _weighted("user", F.concat(F.coalesce(instruction, F.lit("")), F.coalesce(input_, F.lit(""))), 0.0))
    said = F.when(F.col(output).isNotNull(), _weighted("assistant", F.col(output), 1.0))
    first = [F.when(F.col(system).isNotNull(), _weighted("system", F.col(system), 0.0))] if system else []
    return df.withColumn("messages", F.array_compact(F.array(*first, asked, said)))


@converter("weighted_sharegpt")
def weighted_sharegpt(df: DataFrame, turns: str = "conversations") -> DataFrame:
    """Turns (from, value) as messages with loss weights: answers and calls have some, unknown speakers are left out."""
    roles = {"system": "system", "human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}
    role = lambda m: F.coalesce(*(F.when(m["from"] == k, v) for k, v in roles.items()))
    return df.withColumn("messages", F.filter(F.transform(turns, lambda m: _weighted(role(m), m["value"], F.when(role(m) == "assistant", 1.0).otherwise(0.0))), lambda m: m["role"].isNotNull()))


@converter("openai")
def openai(df: DataFrame, messages: str = "messages", system: str = "", between: str = "\n</tool_response>\n<tool_response>\n") -> DataFrame:
    """Messages (role, content, tool_calls) with calls as function turns and neighbouring tool answers joined.

    User and tool turns must alternate with assistant and function turns and end with one of these; broken rows are empty.
    """
    all_ = F.col(messages)
    led = F.coalesce(F.get(all_, F.lit(0))["role"] == "system", F.lit(False))
    turns = F.when(led, F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))).otherwise(all_)
    plain = F.transform(
        turns,
        lambda m: F.when(
            (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0), message("function", F.to_json(m["tool_calls"])),
        ).otherwise(message(m["role"], F.coalesce(m["content"], F.lit("")))),
    )
    joined = F.transform(merged_tools(plain, between), lambda m: message(F.when(m["role"] == "tool", "observation").otherwise(m["role"]), m["content"]))
    ok = (F.size(joined) > 0) & (F.size(joined) % 2 == 0) & F.forall(
        F.transform(joined, lambda m, i: F.when(i % 2 == 0, m["role"].isin("user", "observation")).otherwise(m["role"].isin("assistant", "function"))),
        lambda x: x,
    )
    prompt, response = F.slice(joined, 1, F.greatest(F.size(joined) - 1, F.lit(0))), F.slice(joined, F.greatest(F.size(joined), F.lit(1)), 1)
    return df.withColumns({"_prompt": _or_none(prompt, ok), "_response": _or_none(response, ok), "_system": F.when(led, F.get(all_, F.lit(0))["content"]).otherwise(system)})


def merged_tools(messages: Column, between: str = "\n") -> Column:
    """Neighbouring tool turns as one, their contents joined."""
    def step(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (m["role"] == "tool") & (last["role"] == "tool")
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(message("tool", F.concat(last["content"], F.lit(between), m["content"]))))
        return F.when(same, joined).otherwise(F.concat(acc, F.array(message(m["role"], m["content"]))))

    return F.aggregate(messages, _none(), step)


def valid_examples(df: DataFrame) -> DataFrame:
    """Rows with an odd number of prompt turns and one response."""
    return df.where((F.size("_prompt") % 2 == 1) & (F.size("_response") == 1))


def chatml(messages: Column, open_answer: bool = False) -> Column:
    """Messages as text between turn marks."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if open_answer else body


def from_chatml(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)(<\|im_start\|>\w+\n.*?<\|im_end\|>)"), F.lit(1))
    return F.transform(found, lambda m: message(F.regexp_extract(m, r"^<\|im_start\|>(\w+)\n", 1), F.regexp_extract(m, r"(?s)^<\|im_start\|>\w+\n(.*)<\|im_end\|>$", 1)))


def masked_labels(source: Column, target: Column, most: int, ignore: int = -100) -> Column:
    """Labels of a prompt and an answer cut to `most` tokens in proportion, the prompt ignored; arrays of ids."""
    s, t = most_lengths(F.size(source), F.size(target), most)
    return F.concat(F.array_repeat(F.lit(ignore), s), F.slice(target, F.lit(1), t))


def most_lengths(source: Column, target: Column, most: int | Column) -> tuple[Column, Column]:
    """Tokens that prompt and answer keep: the shorter one is whole if it fits into half, else both shrink in proportion."""
    most = F.lit(most) if isinstance(most, int) else most
    room = F.when(target * 2 < most, most).when(source * 2 < most, most - source).otherwise((most * (target / (source + target))).cast("int"))
    t = F.least(room, target)
    return F.least(F.greatest(most - t, F.lit(0)), source), t


def mismatched_answers(df: DataFrame, order: list[str], answer: str, batch: Column) -> DataFrame:
    """Adds the previous row's answer of the batch, the first row taking the last one's."""
    w = Window.partitionBy(batch).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("mismatched", F.coalesce(F.lag(answer).over(w), F.last(answer).over(whole)))


def image_mismatches(df: DataFrame, messages: str, images: str, mark: str = "<image>") -> DataFrame:
    """Rows whose marks and images differ in number."""
    n = F.aggregate(messages, F.lit(0), lambda a, m: a + F.size(F.split(m["content"], mark)) - 1)
    return df.where(n != F.size(images))


def hard_reasons(text: Column, most_seconds: float = 20.0) -> Column:
    """Why a tagged answer is no good for training: no first anchor from 0, or a delta that lasts too long."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(r'<delta\s+t="([^"]+)">'), F.lit(1)), T.interval)
    long = F.exists(spans, lambda s: F.coalesce(s["end"] - s["start"] > most_seconds + 1e-9, F.lit(False)))
    first = T.interval(F.regexp_extract(text, r'<anchor\s+t="([^"]+)">', 1))
    starts = F.coalesce((F.abs(first["start"]) <= 1e-6) & (F.abs(first["end"] - 1) <= 1e-6), F.lit(False))
    return F.array_compact(F.array(F.when(long, "long_delta"), F.when(~starts, "first_anchor")))
