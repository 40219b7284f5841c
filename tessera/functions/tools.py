"""Tool calls as text and back, in several dialects; calls are arrays of struct(name, arguments as JSON)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once, stripped

# The marks and patterns of the dialects in this module.
CALLS = "array<struct<name:string,arguments:string>>"


@dataclass(frozen=True)
class Dialect:
    """written: calls to text; read: text to calls, null if it holds none or one that isn't JSON."""

    written: Callable[[Column], Column]
    read: Callable[[Column], Column]


DIALECTS: dict[str, Dialect] = {}


def _object(call: Column) -> Column:
    return F.concat(F.lit('{"name": "'), call["name"], F.lit('", "arguments": '), call["arguments"], F.lit("}"))


def _sound(calls: Column) -> Column:
    """The calls if there are some and all have a name and JSON arguments."""
    good = lambda c: c["name"].isNotNull() & (c["name"] != "") & F.coalesce(F.get_json_object(c["arguments"], "$").isNotNull(), F.lit(False))
    return once(calls, lambda c: F.when((F.size(c) > 0) & F.forall(c, good), c))


def _of_objects(texts: Column) -> Column:
    return _sound(F.transform(texts, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments"))))


def _actions(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)Action:\s*([a-zA-Z0-9_]+\s*Action Input:\s*.+?)(?=\s*Action:|\s*$)"), F.lit(1))
    return _sound(F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^([a-zA-Z0-9_]+)", 1).alias("name"), stripped(F.regexp_extract(x, r"(?s)Action Input:\s*(.+)$", 1)).alias("arguments"))))


DIALECTS["action"] = Dialect(lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("Action: "), x["name"], F.lit("\nAction Input: "), x["arguments"])), "\n"), _actions)
DIALECTS["tagged"] = Dialect(
    lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("<tool_call>\n"), _object(x), F.lit("\n</tool_call>"))), "\n"),
    lambda t: _of_objects(F.regexp_extract_all(t, F.lit(r"(?s)<tool_call>(.+?)</tool_call>(?=\s*<tool_call>|\s*$)"), F.lit(1))),
)
DIALECTS["listed"] = Dialect(
    lambda c: F.concat(F.lit("<tool_calls>\n"), F.array_join(F.transform(c, _object), "\n"), F.lit("\n</tool_calls>")),
    lambda t: _of_objects(F.filter(F.split(F.regexp_extract(t, r"(?s)<tool_calls>\s*(.+?)\s*</tool_calls>", 1), "\n"), lambda x: F.trim(x) != "")),
)
DIALECTS["array"] = Dialect(lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, _object), ", "), F.lit("]")), lambda t: _of_objects(F.from_json(t, "array<string>")))


# Fixed values below: the forms in which further models write calls.


def _named(name: str, arguments: str, sep: str = ", ") -> Callable[[Column], Column]:
    """A call as an object with its own names for the two parts."""
    return lambda c: F.concat(F.lit(f'{{"{name}": "'), c["name"], F.lit(f'"{sep}"{arguments}": '), c["arguments"], F.lit("}"))


def _objects_under(texts: Column, arguments: str) -> Column:
    return _sound(F.transform(texts, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, f"$.{arguments}").alias("arguments"))))


def _one_or_list(text: Column) -> Column:
    """JSON objects of a list, or the one object that the text is."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).when(F.ltrim(text).startswith("{"), F.array(text)).otherwise(F.array().cast("array<string>"))


def _pairs(arguments: Column) -> Column:
    """Names and values of an arguments object: texts without quotes, other values as JSON."""
    return F.map_entries(F.from_json(arguments, "map<string,string>"))


def _value(text: Column) -> Column:
    """A value as JSON: what is a number, list, object, true, false or null stays; other text gets quotes."""
    return once(text, _value_of)


def _value_of(text: Column) -> Column:
    plain = text.rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)$") | (
        text.rlike(r"(?s)^[\[{].*[\]}]$") & F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v").isNotNull(), F.lit(False))
    )
    return F.when(plain, text).otherwise(F.substring(F.to_json(F.struct(text.alias("v"))), 6, 1 << 30))


def _quoted(text: Column) -> Column:
    """The value's JSON without the brace that closes the object it was taken from."""
    return F.regexp_replace(_value(text), r"(?s)^(\".*\")\}$", "$1")


def _object_of(names: Column, values: Column) -> Column:
    pairs = F.zip_with(names, values, lambda k, v: F.concat(F.lit('"'), k, F.lit('": '), _quoted(v)))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _in_tags(block: str, pair: str, joined: str, whole: tuple[str, str, str], calls: str, head: str, key: str, value: str) -> Dialect:
    """Calls whose arguments are elements of their own. block, pair: forms with {name}, {pairs}, {key}, {value}; whole: before, between and after calls; the others: patterns that read them."""
    def put(form: str, **values: Column) -> Column:
        parts: list[Column] = []
        for k, v in values.items():
            before, form = form.split("{" + k + "}")
            parts += [F.lit(before), v]
        return F.concat(*parts, F.lit(form))

    def one(c: Column) -> Column:
        pairs = F.transform(_pairs(c["arguments"]), lambda e: put(pair, key=e["key"], value=e["value"]))
        return put(block, name=c["name"], pairs=F.array_join(pairs, joined))

    def read_one(x: Column) -> Column:
        names, values = (F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in (key, value))
        return F.struct(F.trim(F.regexp_extract(x, head, 1)).alias("name"), _object_of(names, values).alias("arguments"))

    return Dialect(
        lambda c: F.concat(F.lit(whole[0]), F.array_join(F.transform(c, one), whole[1]), F.lit(whole[2])),
        lambda t: _sound(F.transform(F.regexp_extract_all(t, F.lit(calls), F.lit(1)), read_one)),
    )


DIALECTS["parameters"] = Dialect(
    lambda c: F.when(F.size(c) > 1, F.concat(F.lit("["), F.array_join(F.transform(c, _named("name", "parameters")), ", "), F.lit("]"))).otherwise(_named("name", "parameters")(F.get(c, F.lit(0)))),
    lambda t: _objects_under(_one_or_list(t), "parameters"),
)
DIALECTS["two_lines"] = Dialect(
    lambda c: F.concat(F.get(c, F.lit(0))["name"], F.lit("\n"), F.get(c, F.lit(0))["arguments"]),
    lambda t: F.when(t.contains("\n"), _sound(F.array(F.struct(F.substring_index(t, "\n", 1).alias("name"), stripped(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("arguments"))))),
)
DIALECTS["function_tags"] = _in_tags(
    "<tool_call>\n<function={name}>\n{pairs}\n</function>\n</tool_call>", "<parameter={key}>\n{value}\n</parameter>", "\n", ("", "\n", ""),
    r"(?s)<tool_call>\s*<function=(.*?)</function>\s*</tool_call>", r"^([^>]+)>", r"(?s)<parameter=([^>]+)>", r"(?s)<parameter=[^>]+>\n?(.*?)\n?</parameter>",
)
DIALECTS["key_value_tags"] = _in_tags(
    "<tool_call>{name}\n{pairs}\n</tool_call>", "<arg_key>{key}</arg_key>\n<arg_value>{value}</arg_value>", "\n", ("", "\n", ""),
    r"(?s)<tool_call>(.*?)</tool_call>", r"^([^\n<]+)", r"(?s)<arg_key>(.*?)</arg_key>", r"(?s)<arg_value>(.*?)</arg_value>",
)
DIALECTS["invoke_tags"] = _in_tags(
    '<invoke name="{name}">\n{pairs}\n</invoke>', '<parameter name="{key}">{value}</parameter>', "\n", ("<minimax:tool_call>\n", "\n", "\n</minimax:tool_call>"),
    r"(?s)<invoke name=(.*?)</invoke>", r'^"([^"]+)"', r'(?s)<parameter name="([^"]+)">', r'(?s)<parameter name="[^"]+">(.*?)</parameter>',
)
DIALECTS["seed_tags"] = _in_tags(
    "<seed:tool_call>\n<function={name}>\n{pairs}\n</function>\n</seed:tool_call>", "<parameter={key}>{value}</parameter>", "\n", ("", "\n", ""),
    r"(?s)<seed:tool_call>\s*<function=(.*?)</function>\s*</seed:tool_call>", r"^([^>]+)>", r"(?s)<parameter=([^>]+)>", r"(?s)<parameter=[^>]+>(.*?)</parameter>",
)
DIALECTS["python_list"] = Dialect(
    lambda c: F.concat(
        F.lit("<|tool_call_start|>["),
        F.array_join(
            F.transform(
                c,
                lambda x: F.concat(
                    x["name"], F.lit("("),
                    F.array_join(F.transform(_pairs(x["arguments"]), lambda e: F.concat(e["key"], F.lit("="), _quoted(e["value"]))), ", "), F.lit(")"),
                ),
            ),
            ", ",
        ),
        F.lit("]<|tool_call_end|>"),
    ),
    lambda t: _sound(F.transform(F.regexp_extract_all(F.regexp_extract(t, r"(?s)<\|tool_call_start\|>\s*(\[.*?\])\s*<\|tool_call_end\|>", 1), F.lit(r"""(\w+\((?:[^()"]|"(?:[^"\\]|\\.)*")*\))"""), F.lit(1)), lambda x: F.struct(
        F.regexp_extract(x, r"^(\w+)\(", 1).alias("name"),
        F.concat(
            F.lit("{"),
            F.array_join(
                F.transform(
                    F.regexp_extract_all(x, F.lit(r"""((?<=[(,\s])\w+=(?:"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,)]+))"""), F.lit(1)),
                    lambda p: F.concat(F.lit('"'), F.substring_index(p, "=", 1), F.lit('": '), F.substring(p, F.locate("=", p) + 1, F.length(p))),
                ),
                ", ",
            ),
            F.lit("}"),
        ).alias("arguments"),
    ))),
)


def _marked(calls: Column) -> Column:
    text = lambda e: F.when(_value_of(e["value"]) == e["value"], e["value"]).otherwise(F.concat(F.lit('<|"|>'), e["value"], F.lit('<|"|>')))
    return F.array_join(
        F.transform(
            calls,
            lambda c: F.concat(
                F.lit("<|tool_call>call:"), c["name"], F.lit("{"),
                F.array_join(F.transform(_pairs(c["arguments"]), lambda e: F.concat(e["key"], F.lit(":"), text(e))), ","), F.lit("}<tool_call|>"),
            ),
        ),
        "",
    )


def _from_marked(text: Column) -> Column:
    """Texts between marks become JSON strings, bare keys get quotes."""
    def json(inside: Column) -> Column:
        strings = F.regexp_replace(inside, r'(?s)<\|"\|>(.*?)<\|"\|>', '"$1"')
        return F.concat(F.lit("{"), F.regexp_replace(strings, r'((?:^|,)\s*)([A-Za-z_]\w*)\s*:', '$1"$2": '), F.lit("}"))

    found = F.regexp_extract_all(text, F.lit(r"(?s)(<\|tool_call>call:[^{\s]+\{.*?\}<tool_call\|>)"), F.lit(1))
    return _sound(
        F.transform(
            found,
            lambda x: F.struct(
                F.regexp_extract(x, r"call:([^{\s]+)\{", 1).alias("name"),
                json(F.regexp_extract(x, r"(?s)call:[^{\s]+\{(.*)\}<tool_call\|>$", 1)).alias("arguments"),
            ),
        )
    )


DIALECTS["marked"] = Dialect(_marked, _from_marked)

#: Which dialect a family of models writes.
FAMILIES = {
    "default": "action", "gemma4": "marked", "glm4": "two_lines", "llama3": "parameters", "lfm2": "python_list", "minimax1": "listed", "minimax2": "invoke_tags", "mistral": "array", "qwen": "tagged", "qwen3_5": "function_tags", "glm4_moe": "key_value_tags",
    "seed_oss": "seed_tags", "ling": "tagged",
}


def register(family: str, dialect: Dialect) -> None:
    """A dialect of one's own for a family of models."""
    if family in FAMILIES or family in DIALECTS:
        raise ValueError(f"there is a dialect of {family}")
    DIALECTS[family] = dialect
    FAMILIES[family] = family


def written(calls: Column, dialect: str = "action") -> Column:
    return DIALECTS[dialect].written(calls)


def read(text: Column, dialect: str = "action") -> Column:
    return DIALECTS[dialect].read(text)


def format_reward(text: Column, wants_call: Column, wants_answer: Column) -> Column:
    """1 if the text is thinking and then exactly a tool call, an answer, or both, as wanted."""
    think, call, answer = r"<think>.*?</think>", r"<tool_call>\n.*?\n</tool_call>", r"<response>.*?</response>"
    whole = lambda *parts: text.rlike("(?s)^" + "\n".join(parts) + "$")
    once = lambda *tags: F.forall(F.array(*(F.size(F.split(text, t)) == 2 for t in tags)), lambda x: x)
    ok = F.when(wants_call & wants_answer, whole(think, call, answer) & once("<tool_call>", "</tool_call>", "<response>", "</response>")).when(wants_call, whole(think, call) & once("<tool_call>", "</tool_call>")).when(wants_answer, whole(think, answer) & once("<response>", "</response>")).otherwise(whole(think))
    return F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)
