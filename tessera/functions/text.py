"""Text normalisation, option handling and answer extraction as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
#: Edges of words of any script.
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it; for costly values, above all within lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    return F.regexp_replace(stripped(x), SPACES, " ")


def simple(x: Column) -> Column:
    """Lower case, white space collapsed."""
    return collapsed(F.lower(F.coalesce(x, F.lit(""))))


def option_text(x: Column) -> Column:
    """An option without its letter."""
    return collapsed(F.regexp_replace(simple(x), r"^[a-z]\.\s*", ""))


def answer_text(x: Column) -> Column:
    """An answer without option letter and closing points."""
    low = F.regexp_replace(simple(x), r"^(option\s*)?[a-z][).:]\s*", "")
    return F.regexp_replace(low, r"^[ .。]+|[ .。]+$", "")


def answer_plain(x: Column) -> Column:
    """Lower case, white space collapsed, without points and spaces at the ends."""
    return F.regexp_replace(simple(x), r"^[ .。]+|[ .。]+$", "")


def exact_match_text(x: Column) -> Column:
    """Lower case without punctuation and English articles."""
    bare = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return collapsed(F.regexp_replace(bare, LEFT + "(a|an|the)" + RIGHT, " "))


def words(x: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def option_letter(index: Column) -> Column:
    return F.char(F.lit(65) + index)


def letter_index(letter: Column, n: Column) -> Column:
    """0-based index of a letter, null beyond n options."""
    i = F.ascii(F.upper(F.trim(letter))) - 65
    return F.when((F.length(F.trim(letter)) == 1) & (i >= 0) & (i < n), i)


def labelled(options: Column) -> Column:
    """Options with their letters, those that have one kept."""
    return F.transform(options, lambda o, i: F.when(o.rlike(r"^[A-Z][.)]"), o).otherwise(F.concat(option_letter(i), F.lit(". "), o)))


def question_with_options(question: Column, options: Column) -> Column:
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\nOptions:\n"), F.array_join(labelled(options), "\n"))).otherwise(question)


def ground_truth_letter(gt: Column, options: Column) -> Column:
    """A letter from a letter, a 0-based index or an option's text; null if none fits."""
    n = F.size(options)
    index = F.trim(gt).try_cast("int")
    place = F.array_position(F.transform(options, option_text), option_text(gt)).cast("int") - 1
    found = F.coalesce(letter_index(F.regexp_extract(F.trim(gt), r"^([A-Za-z])(?:[.)].*)?$", 1), n), F.when((index >= 0) & (index < n), index), F.when(place >= 0, place))
    return option_letter(found)


def choice(x: Column, n: int = 4) -> Column:
    """The first letter of n options that stands alone, else the letter of the first number from 1 to n."""
    top = chr(64 + n)
    letter = F.regexp_extract(F.upper(F.coalesce(x, F.lit(""))), f"{LEFT}([A-{top}]){RIGHT}", 1)
    numbers = F.filter(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda d: d.try_cast("int")), lambda d: d.between(1, n))
    return F.when(letter != "", letter).otherwise(F.when(F.size(numbers) > 0, option_letter(F.get(numbers, F.lit(0)) - 1)))


def yes_no(x: Column) -> Column:
    """YES or NO if only one of them is said; null for both or neither."""
    said = F.array_distinct(F.transform(F.regexp_extract_all(F.upper(F.coalesce(x, F.lit(""))), F.lit(LEFT + "(YES|Y|NO|N)" + RIGHT), F.lit(1)), lambda w: F.substring(w, 1, 1)))
    return F.when(F.size(said) == 1, F.when(F.get(said, F.lit(0)) == "Y", "YES").otherwise("NO"))


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9]", "")


def last_answer_tag(x: Column) -> Column:
    """Content of the last <answer> element, null without one."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 0, stripped(F.element_at(found, -1)))


def hash_answer(x: Column, strict: bool = True) -> Column:
    """The number after the last #### (strict), or the last number, of the last 300 characters."""
    tail = F.substring(x, -300, 300)
    found = F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)" if strict else r"(-?[0-9.,]+)"), F.lit(1))
    found = found if strict else F.filter(found, lambda n: ~n.isin("", "."))
    return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), r"[,$]", ""))


def stable_hash(*parts: Column, size: int = 12) -> Column:
    """First hex digits of the SHA-1 of the parts joined by tabs; null: empty."""
    return F.substring(F.sha1(F.concat_ws("\t", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, size)


def preview(x: Column, size: int = 120) -> Column:
    flat = collapsed(x)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def natural_key(x: Column) -> Column:
    """Sort key in which numbers sort by value (up to 12 digits)."""
    padded = F.regexp_replace(x, r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})", "$1")


def interval(x: Column) -> Column:
    """struct(start, end) of "a-b" with a hyphen or an en dash; null unless start < end."""
    pattern = "^\\s*([0-9.]+)\\s*[-–]\\s*([0-9.]+)\\s*$"
    ends = lambda v: F.struct(*(F.regexp_extract(v, pattern, i).try_cast("double").alias(n) for i, n in ((1, "start"), (2, "end"))))
    return once(x, lambda v: once(ends(v), lambda i: F.when(i["start"] < i["end"], i)))


def filled(template: str, **values: Column) -> Column:
    """The template with the first {{name}} of each value replaced."""
    return reduce(lambda acc, kv: F.regexp_replace(acc, r"^(?s)(.*?)\{\{" + kv[0] + r"\}\}", F.concat(F.lit("$1"), F.regexp_replace(kv[1], r"([\\$])", r"\\$1"))), values.items(), F.lit(template))


def error_class(x: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The class of the first rule whose text the message holds."""
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.when(low == "", "none")
    for part, name in rules:
        out = out.when(low.contains(part), name)
    return out.otherwise(other)
