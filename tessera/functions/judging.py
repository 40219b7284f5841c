"""Judging free text: open answers, boxed mathematics, JSON in prose, tool calls. Arrow UDFs over plain functions."""

from __future__ import annotations

import json
import re
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

# How alike two open answers must be (letters; words; words of content, with letters; the gold answer's key words), and least numbers of words.
ALIKE_LETTERS, ALIKE_WORDS, ALIKE_CONTENT, ALIKE_CONTENT_LETTERS, COVERED = 0.82, 0.72, 0.62, 0.45, 0.55
LEAST_WORDS, LEAST_KEY_WORDS = 3, 3
# Words without content, phrases that refuse, and words that count as one.
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on or that the to with".split())
REFUSALS = ("can't answer", "cannot answer", "can not answer", "unable to answer", "not enough information", "insufficient information", "i don't know", "i do not know")
NOTHING_SEEN = re.compile(r"\bno\s+[^.]{0,40}\b(?:video|frame|scene|mural|evidence|information)\b")
SAME_WORD = {
    "cold": ("cold", "cool", "winter", "wintery"),
    "color": ("colorful", "colourful", "vibrant"),
    "indoor": ("indoor", "indoors", "inside"),
    "light": ("illuminated", "illumination", "lit"),
    "motion": ("change", "changes", "dynamic", "motion", "movement", "moving", "shaky", "shift", "shifts", "transition", "transitions"),
    "outdoor": ("outdoor", "outdoors", "outside"),
    "static": ("static", "stationary"),
    "vehicle": ("car", "cars", "vehicle", "vehicles"),
}
SAME_STEM = ("blur", "dark", "night", "snow")
SAME_PART = ("light",)
ENDINGS = ("ing", "ed", "es", "s", "ness", "ly")

_GROUP_OF = {word: group for group, words in SAME_WORD.items() for word in words}


def normal(text: str | None) -> str:
    low = re.sub(r"^(?:option\s*)?[a-z][).:]\s*", "", str(text or "").strip().lower())
    return re.sub(r"\s+", " ", low).strip(" .。")


def key_word(word: str) -> str:
    """What a word counts as: its group, or its stem of more than three letters; '' if it has no Latin letter or digit."""
    bare = re.sub(r"[^a-z0-9]+", "", word)
    named = {_GROUP_OF.get(bare), *(g for g in SAME_STEM if bare.startswith(g)), *(g for g in SAME_PART if g in bare)} - {None}
    if named:
        return "light" if "light" in named else min(named)
    ending = next((e for e in ENDINGS if bare.endswith(e) and len(bare) > len(e) + 3), "")
    return bare.removesuffix(ending)


def overlap_f1(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0


class Likeness(NamedTuple):
    """What two open answers have in common; fields are values, or columns of the same names."""

    answers: bool | Column  # both say something, and the first is no refusal unless the second is
    equal: bool | Column
    comparable: bool | Column  # neither is shorter than LEAST_WORDS
    contained: bool | Column
    letters: float | Column
    words: float | Column
    content: float | Column
    covered: float | Column

    def same(self) -> bool | Column:
        near = self.contained | (self.letters >= ALIKE_LETTERS) | (self.words >= ALIKE_WORDS) | (self.covered >= COVERED) | ((self.content >= ALIKE_CONTENT) & (self.letters >= ALIKE_CONTENT_LETTERS))
        return self.answers & (self.equal | (self.comparable & near))


LIKENESS = "answers boolean, equal boolean, comparable boolean, contained boolean, letters double, words double, content double, covered double"


def _refuses(text: str) -> bool:
    return any(phrase in text for phrase in REFUSALS) or NOTHING_SEEN.search(text) is not None


def likeness(answer: str | None, gold: str | None) -> Likeness:
    """Letters are compared only where nothing simpler settles it."""
    texts = normal(answer), normal(gold)
    a, g = (re.findall(r"\w+", x) for x in texts)
    content_a, content_g = (Counter(w for w in x if w not in STOP_WORDS) for x in (a, g))
    keys_a, keys_g = ({key_word(w) for w in c} - {""} for c in (content_a, content_g))
    answers = all(texts) and (_refuses(texts[1]) or not _refuses(texts[0]))
    equal, comparable = texts[0] == texts[1], min(len(a), len(g)) >= LEAST_WORDS
    contained, words = texts[0] in texts[1] or texts[1] in texts[0], overlap_f1(Counter(a), Counter(g))
    covered = len(keys_a & keys_g) / len(keys_g) if len(keys_g) >= LEAST_KEY_WORDS else 0.0
    open_ = answers and comparable and not (equal or contained or words >= ALIKE_WORDS or covered >= COVERED)
    letters = SequenceMatcher(None, *texts).ratio() if open_ else 0.0
    return Likeness(answers, equal, comparable, contained, letters, words, overlap_f1(content_a, content_g), covered)


def same_answer(answer: str | None, gold: str | None) -> bool:
    """Whether an open answer says what the gold answer says."""
    return likeness(answer, gold).same()


def boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...} (braces balanced) or \\boxed word; of the last \\fbox if there is no \\boxed."""
    text = text or ""
    mark = "\\boxed" if "\\boxed" in text else "\\fbox"
    at = text.rfind(mark)
    if at < 0:
        return None
    rest = text[at + len(mark) :]
    if not rest.lstrip().startswith("{"):
        return rest.split("$")[0].strip() or None
    depth, begin = 0, rest.find("{")
    for i in range(begin, len(rest)):
        depth += {"{": 1, "}": -1}.get(rest[i], 0)
        if not depth:
            return rest[begin + 1 : i]
    return None


def first_json(text: str | None) -> str | None:
    """The first JSON object or list in prose or a fence, as compact JSON."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "", flags=re.IGNORECASE)
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    return None


def verdict(text: str | None) -> bool | None:
    """What a judge's JSON says under correct, is_correct or score."""
    found = first_json(text)
    value = json.loads(found) if found else None
    if not isinstance(value, dict):
        return None
    for k in ("correct", "is_correct", "score"):
        v = value.get(k)
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return v >= 0.5
        if isinstance(v, str) and v.strip():
            return v.strip().lower() in ("1", "true", "yes", "y", "on", "correct")
    return None


def multiset_likeness(a: list, b: list) -> float:
    """Shared over all of two lists; two empty lists are alike."""
    if sorted(map(str, a)) == sorted(map(str, b)):
        return 1.0
    shared = sum((Counter(map(str, a)) & Counter(map(str, b))).values())
    return shared / (len(a) + len(b) - shared) if a and b else 0.0


def call_likeness(made: str | None, gold: str | None) -> float:
    """From -3 to 3: names of two JSON lists of calls {name, parameters}, and for each gold call its best match by keys and values."""
    try:
        a, g = ([(c["name"], c.get("parameters") or {}) for c in json.loads(x or "[]")] for x in (made, gold))
    except (ValueError, TypeError, KeyError, AttributeError):
        return -3.0
    got, most = multiset_likeness([n for n, _ in a], [n for n, _ in g]), 1.0
    left = list(a)
    for name, want in g:
        most += 1 + len(want)
        same = [(multiset_likeness(list(p), list(want)) + sum(p.get(k) == v for k, v in want.items()), i) for i, (n, p) in enumerate(left) if n == name]
        if same:
            points, i = max(same, key=lambda x: (x[0], -x[1]))
            got += points
            left.pop(i)
    return 6 * got / most - 3


def _udf(f, kind):
    """f over two columns (or one), in Arrow batches."""

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in a], dtype=object)

    return one if f.__code__.co_argcount == 1 else two


def likeness_of(answer: Column, gold: Column) -> Column:
    """struct of LIKENESS."""

    @F.pandas_udf(LIKENESS)
    def features(a: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([likeness(x, y) for x, y in zip(a, g, strict=True)], columns=Likeness._fields)

    return features(answer, gold)


def open_answer(answer: Column, gold: Column) -> Column:
    """The features as columns, and one expression that decides."""
    found = likeness_of(answer, gold)
    return Likeness(*(found[f] for f in Likeness._fields)).same()


def boxed_answer(text: Column) -> Column:
    return _udf(boxed, t.StringType())(text)


def json_in(text: Column) -> Column:
    return _udf(first_json, t.StringType())(text)


def judged(text: Column) -> Column:
    return _udf(verdict, t.BooleanType())(text)


def tool_calls(made: Column, gold: Column) -> Column:
    return _udf(call_likeness, t.DoubleType())(made, gold)


def bleu4(answer: str | None, gold: str | None) -> float:
    """Smoothed (add one beyond unigrams) BLEU of characters' or words' 1- to 4-grams, with the brevity penalty."""
    import math

    a, g = re.findall(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+", answer or ""), re.findall(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+", gold or "")
    if not a or not g:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        x, y = (Counter(zip(*(s[i:] for i in range(n)), strict=False)) for s in (a, g))
        hit, all_ = sum((x & y).values()), max(1, sum(x.values()))
        if n == 1 and not hit:
            return 0.0
        total += math.log((hit + (n > 1)) / (all_ + (n > 1))) / 4
    return min(1.0, math.exp(1 - len(g) / len(a))) * math.exp(total)


def rouge_l(answer: str | None, gold: str | None) -> float:
    """F1 of the longest common subsequence of words."""
    a, g = (answer or "").split(), (gold or "").split()
    row = [0] * (len(g) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(g):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 2 * row[-1] / (len(a) + len(g)) if row[-1] else 0.0


def overlap_scores(answer: Column, gold: Column) -> Column:
    """struct(bleu4, rouge_l)."""

    @F.pandas_udf("bleu4 double, rouge_l double")
    def scores(a: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"bleu4": [bleu4(x, y) for x, y in zip(a, g, strict=True)], "rouge_l": [rouge_l(x, y) for x, y in zip(a, g, strict=True)]})

    return scores(answer, gold)
