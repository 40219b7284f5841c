"""Benchmark decontamination by winnowing, in DataFrame functions only.

The fingerprint of a window of `length` words is the least hash of its `k`-grams, which a text keeps once for each run of windows.
Any shared span of `length` words shares a fingerprint, so that joining the distinct fingerprints of
documents and benchmark finds every document that may hold one. In those documents alone, the windows with such a
fingerprint are compared as strings, which extends each hit to all the words it covers.

Defined results: a null, empty or wordless text has no words and no hits; an item without words is never found; an item of
fewer than `length` words is one window of its own length; item_ids are of any type and sorted as strings; equal items are all named, items without an id are not; a doc_id may be null or repeat; an empty benchmark leaves every document clean;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, rows_of, sent_side, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, as a pattern.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z and cuts into words."""
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def _gram(n: int):
    return lambda x, i: F.xxhash64(F.lit(n), x, *(F.get("hashes", i + j) for j in range(1, n)))


def _window(n: int):
    return lambda p, i: F.struct(p.alias("print"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("window"))


def _place(n: int):
    return lambda p, i: F.struct(i.alias("at"), F.lit(n).alias("n"), p.alias("print"))


def _with_fingerprints(df: DataFrame, length: int, k: int, short: list[int]) -> DataFrame:
    """Adds f<L>, the fingerprint of the window that starts at each place, for `length` and each of short, from column words."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def at(a: str, n: int, of) -> Column:
        """of(item, place) for each place from which a has n items."""
        return F.when(F.size(a) >= n, F.transform(F.slice(a, 1, F.size(a) - (n - 1)), of)).otherwise(F.array().cast("array<long>"))

    df = df.withColumn("grams", at("hashes", k, lambda x, i: F.xxhash64(x, *(F.get("hashes", i + j) for j in range(1, k)))))
    w = length - k + 1
    df = df.withColumn(f"f{length}", at("grams", w, lambda x, i: F.least(x, *(F.get("grams", i + j) for j in range(1, w)))))
    for n in short:
        df = df.withColumn(f"f{n}", at("hashes", n, _gram(n)))
    return df


def decontaminate(
    docs: DataFrame, items: DataFrame, length: int = 10, k: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words, n_hit) of every document, and (row, item_id) of the items found in each; row stands for key and text."""
    spark = docs.sparkSession
    prepare(spark)
    items = items.select(F.col(item_key).alias("item_id"), words(F.coalesce(F.col(item_text), F.lit(""))).alias("words")).where("size(words) > 0")
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).where(f"n < {length}").distinct().collect())  # fewer than `length` rows
    sizes = [length, *short]
    named = _with_fingerprints(items, length, k, short)
    parts = []
    for n in sizes:
        own = named.where(F.size("words") >= length if n == length else F.size("words") == n)
        parts.append(own.select("item_id", F.explode_outer(F.transform(f"f{n}", _window(n))).alias("w")).where("w is not null").select("item_id", "w.*"))
    windows = parts[0]
    for p in parts[1:]:
        windows = windows.unionAll(p)
    windows = written(windows, "windows")

    # explode_outer, here and below: for explode, Spark adds a filter on the array and pushes it down, which
    # repeats the arrays' expressions inside their own lambdas
    texts = rows_of(docs, key, text).select("row", "rest.doc_id", "text")
    cut = texts.select("row", "doc_id", words(F.col("text")).alias("words"))
    seen = _with_fingerprints(cut, length, k, short).select("row", "doc_id", F.size("words").alias("n_words"), F.array_distinct(F.concat(*(F.array_distinct(f"f{n}") for n in sizes))).alias("prints"))
    own = F.struct(F.xxhash64("row", F.lit("document")).alias("print"), F.lit(True).alias("whole"))
    each = F.explode_outer(F.concat(F.array(own), F.transform("prints", lambda p: F.struct(p.alias("print"), F.lit(False).alias("whole")))))
    each = seen.select("row", "doc_id", "n_words", each.alias("e")).select("row", "doc_id", "n_words", "e.*")
    known = written(windows.select("print").distinct(), "prints").withColumn("known", F.lit(True))
    found = written(each.join(known, "print", "left").where("whole or known"), "found")

    suspects = written(found.where("known").select("row").distinct(), "suspects")
    of_suspects = texts.join(sent_side(suspects), "row")
    cut = of_suspects.select("row", words(F.col("text")).alias("words"))
    near = _with_fingerprints(cut, length, k, short)
    places = near.select("row", F.explode_outer(F.concat(*(F.transform(f"f{n}", _place(n)) for n in sizes))).alias("p")).select("row", "p.*")
    starts = places.join(sent_side(known), "print").groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("starts"))
    spans = of_suspects.join(written(starts, "starts"), "row").select("row", "starts", words(F.col("text")).alias("words"))
    spans = spans.select(
        "row",
        F.explode_outer(
            F.transform(
                "starts", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.array_join(F.slice("words", s["at"] + 1, s["n"]), " ").alias("window")),
            )
        ).alias("s"),
    ).where("s is not null").select("row", "s.*")
    whole = written(spans.join(windows.select("window", "n").distinct(), ["window", "n"]), "hits")

    # words covered: for sorted spans, those before the next span's start
    ordered = F.array_sort(F.collect_set(F.struct("at", "n")))
    ends = F.transform("spans", lambda s: s["at"] + s["n"])
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    total = F.aggregate(
        F.arrays_zip(F.col("spans.at").alias("at"), ends.alias("end")), state,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], acc["end"]))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    counts = whole.groupBy("row").agg(ordered.alias("spans")).select("row", total.cast("long").alias("n_hit"))
    per_doc = found.where("whole").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(counts, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
    )
    pairs = whole.select("row", "window", "n").distinct().join(windows.select("window", "n", "item_id").distinct(), ["window", "n"]).select("row", "item_id").distinct()
    return per_doc, pairs


def digest(per_doc: DataFrame, pairs: DataFrame) -> DataFrame:
    items = pairs.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.array().cast("array<string>")
    out = per_doc.join(items, "row", "left").withColumn("items", F.coalesce("items", none))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], length: int = 10) -> dict[int, tuple[int, int, int, str, bool]]:
    """What digest(decontaminate()) says, straight from the definition; for tests."""

    def cut(t: str | None) -> list[str]:
        return [w for w in re.split(GAP, (t or "").translate(str.maketrans(UPPER, LOWER))) if w]

    windows: dict[tuple, set[int]] = {}
    for i, t in items:
        w = cut(t)
        for j in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + length]), set()).add(i)
    sizes, out = {len(w) for w in windows}, {}
    for d, t in docs:
        w = cut(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    hit[j : j + n] = [True] * n
                    found |= x
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit))
    return out
