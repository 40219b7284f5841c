import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, `rest` string, spans int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages, periodic texts."""
    rng = random.Random(5)
    passage, base = prose(rng, 70), prose(rng, 120)
    texts = [None, "", " \t\n", "one", "Two words", "a " * 200, "same same " * 60, base, base, base.replace("w1", "W1", 1), base + " end", "start " + base]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    texts += [prose(rng, rng.randrange(1, 90)) for _ in range(15)] + [prose(rng, 4000), "é" * 500, "日本語 " * 80, passage, "<a> x</a> y " * 12]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[3], (None, base), (None, None), (None, prose(rng, 50)), (3, "another text with the id of one above")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """odd_rows with other columns, some null and some with names that operators use."""
    langs = ["en", None, "fr"]
    return spark.createDataFrame([(i, t, langs[k % 3], None, None if t is None else len(t), "k", k, None, k) for k, (i, t) in enumerate(odd_rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
