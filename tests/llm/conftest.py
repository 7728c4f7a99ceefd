import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("_row", "_copies", "_rows", "size", "rank", "kept", "key", "ids", "again", "component", "n_words", "_line", "block", "gumbel")


def words(r, n):
    return " ".join("".join(r.choice(("th", "er", "an", "ou", "la", "de", "é", "ß")) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Null and empty texts, sources and ids, white space only, very long texts, ties, near and exact copies, repeated rows."""
    r = random.Random(3)
    base = words(r, 120)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\r ", None, None, 5), (4, base, "en", "a", 1), (5, base, "en", "b", 1), (6, base + " more", "en", None, 1)]
    rows += [(7, "one", "fr", "a", 3), (8, "one two", "fr", "b", 7), (9, "ONE two", "fr", "b", 7), (10, words(r, 20_000), "de", "b", 1), (11, "x" * 50_000, "de", "a", 1)]
    rows += [(12, "line\n" * 200, "en", "a", 1), (13, "mail a.b@x.org 10.0.0.1 <|endoftext|> 💬 ▁ it's", "en", "a", 1), (None, base, "en", "a", 1), (4, base, "en", "a", 1)]
    rows += [(100 + i, words(r, 40), "en", r.choice("abc"), 1) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.select("*", *(F.lit("own").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
