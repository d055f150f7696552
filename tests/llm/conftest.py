import random

import pytest

from tidemark.llm.text import Scratch

#: Columns that clash with names the operators use inside.
CLASHING = "h bigint, n bigint, d bigint, score double, component_id bigint, spans string, kept boolean, bucket bigint, rep bigint, host string, label int, _h string, _d string, _spans int, _id string, _own int, _host int, _best int, _salt int, _text string, text_ int"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def prose(rnd: random.Random, words: int, vocabulary: int = 4000) -> str:
    return " ".join(f"{rnd.choice('abcdefghij')}{rnd.choice('aeiou')}w{rnd.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rnd = random.Random(1)
    long = prose(rnd, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t", "en", None), (4, long, "en", "s"), (4, long, "en", "s"), (5, "word", None, "s"), (None, "null id text here", "en", "s"), (None, None, None, None), (6, "ÉÀ ß \U0001f600 中文 ١٢", "fr", "s"), (7, "x" * 1000, "en", "s"), (8, "a b c d e", "en", "s"), (9, "A  b\tc d E", "en", "s")]
    return rows + [(10 + i, prose(rnd, 60), "en", "s") for i in range(5)]


@pytest.fixture
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")))


@pytest.fixture
def empty(odd):
    return odd.limit(0)
