"""Rows that every operator must survive: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 13}." for i in range(30_000))
RUN = "ab" * 60_000
ODD = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n ", None, "s"), (None, "one two three four five", "en", None),
    (5, LONG, "en", "s"), (6, RUN, "en", "s"), (7, "same text of a repeated row here", "en", "s"),
    (7, "same text of a repeated row here", "en", "s"), (8, "é漢字 😀 ſ K İ mix\r\nnew\x0bline", "fr", "t"),
    (9, "9" * 3000 + " +1" * 500 + " 1.2.3" * 50, "de", "t"), (7, "another text under the same number", "en", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows, with columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    rows = [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in ODD]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ["n_words", "kept", "words", "key", "hits", "blob", "cid", "signature", "rate", "__kept", "span.x"]
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def sf():
    return SF


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
