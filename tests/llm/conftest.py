"""Small tables with the cases that every operator must take."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns whose names clash with the operators' own."""
    prose = " ".join(f"word{i % 97} and{i % 89}" for i in range(60))
    long = " ".join(f"long{i}" for i in range(30_000)) + " end@of.long 10.0.0.1"
    rows = [
        (1, prose, "en", "a", len(prose)), (1, prose, "en", "a", len(prose)), (2, prose, "en", "b", len(prose)),
        (None, prose, None, None, None), (3, None, None, "a", None), (4, "", "en", "a", 0), (5, " \n\t ", "en", None, 4),
        (6, long, "en", "a", len(long)), (7, "one", "de", "a", 3), (8, "a a a a a a", "de", "b", 11), (9, "é\U0001F600 x@y.zz", "fr", "b", 10),
    ]
    wide = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return wide.withColumns({n: F.lit(7) for n in (
        "n_words", "kept", "h", "fp", "_row", "_doc", "component", "rate", "copies", "tokens", "score", "words", "n", "hashes", "th", "start")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
