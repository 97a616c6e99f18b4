from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, rows that repeat, and columns with names the operators use."""
    long_text = "word " * 30_000 + "end"
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
        (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n\t ", None, "a", 4), (None, "Der schnelle braune Fuchs springt", "de", "b", 33), (6, long_text, "en", "b", len(long_text)),
        (7, long_text + " more", None, None, None), (8, "x", "en", "c", 1), (9, "日本語のテキスト 😀 ▁ \x00  ", None, "c", None), (10, "", "de", "c", 0),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit("clash") for n in ("fp", "rank", "key", "hi", "lo", "edge", "box", "tie", "th", "n_tokens", "gone", "dotted.name", "SIDE")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
