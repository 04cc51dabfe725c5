"""Texts and rows that operators must survive: nulls, empties, repeats, long texts, extra columns."""

import pytest
from pyspark.sql import functions as F

CLASHING = ("key", "h", "n", "size", "bucket", "score", "spans", "node", "chunk", "part", "word", "words", "id", "k", "weight", "before",
            "text_hash", "_id", "_key", "_row", "_words", "_taken", "host", "path", "rule", "kept", "piece", "length", "batch", "taken")

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source)."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (1, BASE + " and a tail of its own", "a"), (2, "Prefix here " + BASE, "a"), (3, BASE + " and a tail of its own", "b"),
        (4, None, "b"), (5, "", None), (6, " \t\n ", "a"), (7, "short text", "c"), (8, "short text", "c"),
        (9, long, "a"), (10, long + " end", "d"), (11, "Ünïcödé wörds and 𝒳 symbols … here\u00a0too", None), (12, "x" * 5000, "a"),
        (13, "\n".join(["same line here"] * 30), "a"), (14, BASE.upper() + "!! ### $$$", "b"),
        (15, "mail me at joe@mail.example.com or +1 (555) 010-9999 now", "b"), (15, "mail me at joe@mail.example.com or +1 (555) 010-9999 now", "b"),
        (None, "a row without any id at all, in five words", "a"), (16, "it's <|endoftext|> don't", "e"), (17, "one", None),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
