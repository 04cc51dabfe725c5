"""Pair corpora: one JSON object per line, ``{"input": <function>, "output": <test>, ...}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.rules import first_reason, is_blank

PAIR_FIELDS = ("input", "output")


def parse_pairs(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``input``, ``output``, ``extra`` (all other keys, as a variant) and
    ``read_error`` to a frame with a raw JSON line per row.

    The line is parsed once into a variant, which keeps every key with its type and,
    unlike a fixed schema, does not turn ``{"input": 5}`` into text silently."""
    doc = F.try_parse_json(F.col(raw))
    parsed = lines.withColumn("_doc", doc).withColumn("_kind", F.schema_of_variant("_doc"))

    def field(name: str) -> Column:
        return F.try_variant_get("_doc", f"$.{name}", "string")

    def wrong_type(name: str) -> Column:
        # An explicit null counts as missing text.
        kind = F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant"))
        return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))

    reason = first_reason([
        ("blank_line", is_blank(raw)),
        ("bad_json", F.col("_doc").isNull()),
        ("not_an_object", ~F.col("_kind").startswith("OBJECT")),
        ("bad_type", wrong_type("input") | wrong_type("output")),
    ])
    readable = F.col("read_error").isNull()
    return (
        parsed.withColumn("read_error", reason)
        .withColumns({n: F.when(readable, F.coalesce(field(n), F.lit(""))) for n in PAIR_FIELDS})
        .withColumn("extra", F.when(readable, F.col("_doc")))
        .drop("_doc", "_kind")
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the corpus with its file; unreadable lines carry ``read_error``."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return parse_pairs(lines)


def stream_pairs(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same columns from JSONL files as they arrive."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(path).select(F.col("value").alias("raw"))
    return parse_pairs(lines)


