"""Uploaded source files: bytes to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.text import as_col


def decode_source(content: Column | str) -> Column:
    """UTF-8 if the bytes are valid UTF-8, else Latin-1, which never fails."""
    content = as_col(content)
    # Valid bytes are the text as it stands.
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def read_source_files(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content", F.col("length").alias("n_bytes"), decode_source("content").alias("code"))
    )
