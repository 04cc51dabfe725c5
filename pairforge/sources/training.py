"""Cleaned corpora in, model-ready tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRAINING_SCHEMA = "input string, output string"


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_SCHEMA).json(path)


def write_training(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Model inputs and labels only, one folder per split."""
    (
        df.select("prompt", "prompt_tokens", "label", "label_tokens", "split")
        .write.mode(mode)
        .partitionBy("split")
        .parquet(path)
    )
