"""Corpus to training tables: read, audit, split, prompt, truncate, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.audit import audit_base, audit_edge
from pairforge.operators.training import prepare_training, train_eval_split
from pairforge.sources.pairs import read_pairs
from pairforge.sources.sinks import write_split
from pairforge.sources.training import read_training, write_training


def audit_corpus(spark: SparkSession, path: str, out: str, kind: str = "base", mode: str = "strict") -> DataFrame:
    """Audit a JSONL corpus into ``out`` and return the table it wrote (outcome, reason, raw
    and kept line): the audit runs once, reports read the table."""
    pairs = read_pairs(spark, path)
    return write_split(audit_base(pairs, mode) if kind == "base" else audit_edge(pairs), out)


def training_tables(spark: SparkSession, cleaned: str, out: str, mode: str = "base", exact: bool = False) -> None:
    """Prompts and labels of a cleaned corpus, split into train and eval by
    content: copies of a record always land on the same side."""
    corpus = read_training(spark, cleaned).withColumn("_key", F.sha2(F.concat_ws("\x1f", "input", "output"), 256))
    prepared = prepare_training(corpus, mode)
    write_training(train_eval_split(prepared, "_key", exact=exact), out)
