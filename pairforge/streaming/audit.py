"""Incremental audit of JSONL files as they arrive, with the batch gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairforge.operators.audit import audit_base, audit_edge
from pairforge.sources.pairs import stream_pairs
from pairforge.sources.sinks import write_split


def audited_stream(spark: SparkSession, path: str, kind: str = "base", mode: str = "strict",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    pairs = stream_pairs(spark, path, max_files_per_trigger)
    return audit_base(pairs, mode) if kind == "base" else audit_edge(pairs)


def audit_stream(spark: SparkSession, path: str, out: str, checkpoint: str, kind: str = "base",
                 mode: str = "strict", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Audit what is there and stop (``availableNow``); run again for new files. Each
    micro-batch overwrites its own folder, so a retried batch leaves no duplicates."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_split(batch, out, batch=batch_id)

    return (
        audited_stream(spark, path, kind, mode, max_files_per_trigger)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The totals a stopped (or running) :func:`running_audit_counts` stream has reached, read
    from its state store: no sink has to keep them, and no file is read again."""
    state = spark.read.format("statestore").load(checkpoint)
    total = state.schema["value"].dataType.names[0]
    return state.select("key.outcome", "key.reason", F.col("value")[total].alias("n"))


def running_audit_counts(audited: DataFrame) -> DataFrame:
    """Live totals per outcome and reason; run with output mode ``update`` or ``complete``."""
    # A plain column as key, so that the state store knows it by its name.
    named = audited.select("outcome", F.coalesce("reason", F.lit("")).alias("reason"))
    return named.groupBy("outcome", "reason").agg(F.count("*").alias("n"))
