"""Writers for audited corpora and exported tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairforge.functions.maps import set_fields
from pairforge.functions.text import export_name

OUTCOMES = ("kept", "rejected", "quarantined")


def kept_line() -> Column:
    """The JSON line of a kept record: the whole object with the audited test."""
    return set_fields(F.col("extra"), {"output": F.col("output")})


def write_split(audited: DataFrame, path: str, mode: str = "overwrite", batch: int | None = None,
                totals: Observation | None = None) -> DataFrame:
    """Write an audited frame once, as ``<path>/audited`` (outcome, reason, raw and the line to
    keep, Parquet by outcome), and from that table ``<path>/lines/outcome=kept|rejected|
    quarantined/`` text files: kept records re-serialised with all their keys, the others as
    their raw line; and ``<path>/reasons`` with raw line, outcome and reason. Returns the table.

    ``batch`` adds a ``batch=<n>`` level to all, for a stream that writes one folder per
    micro-batch. The audit runs once, with no count in between; row order is not kept.
    ``totals`` is an observation that gets the number of lines of each outcome from the write
    itself (``totals.get``), so a report needs no second pass."""
    level = "" if batch is None else f"/batch={batch}"
    line = F.when(F.col("outcome") == "kept", kept_line()).otherwise(F.col("raw"))
    once = path + "/audited" + level
    if totals is not None:
        audited = audited.observe(totals, *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    audited.select("raw", "reason", line.alias("value"), "outcome").write.mode(mode).partitionBy("outcome").parquet(once)
    schema = "raw string, reason string, value string, outcome string"
    written = audited.sparkSession.read.schema(schema).parquet(once)
    written.select("value", "outcome").write.mode(mode).partitionBy("outcome").text(path + "/lines" + level)
    written.filter(F.col("outcome") != "kept").select("raw", "outcome", "reason").write.mode(mode).parquet(path + "/reasons" + level)
    return written


def exported(items: DataFrame) -> DataFrame:
    """(file_name, content) of every item that has tests."""
    has_tests = F.coalesce(F.col("generated_tests") != "", F.lit(False))
    return items.filter(has_tests).select(
        "id", export_name("generated_tests", "id").alias("file_name"), F.col("generated_tests").alias("content")
    )


def write_exports(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one row per exported file. A folder per name would mean one open
    writer per item in every task, so names stay a column."""
    exported(items).write.mode(mode).parquet(path)
