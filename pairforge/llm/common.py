"""What several operators share: input columns, sizes, and durable intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.session import checkpoint_dir

#: Fixed value: a word is a run of characters other than these six.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and the further columns named; all others go."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def words(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def parts_for(docs: DataFrame, bytes_a_part: int) -> int:
    """How many parts of about ``bytes_a_part`` of text there are, at least one: one number
    from a scan with partial sums, so that work is dealt by size and not by cluster."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // bytes_a_part))


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: outlives executors, computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
