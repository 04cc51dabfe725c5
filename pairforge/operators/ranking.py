"""Per-group running totals that never put a whole group into one task.

A plain window over ``key`` sorts all rows of a key in one task, which fails when one
key holds a third of the table. Here the group is cut into value buckets first:
totals per (key, bucket) come from a partially aggregated ``groupBy``, their running
sum from a window over those few totals, and only the order *inside* a bucket from a
window over rows. The row window and the join share the (key, bucket) shuffle.

Buckets of a fixed width (an hour, a block of ids) cost nothing, but a busy hour is one task
again. Without a bucket the rows are cut into ranges of (key, order) that hold alike many rows,
whatever the key, the hour or the number of equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.session import written


def even_ranges(df: DataFrame, keys: list[str], order: list[Column], name: str = "_bucket",
                parts: int | None = None) -> DataFrame:
    """Add ``name``: the number of the row's range, rising along (``keys``, ``order``). There are
    ``parts`` ranges (default: the session's shuffle partitions), cut from Spark's sample of
    the rows, so each holds a like share of the table: a key with a third of all rows spans a
    third of the ranges, and equal times are parted by the next order column. The table is
    written once, since a second run would cut elsewhere. Rows equal in all order columns share
    a range; an empty table gives an empty table."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return written(ranged.withColumn(name, F.spark_partition_id().cast("bigint")), "ranges")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column | None,
    totals: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Add, per row, the sum of each expression over all *earlier* rows of its group.

    ``bucket`` must be a monotone function of the first order column (for instance
    the hour of a timestamp, or an integer divided by a width), so that earlier
    buckets hold earlier rows; ``descending`` says that ``order`` runs downwards. None cuts the
    rows into :func:`even_ranges` instead.
    ``order`` must be a total order within a group; key columns must not be NULL."""
    names = list(totals)
    slot = "_bucket"
    while slot in df.columns:
        slot = "_" + slot
    first = F.lit(-(2**63)).cast("bigint")
    staged = df.withColumns({f"_v_{n}": e for n, e in totals.items()})
    if bucket is None:
        # Ranges are numbered along the order, whichever way it runs.
        staged, descending = even_ranges(staged, keys, order, slot), False
    else:
        staged = staged.withColumn(slot, F.coalesce(bucket.cast("bigint"), first))
    per_bucket = staged.groupBy(*keys, slot).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names])
    direction = F.col(slot).desc() if descending else F.col(slot).asc()
    before_bucket = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(slot).alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_b_{n}").over(before_bucket), F.lit(0)).alias(f"_o_{n}") for n in names],
    )
    same = F.col(slot) == F.col("_k_bucket")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    before_row = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(before_row), F.lit(0)) for n in names})
        .join(offsets, same, "left")
        .withColumns({n: F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.col(f"_i_{n}") for n in names})
        .select(*df.columns, *names)
    )


def with_position(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None = None, name: str = "position",
    descending: bool = False,
) -> DataFrame:
    """0-based position of every row in its group (exact, skew-safe row number)."""
    return running_totals(df, keys, order, bucket, {name: F.lit(1).cast("bigint")}, descending)


def time_bucket(ts: Column, width_seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width_seconds * 1_000_000))


def int_bucket(value: Column, width: int = 4096) -> Column:
    return F.floor(value / F.lit(width))
