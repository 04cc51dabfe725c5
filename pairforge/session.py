"""Session settings and the durable folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A repeated JSON key keeps its last value, as in Python.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Merge session windows before the shuffle, so that a busy key travels as few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Code texts are short but can reach 200 kB: batches for Python are bounded in bytes too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}


def get_session(app: str = "pairforge", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults this library expects. Settings the cluster
    (spark-defaults / submit) already made are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Spread a scan over the partitions that ``pairforge.spread`` names in the session, ahead
    of work that is heavy per row. Not set (the default): no shuffle, the scan's own splits
    count, unless its rows are ``narrow`` (a few numbers, cheap to move) and it has fewer splits
    than two for each core: then over so many. For files of one row group, which are one task."""
    parts = df.sparkSession.conf.get("pairforge.spread", None)
    if parts:
        return df.repartition(int(parts))
    enough = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(enough) if narrow and df.rdd.getNumPartitions() < enough else df


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once, before anything that follows.

    Catalyst moves a filter below the projection that computes its column, which would
    copy a long rule expression (and the parser call in it) into the filter and evaluate
    it twice. A one-row generator is a narrow step that filters do not cross."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def grouped(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys together in one partition, sorted by keys and order, for a function over
    whole partitions.

    The partitions go by a hash of the keys, not by the keys: a repartition by the very keys of a
    join below is dropped by the planner, and where adaptive execution then makes that join a
    broadcast, the rows stay where they lay before it and a key is in several partitions."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a session in local mode that
    names none, as in tests, gets a temporary folder of its own."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = os.path.join(tempfile.mkdtemp(prefix="pairforge-"), "checkpoint")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name of its own in the shared folder; nothing is created yet."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, safe from the loss of
    executors, and every reader takes only the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
