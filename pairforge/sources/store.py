"""Session and item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.rules import Rule

SESSIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("uploaded_code", T.StringType()),
    T.StructField("pasted_code", T.StringType()),
    T.StructField("generated_tests", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("notes", T.StringType()),
    T.StructField("item_limit", T.IntegerType()),
])
ITEMS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("source_code", T.StringType()),
    T.StructField("input_method", T.StringType()),
    T.StructField("source_filename", T.StringType()),
    T.StructField("pasted_code", T.StringType()),
    T.StructField("uploaded_code", T.StringType()),
    T.StructField("generated_tests", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])
SCHEMAS = {"sessions": SESSIONS, "items": ITEMS}

# Column defaults of the current layout. Older layouts lack the column
# or hold NULL there.
DEFAULTS = {
    "sessions": {"title": "New Session", "item_limit": 50},
    "items": {"input_method": "paste"},
}


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Bring any older layout to the current one: missing columns are added, NULLs
    in defaulted columns filled, types aligned."""
    empty = df.sparkSession.createDataFrame([], SCHEMAS[kind])
    full = empty.unionByName(df, allowMissingColumns=True).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[kind].fields]
    )
    defaults = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in DEFAULTS[kind].items()}
    if kind == "items":
        defaults["meta"] = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    return full.withColumns(defaults)


def read_store(spark: SparkSession, kind: str, path: str | None = None, jdbc: dict[str, str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A store table from files, or over JDBC by passing Spark's own options through
    (``url``, ``dbtable``, ``partitionColumn``, ``lowerBound``, ``upperBound``,
    ``numPartitions``: give the last four, or one task reads the whole table)."""
    if jdbc is not None:
        df = spark.read.format("jdbc").options(**jdbc).load()
    else:
        df = spark.read.format(fmt).load(path)
    return with_defaults(df, kind)


def store_rules(kind: str) -> list[Rule]:
    """Row constraints of the store, for :func:`pairforge.functions.rules.first_reason`."""
    if kind == "sessions":
        return [
            ("title_too_long", F.length("title") > 120),
            ("negative_item_limit", F.col("item_limit") < 0),
        ]
    return [
        ("unknown_input_method", ~F.col("input_method").isin("paste", "upload")),
        ("file_name_too_long", F.length("source_filename") > 255),
    ]
