"""Input tables, and the pair table derived from ``orders`` in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.literals import format_literal
from pairforge.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FAMILIES = ("add", "subtract", "multiply", "divide", "power", "is_even")
OPERATORS = ("+", "-", "*", "/", "**")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One (function, test) pair per order: six families, every fifth value wrong."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), narrow=True)
    df = orders.select(
        F.col("o_orderkey").alias("pair_id"),
        F.col("o_custkey").alias("owner"),
        pick(F.col("o_orderkey") % 6, FAMILIES).alias("family"),
        (F.col("o_custkey") % 20).alias("a"),
        (F.col("o_orderkey") % 7).alias("b"),
        F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("wrong"),
        F.when(F.col("o_custkey") % 3 == 0, " == ").otherwise("==").alias("eq"),
    )
    a, b, wrong = F.col("a"), F.col("b"), F.col("wrong")
    whole = (
        F.when(F.col("family") == "add", a + b)
        .when(F.col("family") == "subtract", a - b)
        .when(F.col("family") == "multiply", a * b)
        .when(F.col("family") == "power", F.pow(a, b).cast("bigint"))
    )
    quotient = F.try_divide(a.cast("double"), b.cast("double"))
    true_text = F.coalesce(whole.cast("string"), F.when(F.col("family") == "divide", format_literal(quotient)))
    rhs = (
        F.when(F.col("family") == "is_even", "True")
        .when(F.col("family") == "divide", F.coalesce(format_literal(quotient + wrong), F.lit("0")))
        .otherwise((whole + wrong).cast("string"))
    )
    operator = pick(F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1, OPERATORS + ("",))
    body = F.when(F.col("family") == "is_even", "a % 2 == 0").otherwise(F.concat(F.lit("a "), operator, F.lit(" b")))
    call = F.concat("family", F.lit("("), a.cast("string"), F.lit(","), b.cast("string"), F.lit(")"))
    return df.withColumns({"true_text": true_text, "rhs": rhs}).select(
        "pair_id", "owner", "family", "a", "b", "eq", "true_text", "rhs",
        F.concat(F.lit("def "), "family", F.lit("(a, b):\n    return "), body).alias("input"),
        F.concat(F.lit("def test_"), "family", F.lit("(): assert "), call, "eq", "rhs").alias("output"),
    )


LITERAL_SQL = r"""CASE WHEN {0} IS NULL THEN NULL WHEN {0} = 0 THEN '0.0'
  ELSE regexp_replace(regexp_replace(printf('%.10f', {0}), '0+$', ''), '\.$', '') END"""

PAIRS_SQL = rf"""WITH pair_base AS (
  SELECT o_orderkey AS pair_id, o_custkey AS owner,
    list_extract(['add','subtract','multiply','divide','power','is_even'], CAST(o_orderkey % 6 AS INT) + 1) AS family,
    list_extract(['+','-','*','/','**',''], CAST(o_orderkey % 6 AS INT) + 1) AS op,
    o_custkey % 20 AS a, o_orderkey % 7 AS b,
    CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS wrong,
    CASE WHEN o_custkey % 3 = 0 THEN ' == ' ELSE '==' END AS eq
  FROM orders),
pair_value AS (
  SELECT *, CASE family WHEN 'add' THEN a + b WHEN 'subtract' THEN a - b WHEN 'multiply' THEN a * b
      WHEN 'power' THEN CAST(pow(a, b) AS BIGINT) END AS whole,
    CASE WHEN family = 'divide' AND b <> 0 THEN CAST(a AS DOUBLE) / b END AS quotient
  FROM pair_base),
pair_text AS (
  SELECT *, CASE family WHEN 'divide' THEN {LITERAL_SQL.format('quotient')}
      WHEN 'is_even' THEN NULL ELSE CAST(whole AS VARCHAR) END AS true_text,
    CASE family WHEN 'is_even' THEN 'True'
      WHEN 'divide' THEN coalesce({LITERAL_SQL.format('(quotient + wrong)')}, '0')
      ELSE CAST(whole + wrong AS VARCHAR) END AS rhs
  FROM pair_value),
pairs AS (
  SELECT pair_id, owner, family, op, a, b, wrong, eq, true_text, rhs,
    'def ' || family || '(a, b):' || chr(10) || '    return ' ||
      CASE WHEN family = 'is_even' THEN 'a % 2 == 0' ELSE 'a ' || op || ' b' END AS input,
    'def test_' || family || '(): assert ' || family || '(' || a || ',' || b || ')' || eq || rhs AS output
  FROM pair_text)
"""
