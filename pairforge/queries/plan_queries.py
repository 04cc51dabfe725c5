"""Whole plans: choosing tests for submissions, regenerating the tests of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions.constants import FALLBACK_TESTS
from pairforge.functions.literals import format_literal
from pairforge.operators.candidates import union_stages
from pairforge.plans.generation import choose_tests, functions, merge_by_submission, regenerate
from pairforge.queries import query
from pairforge.queries.tables import FAMILIES, LITERAL_SQL, PAIRS_SQL, pairs

TWIN = "\n\ndef twin(q):\n    return q * 2\n"
TEST_SQL = "'def test_' || family || '():' || chr(10) || '    assert ' || family || '(' || a || ', ' || b || ') == ' || {0}"


def test_of(df: DataFrame) -> DataFrame:
    """A passing candidate per pair."""
    call = F.concat("family", F.lit("("), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"), F.lit(") == "), "rhs")
    return df.withColumn("text", F.concat(F.lit("def test_"), "family", F.lit("():\n    assert "), call))


def literal_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FALLBACK_SQL = "CASE family " + " ".join(
    f"WHEN '{f}' THEN {literal_sql(FALLBACK_TESTS[f].strip())}" for f in FAMILIES
) + " END"
SHELL_SQL = literal_sql(
    "def test_twin():\n    # model could not produce a valid passing test yet\n    assert callable(twin)"
)


#: The pair's own test is right: two plain operands, no division by zero, no wrong value.
OWN_SQL = "(wrong = 0 AND true_text IS NOT NULL)"
OWN, TRUE_TEST = TEST_SQL.format("rhs"), TEST_SQL.format("true_text")


@query(PAIRS_SQL + f"""SELECT pair_id, '# Origin: Beams (multi-function)' || chr(10) ||
  'import pytest' || chr(10) || chr(10) || CASE WHEN {OWN_SQL} THEN {OWN}
    WHEN true_text IS NOT NULL AND pair_id % 4 = 3 THEN {TRUE_TEST} || chr(10) || 'assert ' || family || '(' || a || ', ' || b || ') == ' || true_text
    WHEN true_text IS NOT NULL AND pair_id % 4 = 1 THEN {TRUE_TEST} ELSE {FALLBACK_SQL} END
    || chr(10) || chr(10) || {SHELL_SQL} AS generated_tests FROM pairs""")
def q_choose_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two functions per submission. The first is offered its own test, which may be wrong,
    raise (division by zero) or be unverifiable; then, for some, a true one with a stray
    module-level assert beside one on the target, one calling a helper, or a true sample. The
    second function has no candidate."""
    df = test_of(pairs(spark, sf_dir))
    k = F.col("pair_id") % 4
    sources = df.select("pair_id", F.concat("input", F.lit(TWIN)).alias("code")).withColumn("facts", fx.extract_code_facts("code"))
    true = test_of(df.withColumn("rhs", F.col("true_text"))).filter(F.col("true_text").isNotNull()).select(
        "pair_id", F.col("family").alias("func_name"), "text", F.regexp_extract("text", r"(assert .*)", 1).alias("line")
    )
    own = df.select("pair_id", F.col("family").alias("func_name"), F.lit(0).alias("idx"), "text")
    stray = true.filter(k == 3).select("pair_id", "func_name", F.lit(1).alias("idx"), F.concat("text", F.lit("\n"), "line", F.lit("\nassert True")).alias("text"))
    helper = true.filter(k == 2).select("pair_id", "func_name", F.lit(2).alias("idx"), F.concat("text", F.lit("\n    assert helper(1) == 1")).alias("text"))
    samples = true.filter(k == 1).select("pair_id", "func_name", F.lit(0).alias("idx"), "text")
    chosen = choose_tests(functions(sources), union_stages(own.unionByName(stray).unionByName(helper), samples), ["pair_id"])
    return merge_by_submission(chosen, ["pair_id"])


def value_sql(x: str, y: str, more: int = 0) -> str:
    """Literal text of the family's value for two operands, plus ``more``."""
    return (
        f"CASE family WHEN 'add' THEN CAST({x} + {y} + {more} AS VARCHAR) WHEN 'subtract' THEN CAST({x} - {y} + {more} AS VARCHAR) "
        f"WHEN 'multiply' THEN CAST({x} * {y} + {more} AS VARCHAR) WHEN 'power' THEN CAST(CAST(pow({x}, {y}) AS BIGINT) + {more} AS VARCHAR) "
        f"WHEN 'divide' THEN {LITERAL_SQL.format(f'(CAST({x} AS DOUBLE) / {y} + {more})')} ELSE '0' END"
    )


def value_text(x: Column, y: Column, more: int = 0) -> Column:
    return (
        F.when(F.col("family") == "add", (x + y + more).cast("string")).when(F.col("family") == "subtract", (x - y + more).cast("string"))
        .when(F.col("family") == "multiply", (x * y + more).cast("string"))
        .when(F.col("family") == "power", (F.pow(x, y).cast("bigint") + more).cast("string"))
        .when(F.col("family") == "divide", format_literal(x.cast("double") / y + more)).otherwise("0")
    )


NEW_SQL = "'    assert ' || family || '(' || {x} || ', ' || {y} || ') == ' || {v}"
FIRST_SQL = NEW_SQL.format(x="(a + 31)", y="(b + 1)", v=value_sql("(a + 31)", "(b + 1)"))
SECOND_SQL = NEW_SQL.format(x="(a + 57)", y="(b + 2)", v=value_sql("(a + 57)", "(b + 2)"))


@query(PAIRS_SQL + f"""SELECT pair_id AS id, CASE WHEN pair_id % 2 = 0 AND family <> 'is_even' THEN
    '# Origin: Regen (sampling)' || chr(10) || 'import pytest' || chr(10) || chr(10) || 'def test_' || family || '():' || chr(10) ||
    {FIRST_SQL} || chr(10) || {SECOND_SQL}
  ELSE '# Origin: Regen (fallback - reused previous)' || chr(10) || {OWN} END AS generated_tests FROM pairs""")
def q_regenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item a near copy of its earlier test and a new test with a wrong value; for
    every second a really new one that holds (or, for the predicate, cannot be verified)."""
    df = test_of(pairs(spark, sf_dir)).withColumn("id", F.col("pair_id"))
    items = df.select("id", F.col("input").alias("source_code"), F.col("text").alias("generated_tests"))

    def fresh(more: int) -> Column:
        lines = [
            F.concat(F.lit("    assert "), "family", F.lit("("), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(") == "), value_text(x, y, m))
            for x, y, m in ((F.col("a") + 31, F.col("b") + 1, 0), (F.col("a") + 57, F.col("b") + 2, more))
        ]
        return F.concat(F.lit("def test_"), "family", F.lit("():\n"), lines[0], F.lit("\n"), lines[1])

    base = df.select("id", F.col("family").alias("func_name"), F.lit(2).alias("stage"), "text", fresh(10**10).alias("wrong_test"), fresh(0).alias("fresh"))
    copies = base.select("id", "func_name", "stage", F.lit(0).alias("idx"), F.concat("text", F.lit("  # again")).alias("text"))
    wrong = base.select("id", "func_name", "stage", F.lit(1).alias("idx"), F.col("wrong_test").alias("text"))
    new = base.filter("id % 2 = 0").select("id", "func_name", "stage", F.lit(2).alias("idx"), F.col("fresh").alias("text"))
    return regenerate(items, copies.unionByName(wrong).unionByName(new))
