"""Every registered query next to its SQL twin on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    verdict = compare(spark, con, name, SF)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_approximate_values_of_zero(spark, tmp_path):
    """Orders whose approximate value is zero (order 3333 of customer 0 and alike), and others."""
    orders = spark.range(12).select(
        (F.col("id") * 63 + 3333).alias("o_orderkey"), (F.col("id") % 2 * 20 + F.floor(F.col("id") / 6)).alias("o_custkey")
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    zero = db.execute("SELECT count(*) FROM orders WHERE 2 * (o_custkey % 20) + o_orderkey % 7 = 1 AND o_orderkey % 9 = 3").fetchone()[0]
    assert zero > 0
    assert compare(spark, db, "q_true_tests", str(tmp_path)) == "ok (12 rows)"


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["outcome", "reason", "n"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
