"""Rows of a small scan meet all cores."""

from pairforge.queries.tables import pairs
from pairforge.session import spread


def test_pairs_of_one_file_are_spread_over_the_cores(spark, tmp_path):
    """F8: a table of one file was one task, whatever the cluster."""
    spark.range(1000).selectExpr("id o_orderkey", "id % 50 o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    set_to = spark.conf.get("pairforge.spread", None)
    spark.conf.unset("pairforge.spread")
    try:
        df = pairs(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        assert df.count() == 1000 and df.agg({"pair_id": "sum"}).first()[0] == 499_500
        whole = spark.read.parquet(f"{tmp_path}/orders.parquet")
        assert spread(whole).rdd.getNumPartitions() == whole.rdd.getNumPartitions() == 1  # wide rows stay
    finally:
        if set_to is not None:
            spark.conf.set("pairforge.spread", set_to)
