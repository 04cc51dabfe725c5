"""Writers and streams: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.operators.audit import audit_base
from pairforge.plans.corpus import audit_corpus
from pairforge.queries import query
from pairforge.queries.audit_queries import LINES_SQL, corpus_lines
from pairforge.queries.tables import PAIRS_SQL, pairs
from pairforge.session import scratch_path
from pairforge.sources.pairs import read_pairs
from pairforge.sources.sinks import OUTCOMES, write_exports, write_split
from pairforge.sources.training import read_training
from pairforge.streaming.audit import audit_stream, audited_stream, running_audit_counts, running_counts_state


def line_files(spark: SparkSession, sf_dir: str) -> str:
    """The corpus lines as text files; the folder's path."""
    path = scratch_path(spark, "lines")
    corpus_lines(spark, sf_dir).select(F.col("raw").alias("value")).write.text(path)
    return path


# Every line with what the base audit decides for it.
DECIDED_SQL = LINES_SQL + r""", decided AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS outcome FROM (
    SELECT *, CASE WHEN read_error IS NOT NULL THEN read_error WHEN in_text = '' THEN 'no_function'
        WHEN family <> 'is_even' AND true_text IS NULL THEN 'raises' END AS reason,
      CASE WHEN family <> 'is_even' THEN 'def test_' || family || '(): assert ' || family || '(' || a || ',' || b || ')' || eq || true_text
        ELSE output END AS fixed,
      CASE pair_id % 13 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '[1]' WHEN 3 THEN '{"input":5,"output":"x"}'
        WHEN 4 THEN '{"output":"' || output || '"}' WHEN 5 THEN ' ' || chr(9) WHEN 6 THEN '{"input":null,"output":"x"}'
        ELSE '{"input":"' || replace(input, chr(10), '\n') || '","output":"' || output || '","seen":' || a || '}' END AS raw
    FROM lines))
"""


@query(DECIDED_SQL + """SELECT outcome, reason, raw AS line, CAST(NULL AS VARCHAR) AS output, CAST(NULL AS BIGINT) AS seen
FROM decided WHERE outcome <> 'kept' UNION ALL SELECT outcome, reason, NULL, fixed, a FROM decided WHERE outcome = 'kept'""")
def q_write_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files a split writes: kept lines, re-serialised with their other keys, and the reasons."""
    out = scratch_path(spark, "split")
    audit_corpus(spark, line_files(spark, sf_dir), out)
    kept = spark.read.schema("output string, seen long").json(out + "/lines/outcome=kept")
    none = F.lit(None).cast("string")
    reasons = spark.read.schema("raw string, outcome string, reason string").parquet(out + "/reasons")
    return reasons.select("outcome", "reason", F.col("raw").alias("line"), none.alias("output"), F.lit(None).cast("long").alias("seen")).unionByName(
        kept.select(F.lit("kept").alias("outcome"), none.alias("reason"), none.alias("line"), "output", "seen")
    )


@query(DECIDED_SQL + """SELECT o.outcome, CAST(count(d.outcome) AS BIGINT) AS n
FROM (VALUES ('kept'), ('rejected'), ('quarantined')) o(outcome) LEFT JOIN decided d ON d.outcome = o.outcome GROUP BY o.outcome""")
def q_write_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each outcome, observed while the split is written."""
    totals = Observation("totals")
    write_split(audit_base(read_pairs(spark, line_files(spark, sf_dir))), scratch_path(spark, "split"), totals=totals)
    return spark.createDataFrame([(o, totals.get[o]) for o in OUTCOMES], "outcome string, n long")


@query(PAIRS_SQL + """SELECT pair_id AS id, CASE WHEN pair_id % 4 = 0 THEN 'tests_item_' || pair_id || '.py' ELSE 'test_' || family || '.py' END AS file_name,
  CASE WHEN pair_id % 4 = 0 THEN 'assert True' ELSE output END AS content FROM pairs WHERE pair_id % 4 < 2""")
def q_write_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported files read back; items with empty or no tests have none."""
    k = F.col("pair_id") % 4
    tests = F.when(k == 0, "assert True").when(k == 1, F.col("output")).when(k == 2, "")
    out = scratch_path(spark, "exports")
    write_exports(pairs(spark, sf_dir).select(F.col("pair_id").alias("id"), tests.alias("generated_tests")), out)
    return spark.read.schema("id long, file_name string, content string").parquet(out)


@query(DECIDED_SQL + "SELECT input, fixed AS output FROM decided WHERE outcome = 'kept'")
def q_training_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept lines as the training reader sees them."""
    out = scratch_path(spark, "split")
    audit_corpus(spark, line_files(spark, sf_dir), out)
    return read_training(spark, out + "/lines/outcome=kept")


@query(DECIDED_SQL + "SELECT outcome, reason, raw FROM decided")
def q_audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines audited two files at a time; each micro-batch writes its own folder."""
    out = scratch_path(spark, "stream")
    audit_stream(spark, line_files(spark, sf_dir), out, scratch_path(spark, "offsets"), max_files_per_trigger=2).awaitTermination()
    return spark.read.schema("raw string, reason string, value string, batch int, outcome string").parquet(out + "/audited").select(
        "outcome", "reason", "raw"
    )


@query(DECIDED_SQL + "SELECT outcome, coalesce(reason, '') AS reason, CAST(count(*) AS BIGINT) AS n FROM decided GROUP BY ALL")
def q_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the stream, read from its state store after it has stopped."""
    offsets = scratch_path(spark, "offsets")
    counts = running_audit_counts(audited_stream(spark, line_files(spark, sf_dir), max_files_per_trigger=2))
    counts.writeStream.outputMode("update").format("noop").option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return running_counts_state(spark, offsets)


@query(PAIRS_SQL + """SELECT pair_id, replace(output, family || '(' || a || ',' || b || ')', family || '(''' || a || ''',''' || b || ''')') AS text FROM pairs""")
def q_coerce_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers given to the target of a test become texts; the expected value stays a number."""
    return pairs(spark, sf_dir).select("pair_id", fx.numbers_to_text("output", "family").alias("text"))
