"""Audit fixtures: outcomes in both modes, the split on disk, and the stream."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pairforge.operators import audit as au
from pairforge.operators.audit import audit_base, audit_edge, audit_summary, partition_check
from pairforge.plans.corpus import audit_corpus, training_tables
from pairforge.sources.pairs import parse_pairs, read_pairs
from pairforge.sources.sinks import OUTCOMES, write_split
from pairforge.streaming.audit import audit_stream, audited_stream, running_audit_counts

ADD = "def add(a, b):\n    return a + b"
DIVIDE = "def divide(a, b):\n    return a / b"


def t(body, name="add"):
    return f"def test_{name}(): assert {body}"


# function, test, compat outcome and text, default outcome / reason or note, default text
BASE = {
    "right": (ADD, t("add(3,4)==7"), "kept", t("add(3,4)==7"), "ok", t("add(3,4)==7")),
    "wrong": (ADD, t("add(3,4)==9"), "kept", t("add(3,4)==7"), "corrected", t("add(3,4)==7")),
    "wrong_spaced": (ADD, t("add(3, 4) == 9"), "kept", t("add(3, 4) == 9"), "corrected", t("add(3, 4) == 7")),
    "raises": (DIVIDE, t("divide(1,0)==0"), "rejected", None, "raises", None),
    "import_above": ("import math\n" + ADD, t("add(1,2)==3"), "rejected", None, "forbidden_token", None),
    "import_inside": ("def add(a, b):\n    import os\n    return a + b", t("add(1,2) > 0"), "kept", t("add(1,2) > 0"), "forbidden_token", None),
    "decimals": (ADD, t("add(1.05,1)==2.05"), "rejected", None, "ok", t("add(1.05,1)==2.05")),
    "other_family": ("def is_even(n): return n % 2 == 0", "any text", "kept", "any text", "unchecked_family", "any text"),
    "no_function": ("x = 1", "any", "rejected", None, "no_function", None),
    "not_a_def": (ADD, "import pytest\n" + t("add(1,2)==3"), "rejected", None, "not_a_def", None),
    "rhs_name": (ADD, t("add(1,2)==expected"), "rejected", None, "rhs_not_allowed", None),
    "family_name": ("def add_tax(p, r):\n    return p * r", t("add_tax(10,2)==20"), "kept", t("add_tax(10,2)==20"), "ok", t("add_tax(10,2)==20")),
    "floats": (ADD, t("add(3.0,4)==7.0"), "kept", t("add(3.0,4)==7"), "corrected", t("add(3.0,4)==7")),
    "other_name": (ADD, t("padd(1,2)==9"), "kept", t("padd(1,2)==3"), "no_pairs", t("padd(1,2)==9")),
    "helper": ("def add(a, b):\n    return helper(a, b)", t("add(1,2)==3"), None, None, "unverifiable", None),
    "two_functions": (ADD + "\ndef g(): pass", t("add(1,2)==3"), "rejected", None, "not_single_function", None),
    "bad_indent": ("def add(a, b):\nreturn a + b", t("add(1,2)==3"), "rejected", None, "not_single_function", None),
    "prefix_value": (ADD, t("add(1,2)==3; assert add(1,1)==3; assert add(0,3)==35"), "kept", None, "corrected",
                     t("add(1,2)==3; assert add(1,1)==2; assert add(0,3)==3")),
    "too_few_arguments": (ADD, t("add(1)==3"), "rejected", None, "raises", None),
    "leading_zero": (ADD, t("add(1,2)==3 and 05"), "rejected", None, "leading_zero", None),
    "annotated": ('def add(a: int, b: int) -> int:\n    """Sum."""\n    return (a + b)', t("add(1,2)==4"), "kept", None, "corrected", t("add(1,2)==3")),
}


def frame(spark, cases):
    rows = [(k, c[0], c[1]) for k, c in cases.items()]
    return spark.createDataFrame(rows, "k string, input string, output string")


def test_base_default(spark):
    got = {r["k"]: r for r in audit_base(frame(spark, BASE)).collect()}
    for k, case in BASE.items():
        verdict, text = case[4], case[5]
        row = got[k]
        assert (row["reason"] or row["note"]) == verdict, (k, row)
        assert row["outcome"] == ("quarantined" if verdict == "unverifiable" else "rejected" if row["reason"] else "kept")
        if text is not None:
            assert row["output"] == text, k


def test_base_compat(spark):
    got = {r["k"]: r for r in audit_base(frame(spark, BASE), mode="compat").collect()}
    for k, case in BASE.items():
        if case[2] is not None:
            assert got[k]["outcome"] == case[2], (k, got[k])
        if case[3] is not None:
            assert got[k]["output"] == case[3], k


TEST = "def test_add():\n    assert add(1, 2) == 3"
EDGE = {
    "kept": (ADD, TEST, None),
    "raises_only": (DIVIDE, "import pytest\ndef test_d():\n    with pytest.raises(ZeroDivisionError):\n        divide(1, 0)", None),
    "nested": (ADD, "class T:\n    def test_x(self):\n        assert add", None),
    "null_output": (ADD, None, "empty_field"),
    "class_only": ("class A: pass", TEST, "no_function"),
    "async_only": ("async def add(a): pass", TEST, "no_function"),
    "bad_function": ("def add(", TEST, "no_function"),
    "bad_test": (ADD, "def test_add(:", "test_syntax"),
    "no_test": (ADD, "def check():\n    assert add(1, 2)", "no_test_function"),
    "no_assert": (ADD, "def test_add():\n    add(1, 2)", "no_check"),
    "other_target": (ADD, "def test_add():\n    assert other(1)", "no_reference"),
}


def test_edge(spark):
    got = {r["k"]: r["reason"] for r in audit_edge(frame(spark, EDGE)).collect()}
    assert got == {k: c[2] for k, c in EDGE.items()}


BAD_LINES = ["", "   ", "{bad", "[1]", "5", "null", '{"input": 5}', '{"output": "x"}']


@pytest.fixture()
def corpus(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    lines = [
        json.dumps({"id": i, "input": c[0], "output": c[1], "note": "naïve ✓", "nested": {"a": [1, None]}}, ensure_ascii=False)
        for i, c in enumerate(BASE.values())
    ]
    (folder / "a.jsonl").write_text("\n".join(lines[:10] + BAD_LINES) + "\n", encoding="utf-8")
    (folder / "b.jsonl").write_text("\n".join(lines[10:]) + "\n", encoding="utf-8")
    return str(folder)


def test_read_errors(spark, corpus):
    got = {r["raw"]: r["read_error"] for r in read_pairs(spark, corpus).collect()}
    want = ["blank_line", "blank_line", "bad_json", "not_an_object", "not_an_object", "not_an_object", "bad_type", None]
    assert [got[line] for line in BAD_LINES] == want


def test_split_round_trip(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    audited = audit_corpus(spark, corpus, out)
    lines = spark.read.text(out + "/lines")
    kept = [json.loads(r["value"]) for r in lines.filter("outcome = 'kept'").collect()]
    cases = list(BASE.values())
    assert {k["id"] for k in kept} == {i for i, c in enumerate(cases) if c[5] is not None}
    for k in kept:
        assert k["output"] == cases[k["id"]][5] and k["note"] == "naïve ✓" and k["nested"] == {"a": [1, None]}
    source = read_pairs(spark, corpus).select("raw")
    rejected = lines.filter("outcome <> 'kept'").select(F.col("value").alias("raw"))
    kept_raw = audited.filter("outcome = 'kept'").select("raw")
    assert partition_check(source, kept_raw, rejected).isEmpty()
    assert spark.read.parquet(out + "/reasons").count() == rejected.count()


def test_totals_observed_on_the_write(spark, corpus, tmp_path):
    totals = Observation("t")
    audited = write_split(audit_base(read_pairs(spark, corpus)), str(tmp_path / "o"), totals=totals)
    counted = {r["outcome"]: r["n"] for r in audit_summary(audited).groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert {o: n for o, n in totals.get.items() if n} == counted and set(totals.get) == set(OUTCOMES)
    empty = Observation("e")
    write_split(audit_base(read_pairs(spark, corpus)).limit(0), str(tmp_path / "e"), totals=empty)
    assert set(empty.get.values()) <= {0}


def test_stream_equals_batch(spark, corpus, tmp_path):
    out, checkpoint = str(tmp_path / "stream"), str(tmp_path / "checkpoint")
    audit_stream(spark, corpus, out, checkpoint, max_files_per_trigger=1).awaitTermination()
    assert sorted(os.listdir(out + "/lines")) == ["batch=0", "batch=1"]
    streamed = spark.read.text(out + "/lines").select("value").collect()
    batch_out = str(tmp_path / "batch")
    audit_corpus(spark, corpus, batch_out)
    batch = spark.read.text(batch_out + "/lines").select("value").collect()
    assert sorted(r["value"] for r in streamed) == sorted(r["value"] for r in batch)
    # Nothing new: a second run writes nothing.
    audit_stream(spark, corpus, out, checkpoint).awaitTermination()
    assert len(os.listdir(out + "/lines")) == 2


def test_running_counts(spark, corpus, tmp_path):
    counts = running_audit_counts(audited_stream(spark, corpus, kind="edge"))
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("live_counts")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    live = {(r["outcome"], r["reason"]): r["n"] for r in spark.table("live_counts").collect()}
    batch = audit_edge(read_pairs(spark, corpus)).groupBy("outcome", F.coalesce("reason", F.lit(""))).count().collect()
    assert live == {(r[0], r[1]): r[2] for r in batch}


def test_result_does_not_depend_on_partitioning(spark):
    df = frame(spark, BASE)
    a = sorted(map(tuple, audit_base(df.repartition(1)).select("k", "outcome", "reason", "output").collect()), key=str)
    b = sorted(map(tuple, audit_base(df.repartition(7)).select("k", "outcome", "reason", "output").collect()), key=str)
    assert a == b


def test_training_tables(spark, corpus, tmp_path):
    out, tables = str(tmp_path / "o"), str(tmp_path / "t")
    audit_corpus(spark, corpus, out)
    training_tables(spark, out + "/lines/outcome=kept", tables, exact=True)
    got = spark.read.parquet(tables)
    assert set(got.columns) == {"prompt", "prompt_tokens", "label", "label_tokens", "split"}
    n = spark.read.text(out + "/lines/outcome=kept").count()
    assert got.count() == n and got.filter("split = 'eval'").count() == -(-n // 10)


def test_parse_pairs_keeps_types(spark):
    df = spark.createDataFrame([('{"input":"a","output":"b","n":1,"f":2.5,"z":null}',)], "raw string")
    row = parse_pairs(df).select(F.to_json("extra").alias("j")).first()
    assert json.loads(row["j"]) == {"input": "a", "output": "b", "n": 1, "f": 2.5, "z": None}


def test_a_test_is_searched_once_for_its_pairs(spark):
    """F8: one search with the pattern of the name gives heads, arguments and values, whatever the text."""
    import re

    tests = [
        "assert add(1,2)==3; assert add( 4 , 5 )  ==  9 and xadd(1)==2", "assert add(add(1,2)==3, 4) == 5", "add()==1 add(\n1,\n2)\n==\n3;",
        "add(1)== ;add(2)==(3)==4 add(5)==add(6)==7", "", "nothing here", "add(1) = 2; add (1)==2; add(2)==é x", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "i long, t string").withColumn("n", F.lit("add"))
    found = rows.select("i", au.assert_pairs("t", "n").alias("p"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    space = r"[ \t\n\x0b\f\r]"  # Java's \s
    pattern = re.compile(rf"((?<!\w)add\(([^)]*)\){space}*=={space}*)([^ \t\n\x0b\f\r;]+)")
    got = {r.i: None if r.p is None else [tuple(p) for p in r.p] for r in found.collect()}
    assert got == {i: None if t is None else pattern.findall(t) and [m[:3] for m in pattern.findall(t)] for i, t in enumerate(tests)}


def test_verdicts_of_odd_arguments(spark):
    """Operands are placed once for a function; blank, missing, strange and long arguments are judged as before."""
    source = "def sub(a, b):\n    return b - a"
    calls = {
        "sub(1,2)==1": ("ok", "1"), "sub( -3 ,\t4.5)==1": ("corrected", "7.5"), "sub()==1": ("raises", None), "sub( )==1": ("raises", None),
        "sub(1)==1": ("raises", None), "sub(1,)==1": ("unverifiable", None), "sub(1,2,3)==1": ("raises", None), "sub(a=1)==1": ("unverifiable", None),
        "sub(x,2)==1": ("unverifiable", None), "sub(007,1)==1": ("unverifiable", None), "sub(00,+1)==1": ("ok", "1"),
        f"sub(1,{10**30})==1": ("corrected", str(10**30 - 1)), f"sub(1,{10**40})==1": ("unverifiable", None),
        f"sub(-1,{2**63 - 1})==1": ("corrected", str(2**63)), "sub(.5,1e3)==999.5": ("ok", "999.5"),
    }
    rows = spark.createDataFrame([(c, source) for c in calls], "t string, f string").withColumn("n", F.lit("sub"))
    judged = rows.select("t", F.explode(au.verify_pairs(au.assert_pairs("t", "n"), au.closed_form_of("f"))).alias("p"))
    assert {r.t: (r.p.status, r.p.value) for r in judged.collect()} == calls
    none = rows.select(F.explode(au.verify_pairs(au.assert_pairs("t", "n"), au.closed_form_of("n"))).alias("p")).collect()
    assert len(none) == len(calls) and {(r.p.status, r.p.value) for r in none} == {("unverifiable", None)}
