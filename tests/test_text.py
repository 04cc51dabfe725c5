"""Cleaning columns against plain Python on awkward text."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairforge.functions import literals as lt
from pairforge.functions import text as tx

AWKWARD = [
    "", " ", "\n", "a\r\nb\rc\n", "\u00a0 x \u2003", "a\x1cb\x85c", "x\n\n\n\ny", "\tdef f():\n\t\tpass", "# c\n\n  A  b\n#d\nE",
    "\ufeff\u200bdef test_a():\n  ‘q’ “r”\x07", "one\ntwo\n", "é\u200dü", "def test_a(): x\ndef test_b(): y", 'a\\qb\\n\\\\c',
]


def column(spark, values, fn, *more):
    rows = [(i, v, *m) for i, (v, *m) in enumerate(zip(values, *more))]
    names = ["i", "t"] + [f"m{k}" for k in range(len(more))]
    df = spark.createDataFrame(rows, ", ".join(["i int"] + [f"{n} string" for n in names[1:]]))
    out = df.select("i", fn.alias("v")).collect()
    return [r["v"] for r in sorted(out, key=lambda r: r["i"])]


def py_key(text):
    lines = [s for s in (line.strip() for line in text.splitlines()) if s and not s.startswith("#")]
    return re.sub(r"\s+", " ", " ".join(lines)).lower().strip()


def test_strip_and_lines_follow_python(spark):
    assert column(spark, AWKWARD, tx.strip("t")) == [s.strip() for s in AWKWARD]
    got = column(spark, AWKWARD, F.array_join(tx.split_lines("t"), "|"))
    assert got == ["|".join(s.splitlines()) for s in AWKWARD]


def test_similarity_key_follows_python(spark):
    assert column(spark, AWKWARD, tx.similarity_key("t")) == [py_key(s) for s in AWKWARD]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r#aB'\"\\\u00a0\u2028\x0b", max_size=40), min_size=20, max_size=40))
def test_similarity_key_property(spark, texts):
    assert column(spark, texts, tx.similarity_key("t")) == [py_key(s) for s in texts]


def test_invisible_characters(spark):
    text = "\ufeff\u200b\u00a0def test_a():\r\n\tassert ‘a’ == “b”\u200b\x07"
    lead = column(spark, [text], tx.strip_leading_invisible("t"))[0]
    assert lead == text.lstrip("\ufeff\u200b\u00a0")
    assert column(spark, [text], tx.strip_control(tx.normalize_newlines("t")))[0] == "\u00a0def test_a():\n\tassert ‘a’ == “b”"
    assert column(spark, [text], tx.clean_layout("t", F.lit("a")))[0] == "def test_a():\nassert 'a' == \"b\""


def test_unwrap_quotes(spark):
    cases = {'"abc"': "abc", "'x'": "x", '\\"y\\"': "y", '"': "", '"a': '"a', '"\\"z\\""': "z", "a\\nb\\tc": "a\nb\tc"}
    assert column(spark, list(cases), tx.unwrap_quotes("t")) == list(cases.values())


def test_header_rules(spark):
    block = "x\ndef test_a():\n  1\n  def test_b(): pass\nend\ndef test_c(): 2"
    assert column(spark, [block], tx.keep_first_header("t"))[0] == "x\ndef test_a():\n  1\nend"
    assert column(spark, [block], tx.drop_before("t"))[0] == block[2:]
    assert column(spark, ["no header"], tx.drop_before("t"))[0] == "no header"
    assert column(spark, [block], tx.rename_first_test("t", F.lit("z")))[0] == block.replace("def test_a(", "def test_z(")


def test_escape_stray_backslash(spark):
    cases = [r"\C", r"\n", r"\\C", r"a\.b\qc", "\\"]
    want = [re.sub(r"(?<!\\)\\([^\\nrtbf'\"\\])", r"\\\\\1", s) for s in cases]
    assert column(spark, cases, tx.escape_stray_backslash("t")) == want


def test_wrap_as_test(spark):
    cases = ["assert a\n\n  assert b", "def f(): pass", "  x"]
    want = ["def test_q():\n    assert a\n\n      assert b\n", "def f(): pass", "def test_q():\n    x\n"]
    assert column(spark, cases, tx.wrap_as_test("t", F.lit("q"))) == want


def test_collapse_space_keeps_blocks_apart_from_parity(spark):
    text = "def t():\n    if  a:\n\n\n\n        b   = 1  "
    assert column(spark, [text], tx.collapse_space("t"))[0] == "def t():\n    if a:\n\n        b = 1"
    assert column(spark, [text], tx.collapse_space("t", preserve_indent=False))[0] == "def t():\n if a:\n\n b = 1"


def test_standardize(spark):
    raw = "  def  test_Foo (x):\n    assert   ADD  (1)== Add(2)\ndef test_two(): pass"
    got = column(spark, [raw], tx.standardize_test("t", F.lit("add")))[0]
    assert got == "def test_add(x):\n    assert add(1) == add(2)\ndef test_two(): pass"


def test_names(spark):
    assert column(spark, ["def a_b(x): pass", "y = 2", "???"], tx.function_name_or_default("t")) == ["a_b", "y", "generated"]
    assert column(spark, ["add_tax", "add", "is_even"], tx.family_of("t")) == ["add", "add", "is"]
    assert column(spark, ["x", "def test_q1(): 0"], tx.export_name("t", F.lit(7))) == ["tests_item_7.py", "test_q1.py"]


def py_literal(x):
    if math.isnan(x):
        return "float('nan')"
    if math.isinf(x):
        return "float('inf')" if x > 0 else "float('-inf')"
    if x == 0:
        return "0.0"
    text = f"{x:.10f}".rstrip("0").rstrip(".")
    return str(int(round(float(text)))) if float(text).is_integer() else text


def test_format_literal(spark):
    values = [1e6 + 1 / 3, 123456789.123456789, -2.00048828125, 0.99999999996, 41.99999999999, 0.12345678905, 0.12345678915, 9007199254740991.0, 2.0**60 + 2**20,
              0.0, -0.0, 1.0, 2.5, -3.25, 1 / 3, 1e-12, -1e-12, 1e15, 0.125, 2**-11, 3 * 2**-11, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r["v"] for r in df.select("i", lt.format_literal("x").alias("v")).orderBy("i").collect()]
    assert got == [py_literal(v) for v in values]


NUMBERS = [0, 1, -1, 2, 7, -7, 3, -3, 10**12, 0.5, -0.5, 2.0, -2.5, 1e300, 0.0]


@pytest.mark.parametrize("op", ["+", "-", "*", "/", "//", "**"])
def test_closed_form_follows_python(spark, op):
    rows = [(repr(a), repr(b)) for a in NUMBERS for b in NUMBERS]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select("a", "b", lt.closed_form(F.lit(op), lt.number(F.col("a")), lt.number(F.col("b"))).alias("r")).collect()
    for row in out:
        known, raises, text = row["r"]
        if op == "**" and abs(float(row["b"])) > 1000 and "." not in row["a"] + row["b"]:
            continue  # Python would compute an integer of astronomic size
        try:
            value = eval(f"({row['a']}) {op} ({row['b']})")  # noqa: S307 - literals of this test
        except (ZeroDivisionError, OverflowError):
            assert raises, row
            continue
        assert not raises, row
        if known:
            want = py_literal(value) if isinstance(value, float) else repr(value)
            assert text == want, (row, want)


def test_is_close_and_compare(spark):
    values = [1.0, 1.0 + 1e-10, 1.1, float("nan"), float("inf"), -float("inf"), 0.0, 1e-10]
    rows = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(rows, "a double, b double")
    ops = ["==", "!=", "<", "<=", ">", ">="]
    cols = [lt.compare_close(F.col("a"), F.col("b"), op).alias(f"c{i}") for i, op in enumerate(ops)]
    for row in df.select("a", "b", *cols).collect():
        a, b = row["a"], row["b"]
        close = math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
        want = [close, not close, a < b and not close, a <= b or close, a > b and not close, a >= b or close]
        assert [row[f"c{i}"] for i in range(6)] == want, row


def test_exact_duplicates(spark):
    from pairforge.operators.similarity import exact_duplicates

    rows = [(1, "def test_a():\n    # why\n    assert a(1) == 2"), (2, "def test_a():\n\tassert  A(1) == 2\n"), (3, "def test_a(): assert a(1) == 3"),
            (4, None), (5, "# only a comment"), (6, ""), (7, "DEF TEST_A(): assert a(1) == 3"), (7, "def test_a(): assert a(1) == 3"), (None, "x"), (8, "x")]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({c: F.lit("own") for c in ("copies", "representative")})
    got = sorted((r.id or 0, r.representative, r.copies) for r in exact_duplicates(df).collect())
    assert got == [(0, 8, 2), (1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 3, 3), (7, 3, 3), (8, 8, 2)]
    assert exact_duplicates(df.where("1 = 0")).collect() == []
