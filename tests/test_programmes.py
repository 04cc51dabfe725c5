"""Programmes of arithmetic functions against the functions themselves."""

import random

import pytest
from pyspark.sql import functions as F

from pairforge.functions.programmes import BITS, evaluate
from pairforge.operators.audit import audit_base

MIXED = '''def mixed(a, b=2, *, c=3):
    """Several operations."""
    t: float = a * b
    t += c
    return -t // b + a % c - abs(b) ** 2'''


def values(source, *texts):
    return [v["exact"] if v["status"] == "ok" else v["status"] for v in evaluate(source, [list(texts)])[0]]


def test_values_equal_those_of_the_function():
    names = {}
    exec(MIXED, names)  # a fixed function of this test
    rnd, calls, want = random.Random(7), [], []
    for _ in range(500):
        a, b, c = (rnd.choice([rnd.randint(-9, 9), rnd.randint(-10**30, 10**30), round(rnd.uniform(-5, 5), 3)]) for _ in range(3))
        call = rnd.choice([f"mixed({a}, {b}, c={c})", f"mixed(b={b}, a={a})", f"mixed({a})", f"2 * mixed({a}, c={c}) - 1"])
        calls.append(call)
        try:
            want.append(repr(eval(call, names)))
        except ArithmeticError:
            want.append("raises")
    assert values(MIXED, *calls) == want
    assert "raises" in want and len(set(want)) > 300


def test_arguments_must_fit():
    assert values(MIXED, "mixed()", "mixed(1, 2, 3)", "mixed(1, a=2)", "mixed(1, d=2)", "mixed(*[1])", "other(1)") == [
        "raises", "raises", "raises", "raises", "open", "open"
    ]


@pytest.mark.parametrize("body", [
    "return x", "return a < b", "return [a]", "return helper(a)", "pass", "for i in a: pass\n    return a", "return f(a, b)", "return a.real",
])
def test_what_is_no_arithmetic_stays_open(body):
    assert values(f"def f(a, b):\n    {body}", "f(1, 2)") == ["open"]


def test_limits():
    power = "def power(a, b):\n    return a ** b"
    assert values(power, "power(99, 20)") == [str(99**20)]
    assert values(power, "power(2, 10**9)", f"power(2, {BITS + 1})", "power(-8, 0.5)") == ["open"] * 3
    assert values(power, "power(0, -1)", "power(2.0, 10**5)") == ["raises"] * 2
    deep = "def f(a):\n    return " + "-" * 5_000 + "a"
    assert values(deep, "f(1)") in (["open"], ["1"])
    assert evaluate("not python", [[None, "1"], []]) == [[None, {"status": "open", "value": None, "exact": None, "near": False}], []]


def test_audit_settles_what_the_closed_form_leaves_open(spark):
    three = "def add(a, b, c=1):\n    return a + b + c"
    rows = [
        (0, three, "def test_add(): assert add(1, 2) == 4", "kept", None),
        (1, three, "def test_add(): assert add(1, c=5, b=2) == 4; assert add(1, 2, 3) == 6", "kept", 8),
        (2, three, "def test_add(): assert add(1) == 4", "rejected", None),
        (3, "def power(a, b):\n    return a ** b", f"def test_power(): assert power(99, 20) == {99**20}", "kept", None),
        (4, "def add(a, b):\n    return [a, b]", "def test_add(): assert add(1, 2) == 3", "quarantined", None),
        (5, None, "def test_add(): assert add(1, 2) == 3", "rejected", None),
        (6, three, "", "rejected", None),
        (7, three, None, "rejected", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, input string, output string")
    got = {r.id: r for r in audit_base(df).select("id", "outcome", F.col("output").alias("text")).collect()}
    for i, _, test, outcome, corrected in rows:
        assert i in (6, 7) or got[i].outcome == outcome, i
        if corrected:
            assert got[i].text == test.replace("b=2) == 4", f"b=2) == {corrected}")
    assert len(got) == len(rows)
