"""Reading, auditing, verifying and summarising pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions import rules as rl
from pairforge.functions.maps import json_set, merge_meta
from pairforge.functions.text import def_name, def_names
from pairforge.operators import audit as au
from pairforge.operators.candidates import gate_candidates, with_forms
from pairforge.operators.compare import asserts_hold
from pairforge.queries import query
from pairforge.queries.tables import PAIRS_SQL, pairs, table
from pairforge.session import written
from pairforge.sources.pairs import parse_pairs


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as JSON lines, with every kind of bad line mixed in."""
    k = F.col("pair_id") % 13
    line = F.to_json(F.struct("input", "output", F.col("a").alias("seen")))
    raw = (
        F.when(k == 0, "").when(k == 1, "{bad").when(k == 2, "[1]").when(k == 3, '{"input":5,"output":"x"}')
        .when(k == 4, F.to_json(F.struct("output"))).when(k == 5, " \t").when(k == 6, '{"input":null,"output":"x"}')
        .otherwise(line)
    )
    return pairs(spark, sf_dir).select("pair_id", raw.alias("raw"))


LINES_SQL = PAIRS_SQL + """, lines AS (
  SELECT *, CASE pair_id % 13 WHEN 0 THEN 'blank_line' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'bad_type'
    WHEN 5 THEN 'blank_line' END AS read_error,
    CASE WHEN pair_id % 13 IN (0, 1, 2, 3, 5) THEN NULL WHEN pair_id % 13 IN (4, 6) THEN '' ELSE input END AS in_text,
    CASE WHEN pair_id % 13 IN (0, 1, 2, 3, 5) THEN NULL WHEN pair_id % 13 = 6 THEN 'x' ELSE output END AS out_text
  FROM pairs)
"""


@query(LINES_SQL + "SELECT pair_id, read_error, in_text AS input, out_text AS output FROM lines")
def q_read_pairs_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pairs(corpus_lines(spark, sf_dir)).select("pair_id", "read_error", "input", "output")


# What the base audit decides for a pair, by arithmetic in SQL.
AUDITED_SQL = PAIRS_SQL + """, audited AS (
  SELECT *, CASE WHEN family = 'is_even' THEN NULL WHEN true_text IS NULL THEN 'raises' END AS reason,
    CASE WHEN family <> 'is_even' AND true_text IS NOT NULL
      THEN 'def test_' || family || '(): assert ' || family || '(' || a || ',' || b || ')' || eq || true_text ELSE output END AS fixed,
    CASE WHEN family = 'is_even' THEN 'unchecked_family' WHEN true_text IS NULL THEN NULL
      WHEN true_text = rhs THEN 'ok' ELSE 'corrected' END AS note
  FROM pairs)
"""


@query(AUDITED_SQL + """SELECT pair_id, CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS outcome, reason, note,
  fixed AS output FROM audited""")
def q_audit_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.audit_base(pairs(spark, sf_dir)).select("pair_id", "outcome", "reason", "note", "output")


@query(AUDITED_SQL + r"""SELECT pair_id,
  CASE WHEN family = 'is_even' THEN 'kept' WHEN reason IS NOT NULL THEN 'rejected'
    WHEN regexp_matches(compat, '(^|[^0-9])0[0-9]+') THEN 'rejected' ELSE 'kept' END AS outcome,
  CASE WHEN family = 'is_even' THEN NULL WHEN reason IS NOT NULL THEN reason
    WHEN regexp_matches(compat, '(^|[^0-9])0[0-9]+') THEN 'leading_zero' END AS reason,
  CASE WHEN family = 'is_even' OR reason IS NOT NULL OR regexp_matches(compat, '(^|[^0-9])0[0-9]+') THEN output ELSE compat END AS output
FROM (SELECT *, CASE WHEN eq = '==' THEN fixed ELSE output END AS compat FROM audited)""")
def q_audit_base_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.audit_base(pairs(spark, sf_dir), mode="compat").select("pair_id", "outcome", "reason", "output")


# Edge variants: the test loses its name, its check, its target, its syntax, or its text.
EDGE_SQL = PAIRS_SQL + """, edge AS (SELECT pair_id, CASE pair_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'empty_field' WHEN 2 THEN 'no_function'
  WHEN 3 THEN 'test_syntax' WHEN 4 THEN 'no_test_function' WHEN 5 THEN 'no_check' WHEN 6 THEN 'no_reference' END AS reason FROM pairs)
"""


def edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 9
    header = F.concat(F.lit("def test_"), "family", F.lit("():\n    "))
    call = F.concat("family", F.lit("("), F.col("a").cast("string"), F.lit(", 0)"))
    output = (
        F.when(k == 1, " ").when(k == 3, F.concat("output", F.lit(" +")))
        .when(k == 4, F.concat(F.lit("assert "), call))
        .when(k == 5, F.concat(header, call))
        .when(k == 6, F.concat(header, F.lit("assert other(1) == 1")))
        .when(k == 7, F.concat(F.lit("import pytest\n"), header, F.lit("with pytest.raises(ZeroDivisionError):\n        "), call))
        .otherwise(F.col("output"))
    )
    source = F.when(k == 2, F.concat(F.lit("class A:\n  x = 1\n# "), "family")).otherwise(F.col("input"))
    return pairs(spark, sf_dir).withColumns({"input": source, "output": output})


@query(EDGE_SQL + "SELECT pair_id, CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS outcome, reason FROM edge")
def q_audit_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.audit_edge(edge_pairs(spark, sf_dir)).select("pair_id", "outcome", "reason")


@query(LINES_SQL + """, judged AS (SELECT CASE WHEN read_error IS NOT NULL THEN read_error WHEN in_text = '' THEN 'no_function'
    WHEN family <> 'is_even' AND true_text IS NULL THEN 'raises' END AS reason FROM lines)
SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS outcome, reason, CAST(count(*) AS BIGINT) AS n
FROM judged GROUP BY ALL""")
def q_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.audit_summary(au.audit_base(parse_pairs(corpus_lines(spark, sf_dir))))


@query(LINES_SQL + """SELECT pair_id, CAST(1 AS BIGINT) AS balance FROM lines
WHERE read_error IS NULL AND in_text <> '' AND family <> 'is_even' AND true_text IS NULL""")
def q_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that forgets the raising pairs: exactly those are reported. The audit is written
    once; the check reads the table."""
    lines = corpus_lines(spark, sf_dir)
    audited = written(au.audit_base(parse_pairs(lines)).select("pair_id", "raw", "outcome", "reason"), "audited")
    kept = audited.filter("outcome = 'kept'").select("pair_id", "raw")
    rest = audited.filter("outcome <> 'kept' AND reason <> 'raises'").select("pair_id", "raw")
    return au.partition_check(lines, kept, rest).select("pair_id", "balance")


# --- pieces of the audit ------------------------------------------------------------


@query(PAIRS_SQL + """SELECT pair_id, CAST(0 AS INTEGER) AS pos, a || ',' || b AS args, rhs FROM pairs
UNION ALL SELECT pair_id, 1, b || ', 7', '-1' FROM pairs""")
def q_assert_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat(
        "output", F.lit("; assert "), "family", F.lit("("), F.col("b").cast("string"), F.lit(", 7) == -1; assert x"),
        "family", F.lit("(1)==2"),
    )
    found = F.posexplode(au.assert_pairs(more, "family")).alias("pos", "p")
    return pairs(spark, sf_dir).select("pair_id", found).select("pair_id", "pos", "p.args", "p.rhs")


@query(PAIRS_SQL + """SELECT pair_id, CASE WHEN family = 'is_even' THEN 'unverifiable' WHEN true_text IS NULL THEN 'raises'
  WHEN true_text = rhs THEN 'ok' ELSE 'corrected' END AS status, true_text AS value FROM pairs
UNION ALL SELECT pair_id, CASE WHEN wrong = 0 THEN 'ok' ELSE 'corrected' END, CAST(value AS VARCHAR) FROM (
  SELECT pair_id, wrong, CASE family WHEN 'add' THEN CAST(10000000000000000000 + a AS HUGEINT) + b WHEN 'subtract' THEN CAST(10000000000000000000 + a AS HUGEINT) - b
    WHEN 'multiply' THEN CAST(10000000000000000000 + a AS HUGEINT) * b WHEN 'power' THEN CAST(1 AS HUGEINT) << CAST(60 + b AS INT) END AS value FROM pairs)
WHERE value IS NOT NULL""")
def q_verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair as it is, and with integers beyond 64 bits."""
    checked = au.verify_pairs(au.assert_pairs("output", "family"), au.closed_form_of("input"))
    df = pairs(spark, sf_dir)
    x, y = (F.lit(str(10**19)).cast("decimal(38,0)") + F.col("a")).cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")
    value = F.when(F.col("family") == "add", (x + y).cast("string")).when(F.col("family") == "subtract", (x - y).cast("string")).when(
        F.col("family") == "multiply", (x * y).cast("decimal(38,0)").cast("string")
    ).when(F.col("family") == "power", (F.lit(str(2**60)).cast("decimal(38,0)") * F.pow(F.lit(2.0), "b").cast("decimal(10,0)")).cast("decimal(38,0)").cast("string"))
    args = F.when(F.col("family") == "power", F.concat(F.lit("2, "), (60 + F.col("b")).cast("string"))).otherwise(
        F.concat(x.cast("string"), F.lit(", "), y.cast("string"))
    )
    said = F.when(F.col("pair_id") % 5 == 0, "5").otherwise(value)
    wide = df.filter(value.isNotNull()).withColumn("output", F.concat(F.lit("assert "), "family", F.lit("("), args, F.lit(") == "), said))
    return df.unionByName(wide).select("pair_id", F.explode(checked).alias("p")).select("pair_id", "p.status", "p.value")


@query(PAIRS_SQL + """SELECT pair_id, 'assert ' || family || '(1,2)==7; assert ' || family || '(' || a || ', ' || b || ')  ==  8 # ' ||
  family || '(x)' AS test FROM pairs""")
def q_rewrite_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.concat(
        F.lit("assert "), "family", F.lit("(1,2)==3; assert "), "family", F.lit("("), F.col("a").cast("string"), F.lit(", "),
        F.col("b").cast("string"), F.lit(")  ==  35 # "), "family", F.lit("(x)"),
    )
    df = pairs(spark, sf_dir).withColumn("test", test).withColumn("found", au.assert_pairs("test", "family"))
    heads = F.transform("found", lambda p: p["head"])
    return df.select(
        "pair_id", au.rewrite_rhs(F.col("test"), F.col("family"), heads, F.array(F.lit("7"), F.lit("8"))).alias("test")
    )


@query("""SELECT 'document' AS kind, doc_id AS id, contains(text, '__') OR contains(text, 'import ') OR contains(text, ';') AS forbidden FROM documents
UNION ALL SELECT 'order', o_orderkey, o_orderkey % 3 <> 0 FROM orders""")
def q_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 3
    source = F.when(k == 1, F.concat(F.lit("import os\n"), "input")).when(k == 2, F.concat("input", F.lit("; x"))).otherwise(F.col("input"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    code = pairs(spark, sf_dir).select(F.lit("order").alias("kind"), F.col("pair_id").alias("id"), source.alias("t"))
    return docs.unionByName(code).select("kind", "id", rl.has_forbidden_tokens("t").alias("forbidden"))


@query(PAIRS_SQL + "SELECT pair_id, pair_id % 3 = 0 AS single FROM pairs")
def q_single_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 3
    source = F.when(k == 1, F.concat("input", F.lit("\nx = 1"))).when(k == 2, F.concat("input", F.lit(" ("))).otherwise(F.col("input"))
    return pairs(spark, sf_dir).select("pair_id", fx.is_single_function(fx.extract_code_facts(source)).alias("single"))


@query(r"""SELECT doc_id, regexp_matches(t, '(^|[^\w.])0[0-9]+') AS strict, regexp_matches(t, '(^|[^0-9])0[0-9]+') AS compat
FROM (SELECT doc_id, text || ' v' || (doc_id % 30) || '.0' || (doc_id % 7) || ' ' || CASE WHEN doc_id % 5 = 0 THEN '07' ELSE '70' END AS t FROM documents)""")
def q_leading_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    t = F.concat(
        "text", F.lit(" v"), (d % 30).cast("string"), F.lit(".0"), (d % 7).cast("string"), F.lit(" "),
        F.when(d % 5 == 0, "07").otherwise("70"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", rl.has_leading_zero(t).alias("strict"), rl.has_leading_zero(t, "compat").alias("compat")
    )


# Expected values and whether the grammar allows them.
RHS_FORMS = (
    ("{v}", True), ("round({v},2)", True), ("expected", False), ("math.floor({v})", True), ("float('nan')", True),
    ("abs(-{v})+len([1])", True), ("x[0]", False), ("True", True), ("os.getcwd()", False), ("max(1,min({v},2))**2", True),
    ("lambda:1", False), ("a<b", False), ("~int({v})", False), ("[1,{v}]", True), ("round(", False),
)


@query(
    "SELECT l_orderkey, l_linenumber, " + "list_extract([" + ", ".join(str(ok).lower() for _, ok in RHS_FORMS)
    + f"], CAST((l_orderkey + l_linenumber) % {len(RHS_FORMS)} AS INT) + 1) AS allowed FROM lineitem"
)
def q_rhs_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(f) for f, _ in RHS_FORMS])
    form = F.element_at(forms, ((F.col("l_orderkey") + F.col("l_linenumber")) % len(RHS_FORMS) + 1).cast("int"))
    rhs = F.replace(form, F.lit("{v}"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.element_at(rl.rhs_allowed(F.array(rhs)), 1).alias("allowed")
    )


@query(PAIRS_SQL + """SELECT pair_id, CASE WHEN family = 'is_even' THEN b % 2 = 0 AND a % 2 = 0
  WHEN family = 'divide' THEN false ELSE wrong = 0 END AS holds FROM pairs""")
def q_all_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asserts whose left side was replaced by the true value; chains and identity too."""
    even = F.concat(
        F.lit("assert "), (F.col("a") % 2 == 0).cast("string"), F.lit("\nassert "), (F.col("b") % 2).cast("string"),
        F.lit(" < 1 <= 1.0 < 2\nassert True is True"),
    )
    even = F.replace(F.replace(even, F.lit("true"), F.lit("True")), F.lit("false"), F.lit("False"))
    compared = F.concat(F.lit("def t():\n    assert "), F.coalesce("true_text", F.lit("None")), F.lit("+0 =="), "rhs")
    plain = F.concat(F.lit("def t():\n    assert "), F.coalesce("true_text", F.lit("None")), F.lit(" =="), "rhs")
    test = (
        F.when(F.col("family") == "is_even", even)
        # A side that is no literal cannot be evaluated.
        .when(F.col("family") == "divide", compared).otherwise(plain)
    )
    facts = fx.extract_code_facts(test)
    return pairs(spark, sf_dir).withColumn("facts", facts).select("pair_id", asserts_hold(F.col("facts.asserts")).alias("holds"))


@query(PAIRS_SQL + "SELECT pair_id, family AS first_name, family || ',test_g' || ',helper' AS all_names FROM pairs")
def q_def_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat("input", F.lit("\ndef test_g(x):\n    def inner(y): pass\ndef helper (z): pass\n"))
    return pairs(spark, sf_dir).select(
        "pair_id", def_name(source).alias("first_name"), F.array_join(def_names(source), ",").alias("all_names")
    )


# --- JSON objects and maps ---------------------------------------------------------------


def user_meta(k: Column) -> Column:
    return F.create_map(F.lit("k"), k.cast("string"), F.lit("mode"), F.lit("base"))


@query("""SELECT event_id, 'k=' || coalesce(json_extract_string(props, '$.k'), '') || ';mode=base;origin=' || event_type AS meta,
  CAST(3 AS INTEGER) AS n_keys FROM events""")
def q_merge_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties overlaid on defaults, then the event type."""
    props = F.from_json("props", "map<string,string>")
    base = merge_meta(user_meta(F.lit("default")), props)
    merged = merge_meta(base, F.create_map(F.lit("origin"), F.col("event_type")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(F.col("m"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf_dir, "events").withColumn("m", merged).select(
        "event_id", shown.alias("meta"), F.size("m").alias("n_keys")
    )


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"origin":"é\\"' || event_type || '"}' AS props FROM events""")
def q_json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit('é"'), "event_type")
    return table(spark, sf_dir, "events").select("event_id", json_set("props", {"origin": value}).alias("props"))


#: Functions beyond one operation, each with a call. The fifth raises where ``b`` is 0, the last is
#: no arithmetic.
CALL_KINDS = 6
CALLS = (
    ("suma_ñ", "def suma_ñ(a, b, c=3):\n    return a + b * c - 1", "b={b}, a={a}"),
    ("scaled", "def scaled(x, y):\n    '''Doubled.'''\n    twice = x * 2\n    return twice % (y + 1)", "{a}, y={b}"),
    ("big", "def big(a, b):\n    return a * 10 ** 39 + b", "{a}, {b}"),
    ("halves", "def halves(a, b):\n    half = a - b\n    half /= 2\n    return half", "{a}, b={b}"),
    ("quotient", "def quotient(a, b=2):\n    return -a // b", "{a}, {b}"),
    ("listed", "def listed(a, b):\n    return [a, b]", "{a}, {b}"),
)
CALL_VALUE_SQL = rf"""CASE pair_id % {CALL_KINDS} WHEN 0 THEN CAST(a + b * 3 - 1 AS VARCHAR) WHEN 1 THEN CAST((2 * a) % (b + 1) AS VARCHAR)
  WHEN 2 THEN CASE WHEN a = 0 THEN CAST(b AS VARCHAR) ELSE a || lpad(CAST(b AS VARCHAR), 39, '0') END
  WHEN 3 THEN CASE WHEN a = b THEN '0.0' ELSE regexp_replace(CAST((a - b) / 2.0 AS VARCHAR), '\.0+$', '') END
  WHEN 4 THEN CASE WHEN b <> 0 THEN CAST(CAST(floor(-a / CAST(b AS DOUBLE)) AS BIGINT) AS VARCHAR) END END"""


def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function, its name and the arguments of a call, by kind, for every pair."""
    df = pairs(spark, sf_dir).select("pair_id", "a", "b")

    def by_kind(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("pair_id") % CALL_KINDS + 1).cast("int"))

    args = by_kind([c[2] for c in CALLS])
    for name in ("a", "b"):
        args = F.replace(args, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
    return df.withColumns({"func_name": by_kind([c[0] for c in CALLS]), "input": by_kind([c[1] for c in CALLS]), "args": args})


@query(PAIRS_SQL + f""", valued AS (SELECT pair_id, {CALL_VALUE_SQL} AS value FROM pairs)
SELECT pair_id, CASE WHEN pair_id % {CALL_KINDS} = 5 THEN 'unverifiable' WHEN value IS NULL THEN 'raises' WHEN value = '7' THEN 'ok' ELSE 'corrected' END AS status,
  value FROM valued UNION ALL
SELECT pair_id, CASE WHEN pair_id % {CALL_KINDS} = 5 THEN 'unverifiable' ELSE 'raises' END, NULL FROM valued""")
def q_verify_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of functions with several operations, local names, defaults and names beyond ASCII,
    with arguments by name and integers of 40 digits; and a call with an argument too many."""
    call = F.concat("func_name", F.lit("("), "args")
    test = F.concat(F.lit("assert "), call, F.lit(") == 7; assert "), call, F.lit(", nothing=1) == 7"))
    df = call_pairs(spark, sf_dir).withColumn("form", au.closed_form_of("input"))
    checked = df.withColumn("pairs", au.verify_pairs(au.assert_pairs(test, "func_name"), F.col("form")))
    return au.settle_open_pairs(checked).select("pair_id", F.explode("pairs").alias("p")).select("pair_id", "p.status", "p.value")


LINEAR = "def linear(a, b=4):\n    twice = a * 2\n    return twice + b - 1"
SIDE_KINDS = 9


@query(PAIRS_SQL + f""", valued AS (SELECT pair_id, pair_id % {SIDE_KINDS} AS kind, 2 * a + b - 1 AS v, a, b FROM pairs)
SELECT pair_id, CASE kind WHEN 1 THEN CASE WHEN v < 20 THEN NULL ELSE 'wrong_value' END
  WHEN 2 THEN CASE WHEN v BETWEEN 5 AND 25 THEN NULL ELSE 'wrong_value' END
  WHEN 4 THEN 'wrong_value' WHEN 5 THEN 'raises' WHEN 6 THEN CASE WHEN v = 0 THEN 'raises' END
  WHEN 7 THEN 'unverifiable' WHEN 8 THEN CASE WHEN v = 0 THEN 'wrong_value' END END AS reason FROM valued""")
def q_true_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a test is refused, for asserts that are no plain ``f(args) == value``: reversed sides,
    orders, chains, approximate values, arguments by name, an argument too many, arithmetic around
    a call, membership, a bare call."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    call = F.concat(F.lit("linear(b="), b, F.lit(", a="), a, F.lit(")"))
    value = F.col("a") * 2 + F.col("b") - 1
    exact = value.cast("string")
    # Near the value for pytest.approx, whose tolerance is a share of it, but 1e-12 for zero.
    near = F.concat(exact, F.when(value == 0, ".0000000000001").otherwise(".0000001"))
    kind = F.col("pair_id") % SIDE_KINDS
    line = (
        F.when(kind == 0, F.concat(exact, F.lit(" == "), call)).when(kind == 1, F.concat(call, F.lit(" < 20")))
        .when(kind == 2, F.concat(F.lit("5 <= "), call, F.lit(" <= 25")))
        .when(kind == 3, F.concat(call, F.lit(" == pytest.approx("), near, F.lit(")")))
        .when(kind == 4, F.concat((value + 1).cast("string"), F.lit(" == "), call))
        .when(kind == 5, F.concat(F.lit("5 == linear("), a, F.lit(", "), b, F.lit(", 1)")))
        .when(kind == 6, F.concat(F.lit("1 / "), call, F.lit(" != 7")))
        .when(kind == 7, F.concat(call, F.lit(" in [1]"))).otherwise(call)
    )
    text = F.concat(F.lit("def test_linear():\n    assert "), line)
    df = pairs(spark, sf_dir).select("pair_id", text.alias("text"), F.lit("linear").alias("func_name"), F.lit(LINEAR).alias("func_src"))
    return gate_candidates(with_forms(df)).select("pair_id", "reason")
