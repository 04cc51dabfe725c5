"""Code facts and the gates built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions import rules as rl
from pairforge.operators.blocks import previous_test, split_tests
from pairforge.operators.candidates import apply_op, calls_target, probe_families, references_any, with_fallback
from pairforge.operators.similarity import fuzzy_rename, length_bound, overlap_bound, same_call_args
from pairforge.plans.generation import functions
from pairforge.queries import query
from pairforge.queries.tables import PAIRS_SQL, pairs, table


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with 0 to 13 asserts, some on a helper, and the facts of both texts."""
    one = F.concat(F.lit("\n    assert "), "family", F.lit("("), F.col("a").cast("string"), F.lit(","), F.col("b").cast("string"), F.lit(") == "), "rhs")
    n = F.when(F.col("owner") % 4 == 0, F.col("b") + 7).otherwise(F.col("b") % 3).cast("int")
    extra = (
        F.when(F.col("a") == 3, "\n    assert helper(1) == 1")
        .when(F.col("a") == 4, "\n    assert len([1]) == 1")
        .when(F.col("a") == 5, "\n    with pytest.raises(TypeError):\n        math.floor('x')")
        .otherwise("\n    pass")
    )
    test = F.concat(F.lit("def test_"), "family", F.lit("():"), F.repeat(one, n), extra)
    return pairs(spark, sf_dir).withColumns({"n": n, "test": test}).withColumn("facts", fx.extract_code_facts("test"))


TESTS_SQL = PAIRS_SQL + """, tests AS (SELECT *, CAST(CASE WHEN owner % 4 = 0 THEN b + 7 ELSE b % 3 END AS INTEGER) AS n FROM pairs),
counted AS (SELECT *, n + CASE WHEN a IN (3, 4) THEN 1 ELSE 0 END AS n_asserts FROM tests)
"""


@query(TESTS_SQL + """SELECT pair_id, true AS parse_ok, CAST(1 AS INTEGER) AS n_functions, CAST(n_asserts AS INTEGER) AS n_asserts,
  CAST(n + CASE WHEN a IN (3, 4) THEN 1 WHEN a = 5 THEN 2 ELSE 0 END AS INTEGER) AS n_calls FROM counted""")
def q_facts_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("facts")
    return tests(spark, sf_dir).select(
        "pair_id", f["parse_ok"].alias("parse_ok"), F.size(f["functions"]).alias("n_functions"),
        fx.n_asserts(f).alias("n_asserts"), F.size(f["calls"]).alias("n_calls"),
    )


@query(TESTS_SQL + """SELECT pair_id, CAST(n_asserts AS INTEGER) AS n_asserts,
  CAST(n_asserts + CASE WHEN a = 5 THEN 1 ELSE 0 END AS INTEGER) AS n_checks, a = 5 AS has_raises FROM counted""")
def q_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("facts")
    return tests(spark, sf_dir).select(
        "pair_id", fx.n_asserts(f).alias("n_asserts"), fx.n_checks(f).alias("n_checks"),
        F.col("test").contains("pytest.raises").alias("has_raises"),
    )


@query(TESTS_SQL + """SELECT pair_id, CASE WHEN n_asserts > 0 THEN round(CAST(n AS DOUBLE) / n_asserts, 6) END AS focus FROM counted""")
def q_focus_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir).select("pair_id", F.round(fx.focus_ratio(F.col("facts"), F.col("family")), 6).alias("focus"))


GENERATE_SQL = """CASE WHEN n = 0 THEN 'does_not_call_target' WHEN a = 3 THEN 'foreign_calls'
    WHEN n_asserts NOT BETWEEN 1 AND 12 THEN 'bad_assert_count' WHEN n < n_asserts THEN 'assert_without_target' END"""


@query(TESTS_SQL + f"""SELECT pair_id, {GENERATE_SQL} AS generate, CASE WHEN n_asserts NOT BETWEEN 1 AND 12 THEN 'bad_assert_count'
    WHEN n = 0 THEN 'does_not_call_target' WHEN n < n_asserts THEN 'assert_without_target' WHEN a = 3 THEN 'foreign_calls' END AS regenerate
FROM counted""")
def q_structural_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.col("test"), F.col("facts"), F.col("family"))
    return tests(spark, sf_dir).select(
        "pair_id",
        rl.first_reason(rl.structural_rules(*args)).alias("generate"),
        rl.first_reason(rl.structural_rules(*args, flow="regenerate")).alias("regenerate"),
    )


@query(TESTS_SQL + "SELECT pair_id FROM counted WHERE n > 0")
def q_calls_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = pairs(spark, sf_dir).select("pair_id", F.col("family").alias("func_name"))
    return calls_target(tests(spark, sf_dir), targets, ["pair_id"]).select("pair_id")


@query(TESTS_SQL + "SELECT pair_id, n > 0 AS referenced FROM counted")
def q_references_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tests(spark, sf_dir).withColumn("source", fx.extract_code_facts("input"))
    return df.select("pair_id", references_any("facts", "source").alias("referenced"))


@query(TESTS_SQL + "SELECT pair_id, a = 3 AS foreign_call FROM counted")
def q_foreign_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir).select(
        "pair_id", rl.has_foreign_calls(F.col("facts"), F.col("family")).alias("foreign_call")
    )


@query(TESTS_SQL + """SELECT pair_id, CAST(r.pos AS INTEGER) AS pos, family AS name, a || '|' || b AS args
FROM counted, LATERAL (SELECT unnest(range(n)) AS pos) r""")
def q_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        tests(spark, sf_dir).select("pair_id", "family", F.explode("facts.calls").alias("c"))
        .filter((F.col("c.name") == F.col("family")) & F.col("c.literal"))
        .select("pair_id", "c.pos", "c.name", F.array_join("c.args", "|").alias("args"))
    )


@query(TESTS_SQL + """SELECT pair_id, CAST(CASE WHEN n = 0 THEN n_asserts ELSE n END AS INTEGER) AS n_kept FROM counted""")
def q_keep_target_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same asserts at module level: those on the target stay, or all of them."""
    flat = F.replace(F.regexp_replace("test", r"\Adef test_\w+\(\):", ""), F.lit("\n    "), F.lit("\n"))
    df = tests(spark, sf_dir).withColumn("top", fx.extract_code_facts(flat))
    return df.select("pair_id", F.size(rl.keep_target_asserts(F.col("top"), F.col("family"))).alias("n_kept"))


# --- functions ---------------------------------------------------------------------------


@query(PAIRS_SQL + """SELECT pair_id, CAST(0 AS INTEGER) AS pos, family AS func_name, input AS func_src FROM pairs
UNION ALL SELECT pair_id, 1, 'twin', 'def twin(q):' || chr(10) || '    return q * 2' FROM pairs""")
def q_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat("input", F.lit("\n\ndef test_x():\n    pass\n\ndef twin(q):\n    return q * 2\n"))
    df = pairs(spark, sf_dir).select("pair_id", source.alias("code")).withColumn("facts", fx.extract_code_facts("code"))
    return functions(df).select("pair_id", "pos", "func_name", "func_src")


@query(PAIRS_SQL + """SELECT pair_id, family || ',twin' AS user_names, family || ',test_x,twin' AS all_names FROM pairs""")
def q_function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat("input", F.lit("\n\ndef test_x():\n    pass\n\ndef twin(q):\n    return q * 2\n"))
    df = pairs(spark, sf_dir).withColumn("facts", fx.extract_code_facts(source))
    return df.select(
        "pair_id", F.array_join(fx.function_names(F.col("facts")), ",").alias("user_names"),
        F.array_join(fx.function_names(F.col("facts"), include_tests=True), ",").alias("all_names"),
    )


@query(PAIRS_SQL + "SELECT pair_id, family AS first_name FROM pairs")
def q_first_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("def test_a():\n    pass\n"), "input", F.lit("\ndef z(): pass\n"))
    return pairs(spark, sf_dir).select("pair_id", fx.first_function(fx.extract_code_facts(source)).alias("first_name"))


@query(PAIRS_SQL + """SELECT pair_id, CASE family WHEN 'is_even' THEN NULL ELSE family END AS op,
  family IN ('add', 'subtract', 'multiply', 'power') AS arithmetic FROM pairs""")
def q_infer_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir).withColumn("facts", fx.extract_code_facts("input"))
    return df.select(
        "pair_id", rl.infer_op(F.col("facts")).alias("op"), rl.is_arithmetic(F.col("family"), F.col("facts")).alias("arithmetic")
    )


@query(PAIRS_SQL + "SELECT pair_id, pair_id % 3 = 0 AS string_function, pair_id % 3 = 1 AS sorted_compare FROM pairs")
def q_string_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 3
    source = (
        F.when(k == 0, F.concat("input", F.lit("\ndef s(x): return x.strip()")))
        .when(k == 1, F.concat("input", F.lit("\ndef s(x, y): return sorted(x) == sorted(y)")))
        .otherwise(F.concat("input", F.lit("\ndef s(x): return x.pop()")))
    )
    df = pairs(spark, sf_dir).withColumn("facts", fx.extract_code_facts(source))
    return df.select(
        "pair_id", rl.is_string_function(F.col("facts")).alias("string_function"),
        rl.is_sorted_compare(F.col("facts")).alias("sorted_compare"),
    )


# Function bodies and the prompt route each one takes.
ROUTES = (
    ("f", "return len(s)", "counter"), ("f", "return s.islower()", "is_lower"), ("f", "return s.isupper()", "is_upper"),
    ("f", "return sorted(s) == sorted([s, s])", "anagram"), ("f", "return s == s[::-1]", "palindrome"),
    ("f", "return s.isdigit()", "string_predicate"), ("f", "return True", "predicate"),
    ("f", "return s.strip()", "expects_strings"), ("f", "return s * 2", "base"), ("num_words", "return s", "counter"),
    ("is_title", "return s", "string_predicate"), ("is_lower_x", "return s", "is_lower"), ("f", "return s.isprime", "base"),
    ("f", "return s.isprime()", "predicate"), ("f", "return (", "base"),
)


@query(
    "SELECT p_partkey, list_extract([" + ", ".join(f"'{r}'" for _, _, r in ROUTES)
    + f"], CAST(p_partkey % {len(ROUTES)} AS INT) + 1) AS route FROM part"
)
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(ROUTES) + 1).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n, _, _ in ROUTES]), at)
    body = F.element_at(F.array(*[F.lit(b) for _, b, _ in ROUTES]), at)
    note = F.concat(F.lit("  # "), F.replace("p_name", F.lit(" "), F.lit("-")))
    df = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), body.alias("body"), note.alias("note"))
    df = df.withColumn("code", F.concat(F.lit("def "), "name", F.lit("(s):"), "note", F.lit("\n    "), "body"))
    return df.select("p_partkey", rl.route_prompt("name", "code", fx.extract_code_facts("code")).alias("route"))


@query(PAIRS_SQL + """SELECT pair_id, CASE pair_id % 8 WHEN 1 THEN 'session_full' WHEN 2 THEN 'paste_too_long' WHEN 3 THEN 'file_too_large'
  WHEN 4 THEN 'nothing_given' WHEN 5 THEN 'upload_too_long' WHEN 6 THEN 'not_python' WHEN 7 THEN 'no_function' END AS reason,
  CASE WHEN pair_id % 8 IN (3, 5) THEN 'upload' WHEN pair_id % 8 = 4 THEN 'upload' ELSE 'paste' END AS input_method FROM pairs""")
def q_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairforge.plans.generation import admit

    k = F.col("pair_id") % 8
    pad = "#" * 512  # rpad copies its pad once for each time it fits, and counts its characters
    pasted = (
        F.when(k == 2, F.rpad("input", 8001, pad)).when(k.isin(3, 4, 5), F.lit(None).cast("string"))
        .when(k == 6, "def (").when(k == 7, "x = 1").otherwise(F.col("input"))
    )
    upload = F.when(k == 3, F.rpad("input", 200_001, pad)).when(k == 5, F.rpad("input", 9000, pad))
    submissions = pairs(spark, sf_dir).select(
        "pair_id", pasted.alias("pasted_code"), upload.cast("binary").alias("file_bytes"),
        F.when(k == 1, 50).otherwise(3).alias("n_items"), F.lit(50).alias("item_limit"),
    )
    return admit(submissions).select("pair_id", "reason", "input_method")


# --- templates, probes, earlier tests ---------------------------------------------------------


@query(PAIRS_SQL + """SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN output ELSE 'import pytest' || chr(10) || chr(10) || CASE family
  WHEN 'add' THEN 'def test_add():' || chr(10) || '   assert add(3, 4) == 7' || chr(10) || '   assert add(-2, 5) == 3' || chr(10)
  WHEN 'multiply' THEN 'def test_multiply():' || chr(10) || '   assert multiply(2, 3) == 6' || chr(10) || '   assert multiply(-1, 5) == -5' || chr(10)
  WHEN 'subtract' THEN 'def test_subtract():' || chr(10) || '   assert subtract(5, 3) == 2' || chr(10) || '   assert subtract(-2, -3) == 1' || chr(10)
  ELSE 'def test_my_' || family || '():' || chr(10) || '    # model could not produce a valid passing test yet' || chr(10) ||
    '    assert callable(my_' || family || ')' || chr(10) END END AS text FROM pairs""")
def q_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("family").isin("add", "subtract", "multiply")
    df = pairs(spark, sf_dir).select(
        "pair_id", F.when(known, F.col("family")).otherwise(F.concat(F.lit("my_"), "family")).alias("func_name"),
        F.when(F.col("pair_id") % 2 == 0, F.col("output")).alias("text"),
    )
    return with_fallback(df).select("pair_id", "text")


@query(PAIRS_SQL + """SELECT pair_id, NOT (family IN ('add', 'subtract', 'multiply', 'power') AND pair_id % 5 = 1) AS passes FROM pairs""")
def q_probe_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function under its family name; one in five computes a modulus-like '//' instead."""
    df = pairs(spark, sf_dir).withColumn("op", F.regexp_extract("input", r"return a (\*\*|[-+*/]) b", 1))
    df = df.withColumn("op", F.when(F.col("pair_id") % 5 == 1, "//").otherwise(F.col("op")))
    return probe_families(df, "family", lambda a, b: apply_op(F.col("op"), a, b)).select("pair_id", "passes")


@query(PAIRS_SQL + """SELECT pair_id, CASE pair_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS same_args FROM pairs""")
def q_same_call_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an earlier test: other values, same calls in another order, one call less, no literal call."""
    f, k = F.col("family"), F.col("pair_id") % 4
    call = [F.concat(f, F.lit(f"({x}, {y})")) for x, y in ((1, 2), (3.0, -4))]
    previous = F.concat(F.lit("assert "), call[0], F.lit(" == 1\nassert "), call[1], F.lit(" == 2"))
    candidate = (
        F.when(k == 0, F.concat(F.lit("assert "), f, F.lit("(9, 9) == 1")))
        .when(k == 1, F.concat(F.lit("assert "), f, F.lit("(3, -4.0) == 7\nassert "), call[0], F.lit(" == 8")))
        .when(k == 2, F.concat(F.lit("assert "), call[0], F.lit(" == 1")))
        .otherwise(F.concat(F.lit("assert "), f, F.lit("(x, 'y') == 1")))
    )
    df = pairs(spark, sf_dir).withColumns({"p": fx.extract_code_facts(previous), "c": fx.extract_code_facts(candidate)})
    return df.select("pair_id", same_call_args(F.col("p"), F.col("c"), F.col("family")).alias("same_args"))


BLOCK_NAMES = ("add", "gone")


@query(PAIRS_SQL + """SELECT pair_id, 'add' AS func_name, 'def test_add(): second ' || pair_id AS test FROM pairs
UNION ALL SELECT pair_id, 'gone', '' FROM pairs
UNION ALL SELECT pair_id, family, replace(output, 'def test_', 'def test_test_') || chr(10) || '    # tail' FROM pairs WHERE family <> 'add'""")
def q_split_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_distinct(F.array(F.lit("add"), F.lit("gone"), F.col("family")))
    doubled = F.replace("output", F.lit("def test_"), F.lit("def test_test_"))
    block = F.concat(
        F.lit("import pytest\n\ndef test_add(): first\n"), doubled, F.lit("\n    # tail\n\ndef test_other():\n    lost\n\n  def test_add(): second "),
        F.col("pair_id").cast("string"), F.lit("\n"),
    )
    return pairs(spark, sf_dir).select("pair_id", F.explode(split_tests(block, names)).alias("func_name", "test"))


@query(PAIRS_SQL + "SELECT pair_id, output AS known, '' AS missing FROM pairs")
def q_previous_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("# Origin: x\nimport pytest\n\n"), "output", F.lit("\n\ndef test_zz(): pass"))
    df = pairs(spark, sf_dir).withColumn("slices", split_tests(block, F.array("family", F.lit("absent"))))
    return df.select(
        "pair_id", previous_test(F.col("slices"), "family").alias("known"),
        previous_test(F.col("slices"), F.lit("absent")).alias("missing"),
    )


# --- similarity ---------------------------------------------------------------------------------


BOUND_SQL = """WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '\\s+', ' ', 'g') AS k FROM conversations),
pair AS (SELECT c.conv_id, c.turn, p.k AS a, c.k AS b FROM t c JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)
"""


@query(BOUND_SQL + """SELECT conv_id, turn, round(2.0 * least(length(a), length(b)) / (length(a) + length(b)), 6) AS by_length,
  round(2.0 * list_sum(list_transform(list_distinct(string_split(a, '')),
    lambda ch: least(length(a) - length(replace(a, ch, '')), length(b) - length(replace(b, ch, ''))))) / (length(a) + length(b)), 6) AS by_overlap
FROM pair""")
def q_similar_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it in its conversation: a join on the full key."""
    k = F.regexp_replace(F.lower("text"), r"\s+", " ")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", k.alias("b"))
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("b").alias("a"))
    return turns.join(previous, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(length_bound("a", "b"), 6).alias("by_length"),
        F.round(overlap_bound("a", "b"), 6).alias("by_overlap"),
    )


# A text of n characters and the same with k foreign ones appended have the ratio 2n / (2n + k).
@query(PAIRS_SQL + r"""SELECT pair_id, pair_id % 30 AS k,
  pair_id % 30 = 0 OR 2.0 * n / (2.0 * n + pair_id % 30) >= 0.88 AS too_similar
FROM (SELECT pair_id, length(lower(regexp_replace(trim(output), '\s+', ' ', 'g'))) AS n FROM pairs)""")
def q_too_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test against itself with 0 to 29 foreign characters: equal keys, pairs that the
    bounds settle, and (for some 13 of 30) pairs that need the exact ratio."""
    from pairforge.operators.similarity import too_similar

    tests = pairs(spark, sf_dir).select("pair_id", (F.col("pair_id") % 30).alias("k"), "output")
    longer = tests.select("pair_id", "k", F.concat("output", F.repeat(F.lit("\u00df"), F.col("k").cast("int"))).alias("text"))
    previous = tests.select("pair_id", F.col("output").alias("previous"))
    return too_similar(previous, longer, ["pair_id"]).select("pair_id", "k", "too_similar")


FUZZY_SQL = """SELECT p_partkey, name, round(2.0 * least(length(name), length(target)) / (length(name) + length(target)), 6) AS by_length
FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '_')) AS target FROM part)"""


@query(FUZZY_SQL)
def q_fuzzy_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    return names.select("p_partkey", "name", F.round(length_bound("name", "target"), 6).alias("by_length"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("target"),
    )


@query("""SELECT p_partkey, 'is_' || replace(p_name, ' ', '_') AS renamed FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'isnan' ELSE replace(p_name, ' ', '_') END FROM part WHERE p_partkey % 2 = 1""")
def q_fuzzy_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any is* call becomes the predicate, a library predicate stays, dropped underscores come back."""
    target = F.replace("p_name", F.lit(" "), F.lit("_"))
    k = F.col("p_partkey") % 4
    called = (
        F.when(k == 0, "isgood").when(k == 1, "isnan").when(k == 2, F.concat(F.lit("is_"), "p_type"))
        .otherwise(F.replace("p_name", F.lit(" "), F.lit("")))
    )
    goal = F.when(k.isin(0, 2), F.concat(F.lit("is_"), target)).otherwise(target)
    calls = table(spark, sf_dir, "part").select("p_partkey", called.alias("name"), goal.alias("target"))
    return fuzzy_rename(calls).select("p_partkey", "renamed")
