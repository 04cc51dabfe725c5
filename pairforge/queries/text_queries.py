"""Text cleaning over whole documents, pages, conversations and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions import literals as lt
from pairforge.functions import prompts as pr
from pairforge.functions import text as tx
from pairforge.functions.rules import route_prompt
from pairforge.operators.candidates import sanitize
from pairforge.operators.training import prepare_training
from pairforge.queries import query
from pairforge.queries.tables import LITERAL_SQL, PAIRS_SQL, pairs, table
from pairforge.session import spread

# Blanks as SQL needs them (same code points as pairforge.functions.text.SPACE).
SPACE = tx.SPACE


def strip_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", *columns)


@query(r"""SELECT doc_id, regexp_replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', chr(13)),
  '\r\n?', chr(10), 'g') AS clean FROM documents""")
def q_clean_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit("\r"))
    return documents(spark, sf_dir, tx.normalize_newlines(mixed).alias("clean"))


@query(r"""SELECT doc_id, regexp_replace(chr(65279) || chr(8203) || chr(160) || replace(text, ' ', chr(8203) || ' '),
  '^[\x{feff}\x{200b}-\x{200d}\x{202a}-\x{202e}\x{2060}-\x{2063}\x{a0}]+', '') AS clean FROM documents""")
def q_strip_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("\ufeff\u200b\u00a0"), F.replace(F.col("text"), F.lit(" "), F.lit("\u200b ")))
    return documents(spark, sf_dir, tx.strip_leading_invisible(noisy).alias("clean"))


@query(r"""WITH noisy AS (SELECT doc_id, replace(replace(text, ' ', chr(9) || chr(7) || ' '), 'e', 'e' || chr(8203)) AS t
  FROM documents),
safe AS (SELECT doc_id, replace(t, chr(10), chr(9216)) AS no_lf, replace(replace(t, chr(10), chr(9216)), chr(9), chr(9217)) AS no_lf_tab
  FROM noisy)
SELECT doc_id,
  replace(replace(regexp_replace(no_lf_tab, '[\p{Cc}\p{Cf}\p{Co}]', '', 'g'), chr(9216), chr(10)), chr(9217), chr(9)) AS with_tabs,
  replace(regexp_replace(no_lf, '[\p{Cc}\p{Cf}\p{Co}]', '', 'g'), chr(9216), chr(10)) AS without_tabs
FROM safe""")
def q_strip_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("\t\x07 ")), F.lit("e"), F.lit("e\u200b"))
    return documents(
        spark, sf_dir,
        tx.strip_control(noisy).alias("with_tabs"),
        tx.strip_control(noisy, keep_tab=False).alias("without_tabs"),
    )


@query(rf"""SELECT 'document' AS kind, doc_id AS id,
  regexp_replace(replace(text, ' ', chr(8203) || ' ' || chr(160)), '{tx.BIDI_ZERO_WIDTH}', '', 'g') AS clean FROM documents
UNION ALL SELECT 'page', page_id,
  regexp_replace(replace(html, ' ', chr(8203) || ' ' || chr(160)), '{tx.BIDI_ZERO_WIDTH}', '', 'g') FROM pages""")
def q_strip_bidi(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir, "text").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    noisy = F.replace(F.col("text"), F.lit(" "), F.lit("\u200b \u00a0"))
    return texts.unionByName(pages).select("kind", "id", tx.strip_bidi_zw(noisy).alias("clean"))


@query("""SELECT doc_id, translate(replace(replace(text, 'e', '’'), ' a', ' “'), '‘’“”', '''''""') AS clean FROM documents""")
def q_ascii_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    curly = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("’")), F.lit(" a"), F.lit(" “"))
    return documents(spark, sf_dir, tx.ascii_quotes(curly).alias("clean"))


WIDE_SQL = "replace(replace(text, ' ', chr(9) || '  '), chr(10), chr(10) || chr(10) || chr(10) || chr(10) || '  ')"


@query(rf"""WITH wide AS (SELECT doc_id, {strip_sql(WIDE_SQL)} AS t FROM documents)
SELECT doc_id,
  {strip_sql(r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS squeezed,
  {strip_sql(r"regexp_replace(regexp_replace(t, '([^ \t\n])[ \t]+', '\1 ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS indented
FROM wide""")
def q_collapse_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("\t  ")), F.lit("\n"), F.lit("\n\n\n\n  "))
    return documents(
        spark, sf_dir,
        tx.collapse_space(wide, preserve_indent=False).alias("squeezed"),
        tx.collapse_space(wide).alias("indented"),
    )


LINES_SQL = "string_split(regexp_replace({0}, '\\n\\z', ''), chr(10))"


@query(rf"""WITH src AS (SELECT doc_id, replace(text, chr(10), chr(10) || '  # note' || chr(10) || '   ') AS t FROM documents)
SELECT doc_id, {strip_sql(rf"lower(regexp_replace(list_aggregate(list_filter(list_transform({LINES_SQL.format('t')}, lambda x: {strip_sql('x')}), lambda x: x <> '' AND NOT starts_with(x, '#')), 'string_agg', ' '), '[{SPACE}]+', ' ', 'g'))")} AS key FROM src""")
def q_similarity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    commented = F.replace(F.col("text"), F.lit("\n"), F.lit("\n  # note\n   "))
    return documents(spark, sf_dir, tx.similarity_key(commented).alias("key"))


KEY_SQL = strip_sql(rf"lower(regexp_replace(list_aggregate(list_filter(list_transform({LINES_SQL.format('t')}, lambda x: {strip_sql('x')}), lambda x: x <> '' AND NOT starts_with(x, '#')), 'string_agg', ' '), '[{SPACE}]+', ' ', 'g'))")


@query(rf"""WITH src AS (SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN text
    WHEN 1 THEN lower(text) ELSE replace(text, chr(10), chr(10) || '# note' || chr(10)) END, '') AS t FROM documents),
keyed AS (SELECT doc_id, coalesce({KEY_SQL}, '') AS key FROM src),
grouped AS (SELECT key, min(doc_id) AS first, count(*) AS n FROM keyed WHERE key <> '' GROUP BY key)
SELECT doc_id, coalesce(first, doc_id) AS representative, coalesce(n, 1) AS copies FROM keyed LEFT JOIN grouped USING (key)""")
def q_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for case, comment lines and blanks."""
    from pairforge.operators.similarity import exact_duplicates

    noted = F.replace(F.col("text"), F.lit("\n"), F.lit("\n# note\n"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.lower("text")).otherwise(noted)
    return exact_duplicates(documents(spark, sf_dir, changed.alias("text")), "doc_id")


@query(rf"""WITH s AS (SELECT conv_id, turn, {strip_sql("text")} AS t FROM conversations),
quoted AS (SELECT conv_id, turn, replace(t, chr(10), '\n') AS t,
  CASE WHEN turn % 3 = 0 THEN '"' WHEN turn % 3 = 1 THEN '\"' ELSE '' END AS q FROM s)
SELECT conv_id, turn, replace(replace(t, '\n', chr(10)), '\t', chr(9)) AS clean FROM quoted""")
def q_unwrap_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 3
    quote = F.when(turn == 0, '"').when(turn == 1, '\\"').otherwise("")
    flat = F.replace(tx.strip("text"), F.lit("\n"), F.lit("\\n"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.unwrap_quotes(F.concat(F.lit(" "), quote, flat, quote, F.lit("\n"))).alias("clean")
    )


@query("""SELECT doc_id, CASE WHEN instr(text, 'and ') > 1 THEN substring(text, instr(text, 'and ')) ELSE text END AS clean
FROM documents""")
def q_drop_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, tx.drop_before("text", "and ").alias("clean"))


@query(rf"""WITH l AS (SELECT doc_id, {LINES_SQL.format("replace(text, '. ', '.' || chr(10) || ' ')")} AS xs FROM documents),
h AS (SELECT doc_id, xs, list_position(list_transform(xs, lambda x: starts_with({strip_sql('x')}, 'A')), true) AS first FROM l)
SELECT doc_id, array_to_string(list_filter(xs, lambda x, i: NOT starts_with({strip_sql('x')}, 'A') OR i = first), chr(10)) AS clean
FROM h""")
def q_keep_first_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = F.replace(F.col("text"), F.lit(". "), F.lit(".\n "))
    return documents(spark, sf_dir, tx.keep_first_header(lined, "A").alias("clean"))


@query(r"""SELECT doc_id, replace(replace(text, '\', ''), 'a', '\\q\n') AS clean FROM documents""")
def q_escape_backslash(spark: SparkSession, sf_dir: str) -> DataFrame:
    slashed = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("")), F.lit("a"), F.lit("\\q\\n"))
    return documents(spark, sf_dir, tx.escape_stray_backslash(slashed).alias("clean"))


@query(PAIRS_SQL + """SELECT pair_id, CASE WHEN pair_id % 4 = 0 THEN 'import pytest' || chr(10) || output
  ELSE 'import pytest' || chr(10) || chr(10) || output END AS test FROM pairs""")
def q_ensure_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("pair_id") % 4 == 0, F.concat(F.lit("import pytest\n"), "output")).otherwise(F.col("output"))
    return pairs(spark, sf_dir).select("pair_id", tx.ensure_import(some).alias("test"))


@query(rf"""WITH s AS (SELECT doc_id, {strip_sql('text')} AS t FROM documents)
SELECT doc_id, 'def test_doc_' || doc_id || '():' || chr(10) ||
  array_to_string(list_transform(string_split(t, chr(10)),
    lambda x: CASE WHEN {strip_sql('x')} = '' THEN x ELSE '    ' || x END), chr(10)) || chr(10) AS test FROM s""")
def q_wrap_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir, tx.wrap_as_test("text", name).alias("test"))


@query(PAIRS_SQL + """SELECT pair_id, '# head' || chr(10) || 'def test_f' || pair_id || '(' ||
  substring(output, 10 + length(family) + 1) || chr(10) || output AS test FROM pairs""")
def q_rename_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.concat(F.lit("# head\n\n  "), "output", F.lit("\n"), "output")
    name = F.concat(F.lit("f"), F.col("pair_id").cast("string"))
    return pairs(spark, sf_dir).select("pair_id", tx.rename_first_test(twice, name).alias("test"))


@query(PAIRS_SQL + """SELECT pair_id, family || '(1) ' || family || ' ' || family || '(2) ' || family || 's(3) ' || output AS test
FROM pairs""")
def q_identifier_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("family")
    shout = F.concat(
        F.initcap(f), F.lit("  (1) "), F.upper(f), F.lit(" "), f, F.lit(" (2) "), f, F.lit("s(3) "), "output"
    )
    return pairs(spark, sf_dir).select("pair_id", tx.fix_identifier_case(shout, "family").alias("test"))


@query(PAIRS_SQL + r"""SELECT pair_id, regexp_replace(regexp_replace(replace(output, 'assert ', 'assert    '),
  'assert\s+(\S)', 'assert \1', 'g'), 'assert\s+([^\s=]+)\s*==', 'assert \1 ==', 'g') AS test FROM pairs""")
def q_assert_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace(F.col("output"), F.lit("assert "), F.lit("assert    "))
    return pairs(spark, sf_dir).select("pair_id", tx.fix_assert_spacing(spaced).alias("test"))


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity - l_quantity AS zero,
  l_quantity AS qty FROM lineitem)
SELECT l_orderkey, l_linenumber, {LITERAL_SQL.format('net')} AS net, {LITERAL_SQL.format('zero')} AS zero,
  {LITERAL_SQL.format('(-qty)')} AS qty FROM v""")
def q_format_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        lt.format_literal(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        lt.format_literal(qty - qty).alias("zero"),
        lt.format_literal(-qty).alias("qty"),
    )


NAME_WORD = r"([A-Z][a-z]+)[.]"


@query(rf"""WITH n AS (SELECT doc_id, source, list_transform(regexp_extract_all(text, '{NAME_WORD}', 1), lambda x: x || '()') AS xs
  FROM documents)
SELECT doc_id, CASE WHEN len(xs) = 1 THEN 'Tests for ' || xs[1] WHEN len(xs) IN (2, 3) THEN array_to_string(xs, ', ')
  WHEN len(xs) > 3 THEN xs[1] || ' + ' || (len(xs) - 1) || ' more'
  WHEN doc_id % 2 = 0 THEN source || '.py tests' ELSE 'Session – 05 Mar 14:07' END AS title FROM n""")
def q_session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(NAME_WORD), F.lit(1))
    file_name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/up/"), "source", F.lit(".py")))
    at = F.to_timestamp(F.lit("2024-03-05 14:07:00"))
    return documents(spark, sf_dir, tx.session_title(names, file_name=file_name, at=at).alias("title"))


@query(PAIRS_SQL + """SELECT pair_id, CASE pair_id % 5 WHEN 0 THEN 'Tests for ' || family || '()'
  WHEN 1 THEN 'Tests for ' || family || '()' WHEN 2 THEN 'Tests for ' || family || '()' WHEN 3 THEN 'My session'
  ELSE 'Session ' || (pair_id + 1) END AS title FROM pairs""")
def q_auto_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("pair_id")
    title = (
        F.when(pid % 5 == 0, " New Session ").when(pid % 5 == 1, F.concat(F.lit("SESSION #"), pid.cast("string")))
        .when(pid % 5 == 2, F.lit(None).cast("string")).when(pid % 5 == 3, "My session")
        .otherwise(F.concat(F.lit("Session "), (pid + 1).cast("string")))
    )
    # Without a function in the code, the test names it.
    code = F.when(pid % 5 == 1, "x = 1").otherwise(F.col("input"))
    return pairs(spark, sf_dir).select("pair_id", tx.auto_title(title, pid, code, "output").alias("title"))


@query("""SELECT conv_id, turn, 'Given this Python function:' || chr(10) || '```python' || chr(10) || text || chr(10) ||
  CASE WHEN role = 'user' THEN '```, write a PyTest unit test function in Python that focuses on edge cases and boundary conditions (empty inputs, None, extremes, errors, invalid types, etc.) with assert statements to verify behavior.'
  ELSE '```, write a PyTest unit test function in Python with at least one assert statement to verify its behavior.' END AS prompt
FROM conversations""")
def q_build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("role") == "user", "edge").otherwise("base")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", pr.training_prompt("text", mode).alias("prompt")
    )


def fill_sql(template: str) -> str:
    """A prompt template as a SQL concatenation."""
    quoted = "'" + template.replace("'", "''") + "'"
    for name, column in (("name", "family"), ("code", "input"), ("previous", "output")):
        quoted = quoted.replace("{" + name + "}", f"' || {column} || '")
    return quoted


@query(PAIRS_SQL + f"""SELECT pair_id, CASE WHEN family = 'is_even' THEN 'predicate' ELSE 'base' END AS route,
  CASE WHEN family = 'is_even' THEN {fill_sql(pr.BEFORE['predicate'])} ELSE '' END || {fill_sql(pr.INSTRUCTION)}
  || {fill_sql(pr.REGENERATE)} AS prompt FROM pairs""")
def q_regeneration_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = pairs(spark, sf_dir).withColumn(
        "route", route_prompt("family", "input", fx.extract_code_facts("input"))
    )
    return routed.select("pair_id", "route", pr.regeneration_prompt("route", "family", "input", "output").alias("prompt"))


# Tokens with the layout in front of each: joined again, they are the text itself.
@query(rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[{tx.SPACE}]*(?:{tx.TOKEN})') AS xs FROM documents)
SELECT doc_id, CASE WHEN len(xs) > 512 THEN array_to_string(xs[1:512], '') ELSE text END AS text,
  CAST(least(len(xs), 512) AS INTEGER) AS n_tokens, len(xs) > 512 AS was_truncated
FROM t""")
def q_truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four languages, cut after 512 tokens with their layout kept."""
    cut = documents(spark, sf_dir, tx.truncate_tokens("text", 512).alias("c"))
    return cut.select("doc_id", "c.text", "c.n_tokens", "c.was_truncated")


@query(PAIRS_SQL + r"""SELECT pair_id, output AS label,
  CAST(len(regexp_extract_all(output, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS INTEGER) AS label_tokens, false AS was_truncated
FROM pairs""")
def q_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of training rows: far below the limit, so each is its output byte for byte."""
    rows = prepare_training(pairs(spark, sf_dir).withColumn("func_name", F.col("family")))
    return rows.select("pair_id", "label", "label_tokens", "was_truncated")


@query(PAIRS_SQL + """SELECT pair_id, CASE pair_id % 4 WHEN 1 THEN 'total' WHEN 2 THEN 'generated' ELSE family END AS name FROM pairs""")
def q_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 4
    code = (
        F.when(k == 1, "total = 3").when(k == 2, "# nothing").when(k == 3, F.concat("input", F.lit("\n  bad indent")))
        .otherwise(F.col("input"))
    )
    df = pairs(spark, sf_dir).withColumn("code", code)
    parsed = fx.first_function(fx.extract_code_facts("code"))
    return df.select("pair_id", tx.function_name_or_default("code", parsed).alias("name"))


@query(PAIRS_SQL + """SELECT pair_id, string_split(family || '_tax', '_')[1] AS family, family <> 'is_even' AS arithmetic FROM pairs""")
def q_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("family", F.lit("_tax"))
    return pairs(spark, sf_dir).select(
        "pair_id", tx.family_of(name).alias("family"), tx.is_arithmetic_family(name).alias("arithmetic")
    )


@query(PAIRS_SQL + """SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'tests_item_' || pair_id || '.py' ELSE 'test_' || family || '.py' END AS file_name FROM pairs""")
def q_export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = F.when(F.col("pair_id") % 3 == 0, "assert True").otherwise(F.col("output"))
    return pairs(spark, sf_dir).select("pair_id", tx.export_name(tests, "pair_id").alias("file_name"))


@query()
def q_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as raw model output; what survives as a test is for the parser to say."""
    named = documents(spark, sf_dir, F.lit("doc").alias("func_name"), F.concat(F.lit("junk def test_doc():\n    "), "text").alias("text"))
    return sanitize(named)


@query(PAIRS_SQL + """SELECT pair_id, CASE pair_id % 4 WHEN 0 THEN output WHEN 1 THEN 'def test_' || family || '():' || chr(10) || '    pass'
  WHEN 2 THEN 'def test_' || family || '():' || chr(10) || '    # fallback: callable smoke test' || chr(10) || '    assert callable(' || family || ')' || chr(10)
  ELSE output || chr(10) || 'x = 1' END AS text FROM pairs""")
def q_sanitize_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw output with prose in front of a test, prose alone, a test that does not parse, and
    a test with more code behind it."""
    k = F.col("pair_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("Here it is: "), "output")).when(k == 1, "no test at all")
        .when(k == 2, F.concat(F.lit("def test_"), "family", F.lit("():\n    assert (1 =="))).otherwise(F.concat("output", F.lit("\nx = 1")))
    )
    df = pairs(spark, sf_dir).select("pair_id", F.col("family").alias("func_name"), raw.alias("text"))
    return sanitize(df).select("pair_id", "text")


@query(PAIRS_SQL + """SELECT pair_id, CASE WHEN pair_id % 3 = 2 THEN NULL ELSE 'año_' || family END AS first_name,
  CASE WHEN pair_id % 3 = 2 THEN 0 ELSE 2 END AS n_names FROM pairs""")
def q_unicode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function names beyond ASCII are names; text without a definition has none."""
    code = F.when(F.col("pair_id") % 3 == 2, "x = 1").otherwise(
        F.concat(F.lit("def a\u00f1o_"), "family", F.lit("(a):\n    return a\n\ndef\u00a0z\u00fcrich (b):\n    return b\n"))
    )
    df = pairs(spark, sf_dir).withColumn("code", code)
    return df.select("pair_id", tx.def_name("code").alias("first_name"), F.size(tx.def_names("code")).alias("n_names"))
