"""Auditing pair corpora: keep, correct, reject or quarantine each record.

All of it is per record: arrays hold the ``f(args) == value`` pairs of one test, so
there is no explode, no shuffle and no hot key. A corpus of any size is one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions.literals import closed_form, number
from pairforge.functions.programmes import values_of
from pairforge.functions.rules import (
    first_reason,
    has_forbidden_tokens,
    has_leading_zero,
    is_blank,
    outcome_of,
    rhs_allowed,
)
from pairforge.functions.text import as_col, def_name, is_arithmetic_family, let, strip
from pairforge.session import settle

# def name(params): return left op right, on one line or with an indented body;
# optional annotations and docstring. Group 3 is the indentation.
CLOSED_FORM = (
    r"\A(?:[ \t\n]*\n)?def[ \t]+([A-Za-z_]\w*)[ \t]*\(([^()]*)\)[ \t]*(?:->[ \t]*[\w.]+[ \t]*)?:"
    r"(?:[ \t]*|[ \t\n]*\n([ \t]+)(?:\"\"\"[^\"]*\"\"\"[ \t\n]*\n\3)?)"
    r"return[ \t]+(\(?)[ \t]*([\w.]+)[ \t]*(\*\*|//|[-+*/])[ \t]*([\w.]+)[ \t]*(\)?)\s*\z"
)


# Of a call and what it equals: everything before the value, with the arguments.
CALL_HEAD = r"\A[^(]*\(([^)]*)\)\s*==\s*"


def closed_form_of(source: Column | str) -> Column:
    """struct<name, params, left, op, right> of a one-operation function, else NULL."""
    source = as_col(source)
    # One match gives all groups: name, params, left, op, right, parentheses.
    groups = F.split(F.regexp_replace(source, CLOSED_FORM, "\x01$1\x01$2\x01$5\x01$6\x01$7\x01$4$8"), "\x01")

    def body(g: Column) -> Column:
        return F.struct(
            F.get(g, F.lit(1)).alias("name"), F.transform(F.split(F.get(g, F.lit(2)), ","), strip).alias("params"),
            F.get(g, F.lit(3)).alias("left"), F.get(g, F.lit(4)).alias("op"), F.get(g, F.lit(5)).alias("right"),
            ((F.size(g) == 7) & (F.get(g, F.lit(0)) == "") & F.get(g, F.lit(6)).isin("", "()")).alias("matched"),
        )

    def check(f: Column) -> Column:
        simple = F.forall(f["params"], lambda p: p.rlike(r"\A[A-Za-z_]\w*(\s*:\s*[\w.]+)?\z"))
        names = F.transform(f["params"], lambda p: F.regexp_extract(p, r"\A\w+", 0))
        form = F.struct(
            f["name"].alias("name"), names.alias("params"), f["left"].alias("left"), f["op"].alias("op"),
            f["right"].alias("right"),
        )
        distinct = F.size(F.array_distinct(names)) == F.size(f["params"])
        return F.when(f["matched"] & simple & distinct, form)

    return F.when(~source.contains("\x01"), let(let(groups, body), check))


def pair_pattern(name: Column, word_boundary: bool = True) -> Column:
    """Three groups: everything before the value, the arguments, the value."""
    start = r"((?<![\p{L}\p{N}_])" if word_boundary else "("
    return F.concat(F.lit(start), name, F.lit(r"\(([^)]*)\)\s*==\s*)([^\s;]+)"))


def assert_pairs(test: Column | str, name: Column | str, word_boundary: bool = True) -> Column:
    """array<struct<head, args, rhs>> of every ``name(args) == rhs`` in the test."""
    # The pattern of a name is another one for every row: one search a test, its matches are cut by fixed patterns.
    found = F.regexp_extract_all(as_col(test), pair_pattern(as_col(name), word_boundary), F.lit(0))

    def cut(pair: Column) -> Column:
        def parts(v: Column) -> Column:
            return F.struct(
                v["head"].alias("head"), F.regexp_extract(v["head"], CALL_HEAD, 1).alias("args"),
                F.substring(v["pair"], F.length(v["head"]) + 1, F.length(v["pair"])).alias("rhs"),
            )

        return let(F.struct(pair.alias("pair"), F.regexp_extract(pair, CALL_HEAD, 0).alias("head")), parts)

    return F.transform(found, cut)


def rewrite_rhs(test: Column, name: Column, heads: Column, values: Column) -> Column:
    """The test with the value of its i-th pair replaced by ``values[i]``, whatever
    the spacing: text between the pairs is put back around the new values."""

    def body(v: Column) -> Column:
        between = F.transform(
            v["heads"],
            lambda head, i: F.concat(head, F.get(v["values"], i), F.get(v["gaps"], i + 1)),
        )
        return F.concat(F.get(v["gaps"], F.lit(0)), F.array_join(between, ""))

    gaps = F.split(test, pair_pattern(name))
    return let(F.struct(gaps.alias("gaps"), heads.alias("heads"), values.alias("values")), body)


def verify_pairs(pairs: Column, form: Column) -> Column:
    """array<struct<head, args, rhs, status, value>> with ``status`` one of ok /
    corrected / raises / unverifiable; ``value`` is what the call really gives."""

    def operand(side: str, v: Column) -> Column:
        at = v["of"][f"{side}_at"]
        given = strip(F.get(v["given"], (at - 1).cast("int")))
        return let(F.when(at > 0, given).otherwise(v["of"]["form"][side]), number)

    def check(pair: Column, of: Column) -> Column:
        def verdict(v: Column) -> Column:
            # A wrong number of plain arguments is a TypeError.
            n_given = F.when(strip(pair["args"]) == "", 0).otherwise(F.size(v["given"]))
            plain = F.forall(v["given"], lambda a: ~a.rlike(r"[=*\"'\[{(]") & (strip(a) != "")) | (n_given == 0)
            wrong_count = (n_given != F.size(v["of"]["form"]["params"])) & plain
            result = closed_form(v["of"]["form"]["op"], operand("left", v), operand("right", v))
            result = F.struct(result.alias("r"), wrong_count.alias("wrong_count"))

            def judged(j: Column) -> Column:
                r = j["r"]
                return F.struct(
                    pair["head"].alias("head"),
                    pair["args"].alias("args"),
                    pair["rhs"].alias("rhs"),
                    F.when(j["wrong_count"] | r["raises"], "raises")
                    .when(~r["known"], "unverifiable")
                    .when(r["text"] == pair["rhs"], "ok")
                    .otherwise("corrected")
                    .alias("status"),
                    F.when(~j["wrong_count"], r["text"]).alias("value"),
                )

            return let(result, judged)

        return let(F.struct(F.split(pair["args"], ",").alias("given"), of.alias("of")), verdict)

    def unknown(pair: Column) -> Column:
        return F.struct(
            pair["head"].alias("head"), pair["args"].alias("args"), pair["rhs"].alias("rhs"),
            F.lit("unverifiable").alias("status"), F.lit(None).cast("string").alias("value"),
        )

    def checked(of: Column) -> Column:
        known = F.transform(of["pairs"], lambda p: check(p, of))
        return F.when(of["form"].isNull(), F.transform(of["pairs"], unknown)).otherwise(known)

    def placed(v: Column) -> Column:
        # Where the operands stand among the parameters is told once, not for every pair.
        places = [F.array_position(v["form"]["params"], v["form"][side]).alias(f"{side}_at") for side in ("left", "right")]
        return let(F.struct(v["pairs"].alias("pairs"), v["form"].alias("form"), *places), checked)

    return let(F.struct(pairs.alias("pairs"), form.alias("form")), placed)


def settle_open_pairs(df: DataFrame, function: str = "input", name: str = "func_name", pairs: str = "pairs") -> DataFrame:
    """Values for pairs that :func:`verify_pairs` left unverifiable, where the function is straight
    arithmetic (:func:`~pairforge.functions.programmes.values_of`). Rows without such a pair send
    nothing to Python; what stays open stays ``unverifiable``."""

    def is_open(p: Column) -> Column:
        return p["status"] == "unverifiable"

    calls = F.transform(pairs, lambda p: F.when(is_open(p), F.concat(F.col(name), F.lit("("), p["args"], F.lit(")"))))
    sent = settle(
        df.withColumn("_source", F.when(F.exists(pairs, is_open), F.col(function))).withColumn("_calls", F.array(calls)),
        "_source", "_calls",
    )
    valued = settle(sent.withColumn("_values", F.get(values_of("_source", F.col("_calls")), F.lit(0))), "_values")

    def settled(p: Column, v: Column) -> Column:
        status = (
            F.when(~F.coalesce(v["status"].isin("ok", "raises"), F.lit(False)), p["status"])
            .when(v["status"] == "raises", "raises")
            .when(v["value"] == p["rhs"], "ok")
            .otherwise("corrected")
        )
        return F.struct(
            p["head"].alias("head"), p["args"].alias("args"), p["rhs"].alias("rhs"), status.alias("status"),
            F.coalesce(p["value"], v["value"]).alias("value"),
        )

    known = F.when(F.col("_values").isNull(), F.col(pairs)).otherwise(F.zip_with(pairs, "_values", settled))
    return valued.withColumn(pairs, known).drop("_source", "_calls", "_values")


def with_verified_pairs(df: DataFrame, function: str = "input", test: str = "output", mode: str = "strict") -> DataFrame:
    """Add ``func_name``, ``form`` (closed form or NULL) and ``pairs`` (verified)."""
    flat = F.replace(F.col(test), F.lit("\n"), F.lit(" "))
    verified = (
        df.withColumn("func_name", def_name(function))
        .withColumn("form", closed_form_of(function))
        .withColumn("flat", flat)
        .withColumn(
            "pairs",
            F.when(
                is_arithmetic_family("func_name"),
                verify_pairs(assert_pairs("flat", "func_name", mode == "strict"), F.col("form")),
            ),
        )
    )
    return settle_open_pairs(settle(verified, "form", "pairs"), function)


def any_status(status: str) -> Column:
    return F.exists("pairs", lambda p: p["status"] == status)


def audit_base(pairs: DataFrame, mode: str = "strict") -> DataFrame:
    """Keep / correct / reject / quarantine arithmetic pairs.

    In: ``input``, ``output`` (``read_error`` if the frame comes from
    :func:`read_pairs`). Out: ``output`` holds the audited test, plus ``outcome``
    (kept / rejected / quarantined), ``reason`` and ``note``.

    ``strict`` (default) always checks that the function is safe and rewrites wrong
    values whatever their spacing. ``compat`` follows the older line-by-line tool:
    safety only matters when the test has pairs, decimals count as leading zeros, and
    ``f(1, 2) == 9`` keeps its wrong value because only the unspaced text is replaced.
    """
    strict = mode == "strict"
    if "read_error" not in pairs.columns:
        pairs = pairs.withColumn("read_error", F.lit(None).cast("string"))
    # The reader turns blank lines and bad JSON into read errors; an empty input is
    # simply a text without a function.
    df = with_verified_pairs(pairs, mode=mode)
    arithmetic = F.coalesce(is_arithmetic_family("func_name"), F.lit(False))
    has_pairs = F.size("pairs") > 0

    # Only functions without a closed form need the parser.
    safe = F.col("form").isNotNull() | fx.is_single_function(
        fx.extract_code_facts(F.when(arithmetic & F.col("form").isNull(), F.col("input")))
    )
    unsafe = has_forbidden_tokens("input")
    not_single = ~F.coalesce(F.col("_single"), F.lit(True))
    if not strict:
        unsafe, not_single = has_pairs & unsafe, has_pairs & not_single

    allowed = rhs_allowed(F.transform("pairs", lambda p: p["rhs"]))
    rhs_bad = F.exists("_allowed", lambda ok: ~ok)
    fixed = _audited_text(strict)
    rules = [
        ("no_function", F.col("func_name").isNull()),
        ("not_a_def", arithmetic & ~strip("flat").startswith("def ")),
        ("forbidden_token", arithmetic & unsafe),
        ("not_single_function", arithmetic & not_single),
        ("rhs_not_allowed", arithmetic & rhs_bad),
        ("raises", arithmetic & any_status("raises")),
        ("leading_zero", arithmetic & has_leading_zero("_fixed", mode)),
        ("unverifiable", arithmetic & any_status("unverifiable")),
    ]
    reason = F.coalesce("read_error", first_reason(rules))
    note = (
        F.when(F.col("reason").isNotNull(), F.lit(None).cast("string"))
        .when(~arithmetic, "unchecked_family")
        .when(~has_pairs, "no_pairs")
        .when(any_status("corrected"), "corrected")
        .otherwise("ok")
    )
    kept_arithmetic = arithmetic & (F.col("outcome") == "kept")
    judged = (
        df.withColumns({"_single": safe, "_allowed": allowed})
        .withColumn("_fixed", fixed)
        .withColumn("reason", reason)
        .withColumn(
            "outcome",
            F.when(F.col("reason") == "unverifiable", "quarantined").otherwise(outcome_of(F.col("reason"))),
        )
        .withColumn("note", note)
        .withColumn("output", F.when(kept_arithmetic, F.col("_fixed")).otherwise(F.col("output")))
        .drop("flat", "form", "pairs", "_single", "_allowed", "_fixed")
    )
    return settle(judged, "outcome", "reason", "note", "output")


def _audited_text(strict: bool) -> Column:
    """The flattened test with wrong values corrected."""
    values = F.transform("pairs", lambda p: F.when(p["status"] == "corrected", p["value"]).otherwise(p["rhs"]))
    if strict:
        heads = F.transform("pairs", lambda p: p["head"])
        rewritten = rewrite_rhs(F.col("flat"), F.col("func_name"), heads, values)
        return F.when(any_status("corrected"), rewritten).otherwise(F.col("flat"))
    # The older tool replaces the literal text 'f(args)==rhs', everywhere, pair by pair.
    return F.aggregate(
        F.filter("pairs", lambda p: p["status"] == "corrected"),
        F.col("flat"),
        lambda text, p: F.replace(
            text,
            F.concat(F.col("func_name"), F.lit("("), p["args"], F.lit(")=="), p["rhs"]),
            F.concat(F.col("func_name"), F.lit("("), p["args"], F.lit(")=="), p["value"]),
        ),
    )


def audit_edge(pairs: DataFrame) -> DataFrame:
    """Light structural checks for edge-case pairs. Adds ``outcome`` and ``reason``."""
    if "read_error" not in pairs.columns:
        pairs = pairs.withColumn("read_error", F.lit(None).cast("string"))
    usable = F.col("read_error").isNull()
    func, test = F.col("_func"), F.col("_test")
    reason = F.coalesce(
        "read_error",
        first_reason([
            ("empty_field", is_blank("input") | is_blank("output")),
            ("no_function", ~func["parse_ok"] | (F.size(func["functions"]) == 0)),
            ("test_syntax", ~test["parse_ok"]),
            ("no_test_function", ~test["has_nested_test"]),
            ("no_check", (fx.n_asserts(test) == 0) & (test["raises_calls"] == 0)),
            ("no_reference", ~F.arrays_overlap(test["names"], fx.function_names(func, include_tests=True))),
        ]),
    )
    judged = (
        pairs.withColumns({
            "_func": fx.extract_code_facts(F.when(usable, strip("input"))),
            "_test": fx.extract_code_facts(F.when(usable, strip("output"))),
        })
        .withColumn("reason", reason)
        .withColumn("outcome", outcome_of(F.col("reason")))
        .drop("_func", "_test")
    )
    return settle(judged, "outcome", "reason")


def audit_summary(audited: DataFrame) -> DataFrame:
    """Rows per outcome and reason (partial counts before the shuffle)."""
    return audited.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def partition_check(source: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """Lines lost or invented by a split, with their balance: empty when kept ∪ rejected =
    source. Signed counts are shuffled by a 128-bit hash of the line; the lines themselves are
    fetched only for hashes that do not balance."""
    columns = source.columns

    def hashed(df: DataFrame) -> DataFrame:
        return df.select(*columns, F.xxhash64(*columns).alias("_h"), F.xxhash64(F.lit(1), *columns).alias("_g"))

    parts = [(hashed(df), sign) for df, sign in ((source, 1), (kept, -1), (rejected, -1))]
    signed, lines = None, None
    for df, sign in parts:
        one = df.select("_h", "_g", F.lit(sign).alias("_sign"))
        signed, lines = (one, df) if signed is None else (signed.unionByName(one), lines.unionByName(df))
    off = signed.groupBy("_h", "_g").agg(F.sum("_sign").alias("balance")).filter("balance <> 0")
    return lines.join(off, ["_h", "_g"]).dropDuplicates(["_h", "_g"]).select(*columns, "balance")
