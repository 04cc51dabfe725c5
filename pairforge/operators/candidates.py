"""Candidate tests: decoding presets, gates, first passing candidate, fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions.constants import FALLBACK_TESTS, PRESETS, PROBES
from pairforge.functions.literals import is_close, number
from pairforge.functions.programmes import values_of
from pairforge.functions.rules import first_reason, keep_target_asserts, structural_rules, task_kind
from pairforge.functions.text import (
    as_col,
    clean_layout,
    ensure_import,
    fill_name,
    let,
    smoke_test,
    standardize_test,
    unwrap_quotes,
    wrap_as_test,
)
from pairforge.operators.audit import assert_pairs, closed_form_of, verify_pairs
from pairforge.operators.compare import asserts_hold
from pairforge.operators.similarity import rename_calls_to_target
from pairforge.session import settle

STAGE_BEAM, STAGE_SAMPLING = 1, 2
# Origin lines put above a chosen test.
ORIGIN = {STAGE_BEAM: "# Origin: Beams \n", STAGE_SAMPLING: "# Origin : sampling \n"}
REGEN_ORIGIN = "# Origin: Regen (sampling)\n"
REGEN_REUSED_ORIGIN = "# Origin: Regen (fallback - reused previous)\n"
REGEN_NOTHING = "# Origin: Regen (noop - no functions found)\n"
# The test of a function without a template of its own.
CALLABLE_TEST = "def test_{name}():\n    # model could not produce a valid passing test yet\n    assert callable({name})\n"


# --- dimension tables: constants of this module, so their size is known -------------


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRESETS, "kind string, beam_candidates int, num_beams int, sample_candidates int, temperature double, top_k int"
    )


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBES, "family string, a double, b double, expected double")


def fallbacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FALLBACK_TESTS.items()), "func_name string, test_src string")


# --- joins with them -------------------------------------------------------------------


def with_presets(df: DataFrame, code: str = "code", overrides: dict[str, str] | None = None) -> DataFrame:
    """Add ``kind`` and the decoding parameters of that kind; ``overrides`` maps a
    parameter to a column of the frame that wins where it is not NULL."""
    names = [f for f in presets(df.sparkSession).columns if f != "kind"]
    dim = presets(df.sparkSession).select("kind", *[F.col(n).alias(f"_p_{n}") for n in names])
    joined = df.withColumn("kind", task_kind(code)).join(F.broadcast(dim), "kind", "left")
    chosen = {n: F.coalesce(F.col((overrides or {}).get(n, f"_p_{n}")), F.col(f"_p_{n}")) for n in names}
    return joined.withColumns(chosen).drop(*[f"_p_{n}" for n in names])


def regeneration_budget(kind: Column, samples: Column, temperature: Column, top_k: Column) -> Column:
    """Sampling parameters of a regeneration, by kind of task."""
    text = kind == "string"
    return F.struct(
        F.greatest(samples, F.when(text, 16).otherwise(8)).alias("sample_candidates"),
        F.when(text, F.greatest(temperature, F.lit(0.95))).otherwise(F.least(temperature, F.lit(0.8))).alias("temperature"),
        F.when(text, F.greatest(top_k, F.lit(120))).otherwise(F.least(top_k, F.lit(40))).alias("top_k"),
    )


def with_fallback(df: DataFrame, text: str = "text", func_name: str = "func_name") -> DataFrame:
    """Where ``text`` is NULL: the template of exactly that function, else a callable check."""
    dim = fallbacks(df.sparkSession).select(F.col("func_name").alias("_fallback_name"), F.col("test_src").alias("_fallback"))
    shell = fill_name(CALLABLE_TEST, func_name)
    filled = F.coalesce(F.col(text), ensure_import(F.coalesce("_fallback", shell)))
    return (
        df.join(F.broadcast(dim), F.col(func_name) == F.col("_fallback_name"), "left")
        .withColumn(text, filled)
        .drop("_fallback_name", "_fallback")
    )


def probe_families(functions: DataFrame, family: str, value_of: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per function with ``passes``: every probe of its family gives the expected
    value (tolerant). ``value_of(a, b)`` is the closed form of the function as a column.
    Families without probes pass. The probes of a family stay in one array, so the
    table is not multiplied by them and nothing is shuffled."""
    dim = (
        probes(functions.sparkSession).groupBy(F.col("family").alias("_family"))
        .agg(F.collect_list(F.struct("a", "b", "expected")).alias("_probes"))
    )
    holds = F.forall(
        "_probes", lambda p: F.coalesce(is_close(value_of(p["a"], p["b"]), p["expected"]), F.lit(False))
    )
    return (
        functions.join(F.broadcast(dim), F.lower(family) == F.col("_family"), "left")
        .withColumn("passes", F.coalesce(holds, F.lit(True)))
        .drop("_family", "_probes")
    )


def apply_op(op: Column, a: Column, b: Column) -> Column:
    """``a op b`` on doubles; NULL instead of an error."""
    return (
        F.when(op == "+", a + b)
        .when(op == "-", a - b)
        .when(op == "*", a * b)
        .when(op == "/", F.try_divide(a, b))
        .when(op == "//", F.floor(F.try_divide(a, b)).cast("double"))
        .when((op == "**") & ~((a == 0) & (b < 0)), F.pow(a, b))
    )


# --- truth --------------------------------------------------------------------------------


def _value_of(form: Column) -> Callable[[Column, Column], Column]:
    """The closed form of a function of two parameters as a column of its arguments."""

    def value(a: Column, b: Column) -> Column:
        def operand(which: Column) -> Column:
            at = F.array_position(form["params"], which)
            return F.when(at == 1, a).when(at == 2, b).when(at == 0, which.try_cast("double"))

        return apply_op(form["op"], operand(form["left"]), operand(form["right"]))

    return value


def with_forms(functions: DataFrame, code: str = "func_src", name: str = "func_name") -> DataFrame:
    """Add ``form`` (closed form or NULL), the code as ``form_src`` and ``probed``: false where the function has a closed
    form of two parameters and it fails a probe of the operation it seems to be (``op`` inferred
    from its code, else its name)."""
    formed = settle(functions.withColumn("form", closed_form_of(code)), "form")
    kind = F.coalesce(F.col("op"), F.lower(name)) if "op" in functions.columns else F.lower(name)
    probed = probe_families(formed.withColumn("_kind", kind), "_kind", _value_of(F.col("form")))
    known = F.col("form").isNotNull() & (F.size("form.params") == 2)
    judged = probed.withColumn("probed", ~known | F.col("passes")).withColumn("form_src", F.col(code))
    return settle(judged.drop("passes", "_kind"), "form", "probed")


def truth_reason(text: Column, facts: Column, target: Column, form: Column, probed: Column) -> Column:
    """Why a test is not known to hold, NULL when every assert of it is proven.

    ``raises``: a call with these arguments fails; ``wrong_value``: a call gives another value
    than the test says (numbers are compared with tolerance); ``probe_failed``: the function
    does not do what its operation should; ``unverifiable``: some assert cannot be computed."""

    def body(pairs: Column) -> Column:
        def wrong(p: Column) -> Column:
            close = is_close(number(p["value"])["d"], number(p["rhs"])["d"])
            literal = number(p["rhs"])["d"].isNotNull() | p["rhs"].rlike(r"\A(True|False|None|'[^']*'|\"[^\"]*\")\z")
            return (p["status"] == "corrected") & literal & ~F.coalesce(close, F.lit(False))

        def open_(p: Column) -> Column:
            return (p["status"] == "unverifiable") | ((p["status"] == "corrected") & number(p["rhs"])["d"].isNull())

        return (
            F.when(F.exists(pairs, lambda p: p["status"] == "raises"), "raises")
            .when(F.exists(pairs, wrong), "wrong_value")
            .when(~probed, "probe_failed")
            .when(F.exists(pairs, open_) | (F.size(pairs) != fx.n_asserts(facts)) | (F.size(pairs) == 0), "unverifiable")
        )

    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return let(verify_pairs(assert_pairs(flat, target), form), body)


def values_reason(facts: Column, target: Column, values: Column, probed: Column) -> Column:
    """:func:`truth_reason` for asserts of any form, once each side is reduced to a value:
    reversed sides, orders, chains, arithmetic around calls, ``pytest.approx`` with its default
    tolerance. ``values`` holds, per assert of the facts, the values of its sides. A side that
    stays open, a block that expects an exception, or a call outside the asserts makes the test
    ``unverifiable``, unless another assert is known to fail."""

    def one(a: Column, v: Column) -> Column:
        left, right = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        near = F.exists(v, lambda s: s["near"])
        # The tolerance is a share of the side that is marked, 1e-12 at least.
        actual, expected = (
            F.when(left["near"], y["exact"]).otherwise(x["exact"]).try_cast("double") for x, y in ((left, right), (right, left))
        )
        within = (actual == expected) | (F.abs(actual - expected) <= F.greatest(F.abs(expected) * 1e-6, F.lit(1e-12)))
        plain = F.struct(a["ops"].alias("ops"), F.transform(v, lambda s: s["exact"]).alias("sides"))
        # Neither an infinity nor an integer beyond the range of doubles is compared.
        beyond = F.exists(v, lambda s: s["exact"].startswith("float(") | F.coalesce(F.abs(s["exact"].try_cast("double")) == float("inf"), F.lit(False)))
        told = (
            ~F.exists(v, lambda s: s["status"] != "ok")
            & ~beyond
            & ~F.array_contains(a["ops"], "other")
            & (~near | ((F.size(v) == 2) & F.get(a["ops"], F.lit(0)).isin("==", "!=") & ~(left["near"] & right["near"])))
        )
        return F.struct(
            F.exists(v, lambda s: s["status"] == "raises").alias("raises"),
            told.alias("told"),
            F.when(near, within == (F.get(a["ops"], F.lit(0)) == "==")).otherwise(asserts_hold(F.array(plain))).alias("holds"),
        )

    def mine(names: Column) -> Column:
        return F.size(F.filter(names, lambda n: n == target))

    def body(checks: Column) -> Column:
        calls = F.size(F.filter(facts["calls"], lambda c: (c["kind"] == "name") & (c["name"] == target)))
        in_asserts = F.aggregate(facts["asserts"], F.lit(0), lambda n, a: n + mine(a["call_names"]))
        return (
            F.when(F.exists(checks, lambda c: c["raises"]), "raises")
            .when(F.exists(checks, lambda c: c["told"] & ~F.coalesce(c["holds"], F.lit(False))), "wrong_value")
            .when(~probed, "probe_failed")
            .when(
                F.exists(checks, lambda c: ~c["told"]) | (F.size(checks) == 0) | (facts["raises_withs"] > 0) | (calls != in_asserts),
                "unverifiable",
            )
        )

    return let(F.zip_with(facts["asserts"], values, one), body)


def strip_foreign_asserts(df: DataFrame, text: str = "text", target: str = "func_name") -> DataFrame:
    """Drop module-level asserts that do not call the target, where another one does; without
    any that does, the text stays and the gate judges it. Only texts with an assert in column
    0 are parsed."""
    facts = F.col("_facts")
    parsed = settle(df.withColumn("_facts", fx.extract_code_facts(F.when(F.col(text).rlike(r"(?m)^assert\b"), F.col(text)))), "_facts")
    keep = keep_target_asserts(facts, F.col(target))
    gone = F.array_except(F.transform(F.filter(facts["asserts"], lambda a: a["top_level"]), lambda a: a["src"]), keep)
    lines = F.aggregate(
        gone, F.concat(F.lit("\n"), F.col(text), F.lit("\n")),
        lambda t, src: F.replace(t, F.concat(F.lit("\n"), src, F.lit("\n")), F.lit("\n")),
    )
    cut = F.when(F.size(gone) > 0, F.regexp_replace(lines, r"\A\n|\n\z", "")).otherwise(F.col(text))
    return settle(parsed.withColumn(text, cut).drop("_facts"), text)


# --- candidates -------------------------------------------------------------------------


def sanitize(df: DataFrame, text: str = "text", name: str = "func_name") -> DataFrame:
    """Clean layout, then replace what still does not parse by a callable check."""
    checked = settle(df.withColumn("_clean", clean_layout(text, name)), "_clean").withColumn("_ok", fx.parses("_clean"))
    cleaned = checked.withColumn(text, F.when(F.col("_ok"), F.col("_clean")).otherwise(smoke_test(name)))
    return settle(cleaned.drop("_clean", "_ok"), text)


def clean_candidates(df: DataFrame, text: str = "text", name: str = "func_name", strings: str | None = None) -> DataFrame:
    """Raw model output to a test: outer quotes off, wrapped if it is only a body, header and
    spacing standardised, calls renamed to the target, sanitised, import on top. Where the
    boolean column ``strings`` is true, numbers given to the target become texts."""
    raw = F.coalesce(F.col(text), F.lit(""))
    standard = standardize_test(wrap_as_test(unwrap_quotes(raw), name), name)
    renamed = rename_calls_to_target(settle(df.withColumn(text, standard), text), text, name)
    if strings is not None:
        texts = fx.numbers_to_text(F.when(F.col(strings), F.col(text)), name)
        renamed = settle(renamed.withColumn(text, F.coalesce(texts, F.col(text))), text)
    return sanitize(renamed, text, name).withColumn(text, ensure_import(text))


def union_stages(*stages: DataFrame) -> DataFrame:
    """Candidates of all stages as one relation with ``stage`` 1, 2, …"""
    out = None
    for number, df in enumerate(stages, 1):
        staged = df.withColumn("stage", F.lit(number))
        out = staged if out is None else out.unionByName(staged)
    return out


def gate_candidates(candidates: DataFrame, mode: str = "base", flow: str = "generate",
                    text: str = "text", target: str = "func_name", unverifiable: str = "refuse", **limits) -> DataFrame:
    """Add ``reason`` (NULL = passes): the first structural rule a candidate breaks, then, where
    the frame has ``form`` and ``probed`` of the function (:func:`with_forms`), why it is not
    true; with ``form_src`` too, asserts of other forms are computed where the first look leaves
    a test open. Tests whose asserts cannot be computed are refused as ``unverifiable``, or pass with
    ``unverifiable="accept"``."""
    if unverifiable not in ("refuse", "accept"):
        raise ValueError(f"unverifiable is 'refuse' or 'accept', not {unverifiable!r}")
    facts = F.col("_facts")
    reason = first_reason(structural_rules(F.col(text), facts, F.col(target), mode, flow, **limits))
    parsed = settle(candidates.withColumn("_facts", fx.extract_code_facts(text)), "_facts")
    gated = settle(parsed.withColumn("reason", reason), "reason")
    if "form" in candidates.columns:
        truth = truth_reason(F.col(text), facts, F.col(target), F.col("form"), F.col("probed"))
        gated = settle(gated.withColumn("_truth", F.when(F.col("reason").isNull(), truth)), "_truth")
        if "form_src" in candidates.columns:
            open_ = F.col("_truth") == "unverifiable"
            sides = F.transform(facts["asserts"], lambda a: a["sides"])
            sent = settle(gated.withColumn("_sides", F.when(open_, sides)), "_sides")
            gated = settle(sent.withColumn("_values", values_of("form_src", F.col("_sides"))), "_values")
            second = values_reason(facts, F.col(target), F.col("_values"), F.col("probed"))
            gated = gated.withColumn("_truth", F.when(F.col("_values").isNull(), F.col("_truth")).otherwise(second)).drop("_sides", "_values")
        truth = F.col("_truth") if unverifiable == "refuse" else F.nullif(F.col("_truth"), F.lit("unverifiable"))
        gated = settle(gated.withColumn("reason", F.coalesce("reason", truth)), "reason").drop("_truth")
    return gated.drop("_facts")


def first_passing(gated: DataFrame, targets: list[str], text: str = "text") -> DataFrame:
    """Per target the first passing candidate by (stage, idx): one aggregate with
    map-side partial results, so a target with very many candidates is no hot spot.
    ``text`` and ``stage`` are NULL when none passed."""
    passing = F.when(F.col("reason").isNull(), F.struct("stage", "idx"))
    best = F.min_by(F.struct("stage", "idx", text), passing)
    return gated.groupBy(*targets).agg(
        best.alias("_best"), F.count("*").alias("n_candidates")
    ).select(*targets, "n_candidates", "_best.stage", "_best.idx", F.col(f"_best.{text}").alias(text))


def with_origin(chosen: DataFrame, text: str = "text") -> DataFrame:
    """Prefix a chosen candidate with the line that names its stage."""
    labels = F.when(F.col("stage") == STAGE_BEAM, ORIGIN[STAGE_BEAM]).when(
        F.col("stage") == STAGE_SAMPLING, ORIGIN[STAGE_SAMPLING]
    )
    return chosen.withColumn(text, F.concat(F.coalesce(labels, F.lit("")), F.col(text)))


def rejection_counts(gated: DataFrame, targets: list[str]) -> DataFrame:
    return gated.filter(F.col("reason").isNotNull()).groupBy(*targets, "reason").agg(F.count("*").alias("n"))


def rejection_log(gated: DataFrame, targets: list[str]) -> DataFrame:
    """(target, stage, idx, reason) of every rejected candidate: the ordered log as rows,
    sorted by target and position across the cluster."""
    return (
        gated.filter(F.col("reason").isNotNull())
        .select(*targets, "stage", "idx", "reason")
        .orderBy(*targets, "stage", "idx")
    )


def calls_target(tests: DataFrame, functions: DataFrame, on: list[str], target: str = "func_name",
                 facts: str = "facts") -> DataFrame:
    """Tests that call the function of their key at least once by its bare name."""
    names = functions.select(*on, F.col(target).alias("_target"))
    # The names alone meet the target: the facts of a test are wide, and are moved only if they are read later.
    called = F.transform(F.filter(F.col(facts)["calls"], lambda c: c["kind"] == "name"), lambda c: c["name"])
    named = settle(tests.withColumn("_called", F.array_distinct(called)), "_called")
    condition = F.array_contains("_called", F.col("_target"))
    for k in on:
        condition = (named[k] == names[k]) & condition
    return named.join(names, condition, "left_semi").select(*tests.columns)


def references_any(test_facts: Column | str, function_facts: Column | str) -> Column:
    """Any identifier of the test equals any function of the input."""
    return F.arrays_overlap(as_col(test_facts)["names"], fx.function_names(as_col(function_facts), include_tests=True))
