"""Submissions to test blocks. Candidates are an input table: generating them is a
model's work, choosing among them is ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions import facts as fx
from pairforge.functions.prompts import generation_prompt
from pairforge.functions.rules import PARSER_REASONS, TEXT_REASONS, admission_rules, expects_strings, first_reason, route_prompt, submission_mode
from pairforge.functions.text import function_name_or_default
from pairforge.operators.blocks import (
    GENERATED_ORIGIN,
    REGENERATED_ORIGIN,
    merge_snippets,
    previous_test,
    split_tests,
)
from pairforge.operators.candidates import (
    REGEN_NOTHING,
    REGEN_ORIGIN,
    REGEN_REUSED_ORIGIN,
    clean_candidates,
    first_passing,
    gate_candidates,
    strip_foreign_asserts,
    with_fallback,
    with_forms,
    with_origin,
    with_presets,
)
from pairforge.operators.similarity import same_call_args, with_similarity
from pairforge.session import settle, written
from pairforge.sources.source_files import decode_source


def admit(submissions: DataFrame) -> DataFrame:
    """Add ``code``, ``mode``, ``input_method``, ``facts`` and ``reason`` to submissions with
    ``pasted_code`` and ``file_bytes`` (and ``n_items`` / ``item_limit`` if known)."""
    pasted = F.col("pasted_code")
    is_paste = F.coalesce(pasted != "", F.lit(False))
    quota = (F.col("n_items"), F.col("item_limit")) if "n_items" in submissions.columns else (None, None)
    rules = admission_rules(pasted, F.col("file_bytes"), F.col("_text"), F.col("facts"), *quota)
    # Only uploads that pass the rules on bytes and the paste are decoded for the next one.
    early = first_reason([r for r in rules if r[0] not in TEXT_REASONS + PARSER_REASONS])
    df = settle(submissions.withColumn("_early", early), "_early")
    df = df.withColumn("code", F.when(is_paste, pasted).otherwise(decode_source("file_bytes")))
    df = df.withColumn("_text", F.when(F.col("_early").isNull(), F.col("code")))
    # The parser only sees texts that pass every cheaper rule. Reason and text are settled ahead of it:
    # rows wait beside a Python function with every column that is read after it, so an upload
    # that is read by the cheap rules alone must not be one of them.
    cheap = F.coalesce("_early", first_reason([r for r in rules if r[0] in TEXT_REASONS]))
    df = df.withColumn("input_method", F.when(is_paste, "paste").otherwise("upload")).withColumn("_cheap", cheap)
    df = settle(df.withColumn("_sent", F.when(cheap.isNull(), F.col("_text"))).drop("_early", "_text"), "_cheap", "_sent")
    df = df.withColumn("facts", fx.extract_code_facts("_sent"))
    reason = F.coalesce("_cheap", first_reason([r for r in rules if r[0] in PARSER_REASONS]))
    mode = submission_mode("mode") if "mode" in df.columns else F.lit("base")
    return settle(df.withColumn("reason", reason).withColumn("mode", mode).drop("_cheap", "_sent"), "reason", "facts")


def functions(sources: DataFrame, code: str = "code", facts: str = "facts") -> DataFrame:
    """One row per top-level non-test function: ``pos``, ``func_name``, ``func_src``. A text
    without any keeps one row under its fallback name."""
    found = fx.user_functions(F.col(facts))
    whole = F.array(F.struct(
        F.lit(0).alias("pos"), function_name_or_default(code).alias("name"), F.col(code).alias("src"),
        F.lit(0).alias("n_args"), F.lit(False).alias("is_test"), F.lit(None).cast("string").alias("op"),
    ))
    rows = F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole))
    kept = [c for c in sources.columns if c != facts]
    return sources.select(*kept, rows.alias("pos", "_f")).select(
        *kept, "pos", F.col("_f.name").alias("func_name"), F.col("_f.src").alias("func_src"),
        F.col("_f.n_args").alias("n_args"), F.col("_f.op").alias("op"),
    )


def generation_requests(admitted: DataFrame) -> DataFrame:
    """Prompt and decoding parameters per function of the admitted submissions."""
    per_function = functions(admitted.filter(F.col("reason").isNull()))
    routed = per_function.withColumn("_facts", fx.extract_code_facts("func_src")).withColumn(
        "route", route_prompt("func_name", "func_src", F.col("_facts"))
    ).drop("_facts")
    return with_presets(
        routed.withColumn("prompt", generation_prompt("route", "func_name", "func_src")), "func_src"
    )


def _digest(columns: list[str]) -> Column:
    """128 bits of the columns, NULLs told from texts."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def _judged_once(offered: DataFrame, by: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The offered candidates with the ``text`` and ``reason`` that ``judge`` gives their columns
    ``by``, which is all a verdict depends on.

    The same function and candidate are offered by many submissions, and cleaning, parsing and
    proving them is nearly all the work: it is done once for each distinct row of ``by``, in a
    table that is written once. Verdicts join back by a digest of the row: one row per key on
    their side, so a candidate offered very often is split by the adaptive skew join."""
    pairs = written(offered.select(*by).distinct(), "pairs")
    judged = judge(pairs.withColumn("_pair", _digest(by))).select("_pair", "text", "reason")
    return offered.withColumn("_pair", _digest(by)).drop(*[c for c in by if c != "func_name"]).join(judged, "_pair").drop("_pair")


def _with_known(pairs: DataFrame) -> DataFrame:
    """Add what belongs to the function of a pair, computed once for it: closed form, probes, whether
    it takes texts."""
    by = ["func_name", "func_src", "op"]
    forms = with_forms(pairs.select(*by).distinct()).withColumn("_strings", expects_strings("func_src"))
    forms = settle(forms.withColumn("_function", _digest(by)), "_function", "_strings")
    forms = forms.select("_function", "form", "form_src", "probed", "_strings")
    return pairs.withColumn("_function", _digest(by)).join(forms, "_function").drop("_function")


def choose_tests(
    requests: DataFrame, candidates: DataFrame, keys: list[str], mode: str = "base", unverifiable: str = "refuse"
) -> DataFrame:
    """The test of every requested function: the first candidate that passes the structural
    rules and is true, else the fallback. ``unverifiable="accept"`` also takes tests that
    cannot be computed from a closed form."""
    named = [*keys, "func_name"]
    asked = requests.withColumn("op", F.col("op") if "op" in requests.columns else F.lit(None).cast("string"))
    offered = candidates.join(asked.select(*named, "func_src", "op").dropDuplicates(named), named)

    def judge(pairs: DataFrame) -> DataFrame:
        cleaned = clean_candidates(_with_known(pairs), strings="_strings").drop("_strings")
        if mode != "edge":
            cleaned = strip_foreign_asserts(cleaned)
        return gate_candidates(cleaned, mode, "generate", unverifiable=unverifiable)

    gated = _judged_once(offered, ["func_name", "func_src", "op", "text"], judge)
    chosen = with_origin(first_passing(gated, named))
    joined = requests.select(*keys, "pos", "func_name").join(chosen, [*keys, "func_name"], "left")
    return with_fallback(joined)


def merge_by_submission(tests: DataFrame, keys: list[str], origin: str = GENERATED_ORIGIN) -> DataFrame:
    """One block per submission. A submission is one text of limited size, so its
    functions fit into an array. A single test stays as it is."""
    return (
        tests.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_tests"))
        .withColumn("_texts", F.transform("_tests", lambda t: t["text"]))
        .withColumn(
            "generated_tests",
            F.when(F.size("_texts") == 1, F.get("_texts", F.lit(0))).otherwise(merge_snippets("_texts", origin)),
        )
        .drop("_tests", "_texts")
    )


def regenerate(
    items: DataFrame, candidates: DataFrame, item_id: str = "id", code: str = "source_code",
    tests: str = "generated_tests", mode: str = "base", unverifiable: str = "refuse",
) -> DataFrame:
    """New block per item from sampled candidates (``item_id``, ``func_name``, ``stage``,
    ``idx``, ``text``). A candidate too close to the earlier test, or calling the target
    with the same arguments, or not true (see :func:`choose_tests`), is refused; without any
    left, the earlier test stays."""
    parsed = settle(items.select(item_id, F.col(code).alias("code"), F.coalesce(tests, F.lit("")).alias("block")).withColumn(
        "facts", fx.extract_code_facts("code")
    ), "facts")
    # With several functions each one meets its own slice of the earlier block.
    names = fx.function_names(F.col("facts"))
    sliced = parsed.withColumn("n_functions", F.size(names)).withColumn(
        "slices", F.when(F.size(names) > 1, split_tests("block", names))
    )
    per_function = functions(sliced.filter(F.col("n_functions") > 0)).select(
        item_id, "pos", "func_name", "n_functions", "func_src", "op",
        F.when(F.col("n_functions") > 1, previous_test(F.col("slices"), "func_name"))
        .otherwise(F.col("block"))
        .alias("previous"),
    )
    keys = [item_id, "func_name"]
    functions_ = per_function.select(*keys, "previous", "func_src", "op").dropDuplicates(keys)
    offered = candidates.join(functions_, keys)

    def judge(pairs: DataFrame) -> DataFrame:
        cleaned = clean_candidates(_with_known(pairs), strings="_strings").drop("_strings")
        compared = with_similarity(strip_foreign_asserts(cleaned), "previous", "text")
        parsed = compared.withColumns({"_cand": fx.extract_code_facts("text"), "_prev": fx.extract_code_facts("previous")})
        same_args = same_call_args(F.col("_prev"), F.col("_cand"), F.col("func_name"))
        compared = settle(parsed.withColumn("_same_args", same_args).drop("_prev", "_cand"), "_same_args")
        gated = gate_candidates(compared, mode, "regenerate", unverifiable=unverifiable)
        return gated.withColumn(
            "reason",
            F.when(F.col("reason") == "syntax", "syntax")
            .when(F.col("too_similar"), "too_similar")
            .when(F.col("_same_args"), "same_call_args")
            .otherwise(F.col("reason")),
        )

    gated = _judged_once(offered, ["func_name", "func_src", "op", "previous", "text"], judge)
    best = first_passing(gated, keys)
    text = F.coalesce(
        F.concat(F.lit(REGEN_ORIGIN), F.col("text")), F.concat(F.lit(REGEN_REUSED_ORIGIN), F.col("previous"))
    )
    per_test = per_function.join(best, keys, "left").withColumn("text", text)
    merged = merge_by_submission(per_test, [item_id], REGENERATED_ORIGIN)
    untouched = sliced.filter(F.col("n_functions") == 0).select(
        item_id, F.coalesce(F.nullif("block", F.lit("")), F.lit(REGEN_NOTHING)).alias("generated_tests")
    )
    return merged.unionByName(untouched)
