"""Quality rules as weak supervision, in DataFrame functions only.

Rules over counts of a text vote good or bad, or abstain. Expectation-maximisation over the
patterns of votes estimates how often each rule is right; a document's posterior probability of being good replaces a demand that it pass every rule.

Counts come from array functions on the row itself: nothing is exploded or shuffled but one
row per vote pattern, of which there are at most 2 ** 7. Each iteration is an aggregate over
them, and only two sums for each rule come to the driver."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import SPACE, WORD, durable

WINDOW = 8
#: Iterations at most; they end when no accuracy moves by more than STILL.
ITERATIONS, STILL = 12, 1e-3
#: Accuracy where estimation starts, votes that count for it, and where it stays within.
START, PSEUDO, BOUNDS = 0.85, 10, (0.55, 0.99)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, whatever refers to them later: Catalyst does not
    fold a projection across a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def covered_words(sorted_starts: Column, size: int = WINDOW) -> Column:
    """Words covered by the windows that start at ``sorted_starts``."""
    steps = F.transform(
        sorted_starts, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(sorted_starts, i + 1) - p, F.lit(size)))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)


def counts(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper, n_distinct. A null or empty text has none of anything.

    A line counts when it holds a word; it is a duplicate when an earlier line is equal.
    Repeated words are those in windows of ``size`` words found twice or more in the text."""
    base = _once(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), _h=F.transform(
        F.array_remove(F.split("_text", f"{SPACE}+"), ""), lambda w: F.xxhash64(w)
    ))
    n_windows = F.greatest(F.lit(0), F.size("_h") - (size - 1))
    windows = F.transform(
        F.slice(F.col("_h"), 1, n_windows),
        lambda h, i: F.xxhash64(*[h if k == 0 else F.get(F.col("_h"), i + k) for k in range(size)]),
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    staged = _once(
        base, _windows=windows, _lines=lines, n_words=F.size("_h").cast("long"),
        word_chars=F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long"),
        n_symbols=F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
        n_upper=F.length(F.regexp_replace("_text", r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long"),
        n_distinct=F.size(F.array_distinct("_h")).cast("long"),
    )
    again = F.size("_windows") > F.size(F.array_distinct("_windows"))
    # Only texts with a repeat sort their windows.
    staged = _once(staged, _sorted=F.when(again, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.filter(
        F.transform("_sorted", lambda x, i: F.when(
            (F.get(F.col("_sorted"), i - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), i + 1)["h"] == x["h"]), x["i"]
        )),
        lambda p: p.isNotNull(),
    )
    staged = _once(staged, _starts=F.array_sort(pairs))
    return staged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered_words(F.col("_starts"), size), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper", "n_distinct",
    )


def votes() -> dict[str, Column]:
    """The rules: -1 bad, 1 good, 0 abstains. Rules that look for one fault abstain where they
    do not find it, since other faults remain; only text without any oddity is voted good."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    symbols, upper, repeats = F.col("n_symbols") / n, F.col("n_upper") / chars, F.col("n_repeat_words") / n
    mean, variety = F.col("word_chars") / n, F.col("n_distinct") / F.sqrt(n)
    faults = {
        "v_symbols": symbols > 0.1,
        "v_upper": upper > 0.3,
        "v_repeats": repeats > 0.3,
        "v_lines": (F.col("n_lines") > 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "v_length": (F.col("n_words") > 0) & ((mean < 2.5) | (mean > 12)),
        "v_variety": (F.col("n_words") >= 40) & (variety < 3),
    }
    plain = (symbols < 0.01) & (upper < 0.08) & (repeats < 0.02) & (F.col("n_dup_lines") == 0) & (F.col("n_words") >= 20) & (variety > 4)
    return {**{name: F.when(bad, -1).otherwise(0) for name, bad in faults.items()}, "v_plain": F.when(plain, 1).otherwise(0)}


def _posterior(accuracy: dict[str, float]) -> Column:
    """Probability of good: each vote weighs the log-odds of its rule being right; without
    votes it is one half."""
    odds = F.lit(0.0)
    for name, a in accuracy.items():
        odds = odds + F.col(name) * F.lit(log(a / (1 - a)))
    return 1 / (1 + F.exp(-odds))


def learn(patterns: DataFrame, names: list[str], iterations: int = ITERATIONS) -> dict[str, float]:
    """Accuracy of each rule (the share of its votes that are right), by expectation-maximisation
    over rows of (votes, n): posteriors of the patterns, then expected right votes. Good and bad
    weigh alike before any vote. ``PSEUDO`` votes at the start value keep rules that never vote
    where they were, and accuracies stay within BOUNDS."""
    spark = patterns.sparkSession
    listed = durable(
        patterns.coalesce(1).select(
            F.concat_ws(",", *names).alias("pattern"), "n",
            F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(v).alias("vote")) for i, v in enumerate(names)])).alias("v"),
        ).select("pattern", "n", "v.*").where("vote <> 0")
    )
    accuracy = {name: START for name in names}
    for _ in range(iterations):
        # Weights are a table of one row per rule, so every iteration is the same plan.
        weights = F.broadcast(_small_table(spark, [(i, log(a / (1 - a))) for i, a in enumerate(accuracy.values())], {"rule": "int", "weight": "double"}))
        good = listed.join(weights, "rule").groupBy("pattern").agg(F.sum(F.col("vote") * F.col("weight")).alias("odds"))
        right = 1 / (1 + F.exp(-F.col("vote") * F.col("odds")))
        sums = listed.join(good, "pattern").groupBy("rule").agg(F.sum(F.col("n") * right).alias("right"), F.sum("n").alias("all"))
        found = {r["rule"]: (r["right"], r["all"]) for r in sums.collect()}
        before, accuracy = accuracy, {}
        for i, name in enumerate(names):
            hits, cast = found.get(i, (0.0, 0))
            accuracy[name] = min(max((hits + PSEUDO * START) / (cast + PSEUDO), BOUNDS[0]), BOUNDS[1])
        if max(abs(accuracy[n] - before[n]) for n in names) < STILL:
            break
    return accuracy


def _small_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A bounded table, as literals of a one-row frame."""
    items = [F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, columns.items(), strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def judge(docs: DataFrame) -> DataFrame:
    """``counts`` of every row of ``docs``, its votes, and ``posterior``: the probability that
    the text is good, by what expectation-maximisation learned from all rows. Null and empty
    texts vote like any other; repeated rows count each."""
    rules = votes()
    names = list(rules)
    voted = durable(counts(docs).withColumns(rules))
    accuracy = learn(voted.groupBy(*names).agg(F.count("*").alias("n")), names)
    return voted.withColumn("posterior", _posterior(accuracy))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)
