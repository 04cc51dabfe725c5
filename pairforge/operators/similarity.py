"""Is a regenerated test really different from the one it replaces?

Pairs come from a key the caller joins on (each candidate meets exactly its previous
test); nothing is compared all against all. Two upper bounds of the similarity ratio
run as column expressions and settle most pairs; only the rest reaches Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions import facts as fx
from pairforge.functions.text import as_col, let, similarity_key
from pairforge.session import settle

SIMILAR = 0.88
RENAME = 0.58
# Library predicates a predicate rename never touches.
KEPT_PREDICATES = ("isinstance", "issubclass", "isfinite", "isnan", "isinf")


def length_bound(a: Column | str, b: Column | str) -> Column:
    """2·min(len)/(len+len): the ratio cannot be larger."""
    la, lb = F.length(as_col(a)), F.length(as_col(b))
    return F.try_divide(2.0 * F.least(la, lb), (la + lb).cast("double"))


def overlap_bound(a: Column | str, b: Column | str) -> Column:
    """2·|common characters|/(len+len): shared characters counted with multiplicity.
    The ratio cannot be larger, because matching blocks use each character once."""

    def body(v: Column) -> Column:
        def count(text: Column, char: Column) -> Column:
            return F.length(text) - F.length(F.replace(text, char, F.lit("")))

        common = F.aggregate(
            F.array_distinct(F.split(v["a"], "")),
            F.lit(0),
            lambda total, char: F.when(char == "", total).otherwise(
                total + F.least(count(v["a"], char), count(v["b"], char))
            ),
        )
        return F.try_divide(2.0 * common, (F.length(v["a"]) + F.length(v["b"])).cast("double"))

    return let(F.struct(as_col(a).alias("a"), as_col(b).alias("b")), body)


#: Ratios that a task keeps for equal pairs that follow: so many characters, then it starts anew.
KEPT_CHARS = 2_000_000
_KEPT_RATIOS: dict = {}


def _ratio(x: str, y: str) -> float:
    if (x, y) not in _KEPT_RATIOS:
        _KEPT_RATIOS["chars"] = _KEPT_RATIOS.get("chars", 0) + len(x) + len(y)
        if _KEPT_RATIOS["chars"] > KEPT_CHARS:
            _KEPT_RATIOS.clear()
        _KEPT_RATIOS[x, y] = SequenceMatcher(None, x, y).ratio()
    return _KEPT_RATIOS[x, y]


@F.arrow_udf(T.DoubleType())
def _ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    out = [None if x is None or y is None else _ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(out, type=pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _ratios_udf(names: pa.Array, target: pa.Array) -> pa.Array:
    out = [
        None if xs is None or y is None else [_ratio(x, y) for x in xs]
        for xs, y in zip(names.to_pylist(), target.to_pylist())
    ]
    return pa.array(out, type=pa.list_(pa.float64()))


def exact_ratio(a: Column | str, b: Column | str) -> Column:
    """Matching-blocks ratio of two texts. It depends on the order of its arguments
    (previous first) and treats frequent characters of long texts specially."""
    return _ratio_udf(as_col(a), as_col(b))


def with_similarity(pairs: DataFrame, previous: str, candidate: str, threshold: float = SIMILAR) -> DataFrame:
    """Add ``too_similar`` to rows that hold a previous and a candidate text.

    Equal keys are similar, a bound below the threshold is not; the exact ratio is
    computed for what is left. NULL reaches Python for settled rows, so they cost
    nothing there."""
    keyed = pairs.withColumns({"_a": similarity_key(previous), "_b": similarity_key(candidate)})
    settled = (
        F.when((F.col("_a") == "") | (F.col("_b") == ""), F.lit(False))
        .when(F.col("_a") == F.col("_b"), F.lit(True))
        .when(length_bound("_a", "_b") < threshold, F.lit(False))
        .when(overlap_bound("_a", "_b") < threshold, F.lit(False))
    )
    open_pair = F.col("_settled").isNull()
    ratio = exact_ratio(F.when(open_pair, F.col("_a")), F.when(open_pair, F.col("_b")))
    compared = (
        settle(keyed.withColumn("_settled", settled), "_settled", "_a", "_b")
        .withColumn("_ratio", ratio)
        .withColumn("too_similar", F.coalesce(F.col("_settled"), F.col("_ratio") >= threshold))
        .drop("_a", "_b", "_settled", "_ratio")
    )
    return settle(compared, "too_similar")


def too_similar(previous: DataFrame, candidates: DataFrame, on: list[str], previous_text: str = "previous",
                candidate_text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """Candidates joined with the previous test of their key, plus ``too_similar``.
    There is one previous test per key, so the join never multiplies rows and a key
    with very many candidates can be split by the adaptive skew join."""
    joined = candidates.join(previous.select(*on, previous_text), on, "left")
    filled = joined.withColumn(previous_text, F.coalesce(previous_text, F.lit("")))
    return with_similarity(filled, previous_text, candidate_text, threshold)


def exact_duplicates(tests: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """Per test its group of texts that are equal but for layout, comments and case: ``representative``
    (the smallest id with the same similarity key) and ``copies`` (tests of the group).

    Groups are found by a 128-bit hash of the key, so no text is shuffled, and a group of any
    size is one aggregated row that joins back. A null text, or one that holds nothing but comments, is similar to nothing: it
    is its own representative. Rows without an id belong to a group without being its representative."""
    key = similarity_key(F.coalesce(F.col(text), F.lit("")))
    keyed = tests.select(F.col(id_column), F.when(key != "", F.md5(key)).alias("_key"))
    settled = settle(keyed, "_key")
    groups = settled.where("_key is not null").groupBy("_key").agg(F.min(id_column).alias("representative"), F.count("*").alias("copies"))
    return settled.join(groups, "_key", "left").select(
        id_column, F.when(F.col("_key").isNull(), F.col(id_column)).otherwise(F.col("representative")).alias("representative"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def same_call_args(previous: Column, candidate: Column, name: Column) -> Column:
    """Both tests (facts) call the target with the same multiset of literal arguments."""

    def body(v: Column) -> Column:
        return (F.size(v["a"]) > 0) & (F.size(v["b"]) > 0) & (v["a"] == v["b"])

    return let(
        F.struct(fx.literal_calls(previous, name).alias("a"), fx.literal_calls(candidate, name).alias("b")), body
    )


def settled_rename(called: Column, target: Column, threshold: float = RENAME) -> Column:
    """Is the call meant for the target? NULL when only the exact ratio can tell."""
    name, goal = F.lower(called), F.lower(target)
    kept_predicate = name.isin(*KEPT_PREDICATES)
    return (
        F.when(called == target, F.lit(True))
        .when(called == F.replace(target, F.lit("_"), F.lit("")), F.lit(True))
        .when(target.startswith("is_") & name.startswith("is") & ~kept_predicate, F.lit(True))
        .when(length_bound(name, goal) < threshold, F.lit(False))
        .when(overlap_bound(name, goal) < threshold, F.lit(False))
    )


def fuzzy_rename(calls: DataFrame, called: str = "name", target: str = "target", threshold: float = RENAME) -> DataFrame:
    """Add ``renamed``: the target for a call whose name is close enough, its own name
    otherwise. A predicate target (``is_…``) takes any ``is*`` call but library ones;
    a name equal to the target without underscores is the target."""
    name, goal = F.lower(called), F.lower(target)
    settled = settled_rename(F.col(called), F.col(target), threshold)
    open_pair = F.col("_settled").isNull()
    return (
        calls.withColumn("_settled", settled)
        .withColumn("_ratio", exact_ratio(F.when(open_pair, name), F.when(open_pair, goal)))
        .withColumn(
            "renamed",
            F.when(F.coalesce("_settled", F.col("_ratio") >= threshold), F.col(target)).otherwise(F.col(called)),
        )
        .drop("_settled", "_ratio")
    )


def rename_calls_to_target(df: DataFrame, text: str, target: str, threshold: float = RENAME) -> DataFrame:
    """Apply :func:`fuzzy_rename` to all bare-name calls of each test and rewrite the text.
    The calls of a test stay in an array of its row. Text that does not parse only gets
    the plain rule (the target written without its underscores)."""
    plain = F.concat(F.lit(r"\b"), F.replace(F.col(target), F.lit("_"), F.lit("")), F.lit(r"\b"))
    named = settle(df.withColumn(text, F.regexp_replace(F.col(text), plain, F.col(target))), text)
    facts = fx.extract_code_facts(text)
    calls = F.transform(F.filter(F.col("_facts.calls"), lambda c: c["kind"] == "name"), lambda c: c["name"])
    verdicts = F.transform("_names", lambda n: settled_rename(n, F.col(target), threshold))
    undecided = F.exists("_verdicts", lambda v: v.isNull())
    lowered = F.when(undecided, F.transform("_names", F.lower))
    close = F.transform(
        F.arrays_zip(F.col("_names").alias("n"), F.col("_verdicts").alias("v"), F.col("_ratios").alias("r")),
        lambda p: F.struct(p["n"].alias("old"), F.coalesce(p["v"], p["r"] >= threshold).alias("hit")),
    )
    hits = F.transform(F.filter(close, lambda p: p["hit"] & (p["old"] != F.col(target))), lambda p: p["old"])
    return (
        settle(named.withColumn("_facts", facts).withColumn("_names", F.array_distinct(calls)).drop("_facts"), "_names")
        .withColumn("_verdicts", verdicts)
        .withColumn("_ratios", F.coalesce(_ratios_udf(lowered, F.lower(target)), F.array().cast("array<double>")))
        .withColumn("_hits", hits)
        .withColumn(text, rename_calls(text, F.col("_hits"), F.transform("_hits", lambda _: F.col(target))))
        .drop("_names", "_verdicts", "_ratios", "_hits")
    )


def rename_calls(text: Column | str, names: Column, renamed: Column) -> Column:
    """Rewrite ``name(`` to ``renamed(`` for parallel arrays of call names."""
    return F.aggregate(
        F.arrays_zip(names.alias("old"), renamed.alias("new")),
        as_col(text),
        lambda t, p: F.regexp_replace(
            t, F.concat(F.lit(r"(?<![\w.])"), p["old"], F.lit(r"(?=\s*\()")), p["new"]
        ),
    )
