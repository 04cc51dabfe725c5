"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight. A source takes every
document for its complete epochs, and what is left of its budget in order of the keys, by prefix
sums of sizes. Prefix sums run over ranges of the key that hold alike many documents whatever
their weights: a key of weight w lies below k with probability 1 - exp(-w k), so the share of
a source below k follows from a histogram of its weights. A source with a third of all rows is
spread like any other. The keys come from hashes: reruns agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import durable, words
from pairforge.llm.hashing import Words, batches, utf8
from pairforge.operators.ranking import running_totals

#: Weights of the sources in order, repeating; the most epochs of any source.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Documents whose keys share a range, about.
RANGE_ROWS = 4096
#: Parts that the rows of a source are dealt to where they meet its budget.
PARTS = 200
#: Classes of the histogram of weights for a factor of e; weights from 0.05 to 1.05 make at most 40.
CLASSES = 12

_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[0x20, 0x0A, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@F.arrow_udf(T.StructType([T.StructField("size", T.LongType()), T.StructField("weight", T.DoubleType())]))
def _measure(column: pa.Array) -> pa.Array:
    """Words of a text, and a weight from 0.05 to 1.05: the squared share of bytes in lower-case
    letters, letters beyond ASCII, spaces and line ends."""
    rows = utf8(column)
    size, weight = [], []
    for part in batches(rows):
        w = Words(rows[part])
        lengths = np.fromiter(map(len, rows[part]), dtype=np.int64, count=len(w.first) - 1)
        plain = np.concatenate([[0], np.cumsum(_PLAIN[w.data])])
        begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]])
        share = (plain[begin + lengths] - plain[begin]) / np.maximum(lengths, 1)
        size.append(np.diff(w.first))
        weight.append(0.05 + share**2)
    both = [np.concatenate(x) if x else np.zeros(0) for x in (size, weight)]
    return pa.StructArray.from_arrays([pa.array(both[0].astype(np.int64)), pa.array(both[1])], ["size", "weight"])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Budgets of sources (source, source_size, n_docs): ``number`` (its place by code point,
    null last) and ``target``. Targets share the sum of all sizes by weight; those above
    ``epochs`` times the source's size stop there and the rest is shared anew. One row per
    source is all that meets in a task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    cap = F.lit(epochs) * F.col("source_size").cast("double")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    listed = sizes.withColumn("number", place).withColumn("w", weight).withColumn("cap", cap).withColumn("full", F.col("cap") / F.col("w"))
    # In order of the level at which a source is full, the first whose level lies above the
    # level that spends the rest of the budget on it and all later ones ends the filling.
    by_level = Window.orderBy("full", "number")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "w"
    ).over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = listed.withColumn("level", level).withColumn("at", F.row_number().over(by_level))
    ending = F.min(F.when(F.col("level") <= F.col("full"), F.struct("at", "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.least(ending * F.col("w"), F.col("cap"))).select(
        "source", "source_size", "n_docs", "number", "target"
    )


def weight_classes(weighted: DataFrame, by: str) -> DataFrame:
    """Per ``by`` the histogram ``weights`` of its rows: mean weight and number of rows ``n`` of
    every class of nearly equal weights, a few dozen at most."""
    grouped = weighted.groupBy(by, F.floor(F.log("weight") * CLASSES).alias("class")).agg(
        F.avg("weight").alias("weight"), F.count("*").alias("n")
    )
    return grouped.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("weight", "n"))).alias("weights"))


def ranged(placed: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Replace ``weights`` (:func:`weight_classes` of the row's source, of ``n_docs`` rows) by
    ``range``, a monotone function of ``key`` that holds about ``rows`` rows of the source."""
    above = F.aggregate("weights", F.lit(0.0), lambda rest, c: rest + c["n"] / F.col("n_docs") * F.exp(-c["weight"] * F.col("key")))
    return placed.withColumn("range", F.floor((1 - above) * F.ceil(F.col("n_docs") / rows))).drop("weights")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): ``size`` (words), ``source_size``, ``target``
    of its source and ``taken``, the words the mix takes, repeats counted; ``text_hash`` tells
    rows with the same doc_id apart.

    The document on which a budget ends is taken in part, so a source misses its target by less
    than one word. Null and empty texts have size 0 and nothing taken; a null source is a source
    of its own, last in order. Equal rows tie on their key and share alike words in any order."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + 0.5) / F.lit(2.0**53)
    rows = durable(
        docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", "source", F.xxhash64("text").alias("text_hash"), _measure("text").alias("m"))
        .select("doc_id", "source", "text_hash", "m.size", "m.weight", (-F.log(u) / F.col("m.weight")).alias("key"))
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # The histogram travels with the budget: a join of its own by number would leave all rows of
    # a source in one task, and the windows below would stay there.
    classes = weight_classes(rows, "source").withColumnRenamed("source", "like")
    budgets = targets(sizes, weights, epochs).join(classes, F.col("source").eqNullSafe(F.col("like")), "left").drop("like")
    budgets = budgets.withColumnRenamed("source", "of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    dealt = budgets.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PARTS)).cast("int"))
    met = salted.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    placed = met.drop("salt", "part").withColumn("whole", whole)
    ranked = running_totals(
        ranged(placed), ["number"], [F.col("key"), F.col("doc_id"), F.col("text_hash")],
        F.col("range"), {"before": F.col("size")},
    )
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6)
    part = F.least(F.col("size").cast("double"), F.greatest(F.lit(0.0), rest - F.col("before")))
    return ranked.select(
        "doc_id", "text_hash", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.floor(part)).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each row as often as its taken words hold it
    whole, and one copy cut to the words left over (joined by one space, ``n_chars`` following)
    where a budget ends. Rows with equal doc_id and text are taken together."""
    def named(c):
        return F.coalesce(c, F.lit(-(2**63))).alias("_id")

    plan = mix_plan(docs, weights, epochs, seed).groupBy(named(F.col("doc_id")), F.col("text_hash").alias("_key"), F.col("size").alias("_size")).agg(
        F.sum("taken").alias("_taken")
    )
    keyed = docs.select(F.struct("*").alias("_row"), named(F.col("doc_id")), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    once = keyed.join(plan.where("_taken > 0"), ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    copies, left = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    none = F.array().cast("array<int>")
    counts = F.concat(
        F.when(copies > 0, F.array_repeat(F.lit(None).cast("int"), copies)).otherwise(none), F.when(left > 0, F.array(left)).otherwise(none)
    )
    each = once.select("_row", F.explode(counts).alias("_words"))
    cut = F.array_join(F.slice(words(F.col("_row.text")), 1, F.col("_words")), " ")
    changed = {"text": cut, "n_chars": F.length(cut).cast("long")}

    def column(name):
        own = F.col("_row")[name]
        return F.when(F.col("_words").isNull(), own).otherwise(changed[name]).alias(name) if name in changed else own.alias(name)

    return each.select(*[column(c) for c in docs.columns])
