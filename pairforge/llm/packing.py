"""Packing into optimal length buckets.

Texts are cut into pieces of at most ``longest`` words. Their lengths make one histogram of at
most ``longest`` rows; dynamic programming over it finds the ``buckets`` padded lengths with the
least padding in all. Inside a bucket, pieces in a hashed order fill batches of a token budget.
Positions come from ranges of the hash, so no bucket meets in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import SPACE, durable, words
from pairforge.operators.ranking import with_position

LONGEST, BUCKETS, BUDGET = 2048, 8, 65_536
#: Pieces whose hashes share a range.
RANGE_ROWS = 16_384


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Padded lengths, ascending, that minimise the sum of padding; at most ``buckets``."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[x] for x in lengths], dtype=np.int64)
    count, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    size = len(lengths)
    # cost[i, j]: padding of lengths i..j-1 up to the last of them.
    cost = lengths[None, :] * (count[1:][None, :] - count[:-1][:, None]) - (words[1:][None, :] - words[:-1][:, None])
    never = np.iinfo(np.int64).max // 4
    cost = np.where(np.arange(size)[:, None] <= np.arange(size)[None, :], cost, never)
    best, cuts = cost[0].copy(), []
    for _ in range(min(buckets, size) - 1):
        ways = np.concatenate([[0], best[:-1]])[:, None] + cost
        ways[0] = cost[0]
        cut = ways.argmin(axis=0)
        cuts.append(cut)
        best = ways[cut, np.arange(size)]
    bounds, end = [], size - 1
    for cut in reversed(cuts):
        bounds.append(int(lengths[end]))
        if cut[end] == 0:
            return bounds[::-1]
        end = int(cut[end]) - 1
    return [*([int(lengths[end])]), *bounds[::-1]]


def pack(
    docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, with_text: bool = False
) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): ``piece``, ``start`` (its first word),
    ``length``, ``bucket`` (its padded length), ``batch`` (its number in the bucket).

    A text of n words has ceil(n / longest) pieces; pieces are full but the last. A batch holds
    ``budget // bucket`` pieces, one at least. Null, empty and blank texts have one piece of
    length 0 and no bucket or batch. Repeated rows are packed each; an empty table has no rows.
    ``with_text`` adds ``row`` (a number of the input row, so that copies of a document can be
    told apart and fall into batches of their own) and ``text``, the piece's words joined by one space."""
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.split(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), " ")).cast("long")
    own = {"row": F.monotonically_increasing_id(), "_key": F.xxhash64(text)} if with_text else {}
    more = list(own)
    sized = docs.select("doc_id", *[c.alias(k) for k, c in own.items()], F.when(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "", 0).otherwise(n).alias("n"))
    pieces = durable(
        sized.select("doc_id", *more, "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / longest) - 1).cast("int"))).alias("piece"))
        .select("doc_id", *more, "piece", (F.col("piece").cast("long") * longest).alias("start"),
                F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"))
    )
    histogram = {r["length"]: r["count"] for r in pieces.where("length > 0").groupBy("length").count().collect()}
    bounds = best_bounds(histogram, buckets)
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("length") <= bound, bound).otherwise(bucket)
    dealt = pieces.withColumn("bucket", F.when(F.col("length") > 0, bucket).cast("long")).withColumn(
        "_order", F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", "piece", *more), 1)
    )
    ranges = max(1, sum(histogram.values()) // RANGE_ROWS)
    placed = with_position(
        dealt.where("length > 0").withColumnRenamed("bucket", "_in"), ["_in"], [F.col("_order"), F.col("doc_id"), F.col("piece"), F.col("length"), *[F.col(c) for c in more]],
        F.floor(F.col("_order") / F.lit(2.0**63 / ranges)), "_position",
    )
    batch = F.floor(F.col("_position") / F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_in"))))
    columns = ["doc_id", *more, "piece", "start", "length", "bucket"]
    packed = placed.select(*columns[:-1], F.col("_in").alias("bucket"), batch.alias("batch")).union(
        dealt.where("length = 0").select(*columns, F.lit(None).cast("long").alias("batch"))
    )
    if not with_text:
        return packed
    known = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text")).dropDuplicates(["_id", "_hash"])
    spelled = packed.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")))
    piece_text = F.array_join(F.slice(words(F.col("_text")), (F.col("start") + 1).cast("int"), F.greatest(F.lit(0), F.col("length")).cast("int")), " ")
    return spelled.select("doc_id", "row", "piece", "start", "length", "bucket", "batch", piece_text.alias("text"))
