"""Reproducible splits and model-ready tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.prompts import training_prompt
from pairforge.functions.text import truncate_tokens
from pairforge.session import cut_lineage

# Token limits of source and target, share and seed of the evaluation set.
SOURCE_TOKENS, TARGET_TOKENS = 512, 256
EVAL_SHARE, SEED = 0.1, 42
DIGIT_BITS = 16


def split_hash(key: Column, seed: int = SEED) -> Column:
    """First 32 bits of md5(seed:key): the same row always gets the same value, whatever
    the partitioning, the row order or later appends."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def train_eval_split(df: DataFrame, key: str, share: float = EVAL_SHARE, seed: int = SEED,
                     exact: bool = False) -> DataFrame:
    """Add ``split`` (train / eval). Default: a row-local threshold on the hash, so the
    evaluation share is met on average and nothing is shuffled.

    ``exact=True`` gives exactly ``ceil(share·n)`` evaluation rows: the cut hash is
    found by counting hash digits (at most 65 536 counters reach the driver per step),
    never by sorting the table. ``key`` must be unique then."""
    h = split_hash(F.col(key), seed)
    if not exact:
        return df.withColumn("split", F.when(h < int(share * 2**32), "eval").otherwise("train"))
    # md5 of the key breaks ties of the 32-bit hash: order by the full digest.
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    cut = _digest_at(df.select(digest.alias("d")), share)
    return df.withColumn("split", F.when(digest <= F.lit(cut), "eval").otherwise("train"))


def _digest_at(digests: DataFrame, share: float) -> str:
    """Smallest hex digest with at least ``ceil(share·n)`` digests at or below it."""
    # Read and hash the corpus once; every step counts the digests alone.
    digests = cut_lineage(digests)
    total = digests.count()
    wanted = math.ceil(total * share)
    prefix, rest = "", digests
    digits = DIGIT_BITS // 4
    while wanted > 0 and len(prefix) < 32:
        rows = (
            rest.groupBy(F.substring("d", len(prefix) + 1, digits).alias("p")).agg(F.count("*").alias("n")).collect()
        )
        for row in sorted(rows, key=lambda r: r["p"]):
            if row["n"] >= wanted:
                break
            wanted -= row["n"]
        prefix += row["p"]
        if row["n"] == wanted:
            # The cut falls on the end of this prefix: every longer digest is included.
            return prefix + "g"
        rest = digests.filter(F.col("d").startswith(prefix))
    return prefix


def prepare_training(pairs: DataFrame, mode: str = "base", key: str | None = None) -> DataFrame:
    """Prompt and label with their token counts, truncated to the model's limits. Row
    local: runs in the scan of the cleaned corpus."""
    out = pairs.withColumns({
        "_source": truncate_tokens(training_prompt("input", mode), SOURCE_TOKENS),
        "_target": truncate_tokens("output", TARGET_TOKENS),
    }).withColumns({
        "prompt": F.col("_source.text"),
        "prompt_tokens": F.col("_source.n_tokens"),
        "label": F.col("_target.text"),
        "label_tokens": F.col("_target.n_tokens"),
        "was_truncated": F.col("_source.was_truncated") | F.col("_target.was_truncated"),
    }).drop("_source", "_target")
    return out if key is None else train_eval_split(out, key)
