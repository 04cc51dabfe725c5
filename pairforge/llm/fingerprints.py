"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is its words, weighted by how often they occur. For each of ``SAMPLES`` samples every
word draws, from hashes of itself, r and c from Gamma(2, 1) and b from the unit interval; with
weight w, t = floor(ln w / r + b) and the word of least c * exp(-r * (t - b + 1)) is sampled
together with t. Two texts take the same sample with probability equal to their generalised
Jaccard similarity, the sum of smaller weights over the sum of larger ones.

Words are counted and sampled by codegen'd aggregates. A sample is one number, the order of
its word's value in the high bits and a hash of (word, t) in the low ones, so that a hash
aggregate of minima does the sampling, map side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import SPACE, durable, words

SAMPLES = 24
#: Bits of a sample that name the word and its t.
NAME_BITS = 24

_UNIT = 1 / (1 << 20)


def _draws(word: Column, k: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a word in sample ``k``: five uniforms from two hashes."""
    one, two = F.xxhash64(word, 2 * k), F.xxhash64(word, 2 * k + 1)

    def unit(h: Column, at: int) -> Column:
        return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 20) - 1)) + F.lit(0.5)) * F.lit(_UNIT)

    r = -F.log(unit(one, 0) * unit(one, 20))
    ln_c = F.log(-F.log(unit(two, 0) * unit(two, 20)))
    return r, ln_c, unit(one, 40)


def _sample(word: Column, ln_weight: Column, k: Column) -> Column:
    r, ln_c, b = _draws(word, k)
    t = F.floor(ln_weight / r + b)
    order = ln_c - r * (t - b + 1)
    name = F.xxhash64(word, t, k).bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    # The order lies far within (-512, 512) for any count; 30 bits hold its thousandths of a millionth.
    level = ((order + 512) * F.lit(float(1 << 28))).cast("long")
    return F.shiftleft(level, NAME_BITS).bitwiseOR(name)


def samples_of(counted: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """Per key of ``counted`` (keys, word: a hash, one count per column of ``weights``): an array
    of samples for each weight column. Words of weight 0 take no part; without any, the array
    holds nulls."""
    logs = counted.select(*keys, "word", *[F.log(F.col(w)).alias(w) for w in weights])
    each = logs.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    least = each.select(*keys, "k", *[_sample(F.col("word"), F.col(w), F.col("k")).alias(w) for w in weights]).groupBy(*keys, "k").agg(
        *[F.min(w).alias(w) for w in weights]
    )
    gathered = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", *weights))).alias("_all"))
    return gathered.select(*keys, *[F.col(f"_all.{w}").alias(w) for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples. Texts without words (null samples) are alike and unlike all others."""
    none_a, none_b = _wordless(a), _wordless(b)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)
    return F.when(none_a | none_b, (none_a & none_b).cast("double")).otherwise(equal)


def _wordless(samples: Column) -> Column:
    return samples.isNull() | F.get(samples, F.lit(0)).isNull()


def written(samples: Column) -> Column:
    """A fingerprint as text: the names of its samples in hexadecimal; empty without words."""
    digits = F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << NAME_BITS) - 1)))), NAME_BITS // 4, "0"))
    return F.when(_wordless(samples), "").otherwise(F.array_join(digits, ""))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``samples`` and ``fingerprint`` of its text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), _hashes(F.col("text")).alias("_w")).repartition("doc_id", "_h")
    # Equal rows would add up their words; the counts of one of them serve all.
    sizes = rows.groupBy("doc_id", "_h").agg(F.count("*").alias("_copies"))
    counted = rows.select("doc_id", "_h", F.explode("_w").alias("word")).groupBy("doc_id", "_h", "word").agg(F.count("*").alias("n"))
    counted = counted.alias("c").join(sizes.alias("s"), F.expr("c.doc_id <=> s.doc_id and c._h = s._h")).selectExpr(
        "c.doc_id", "c._h", "word", "n div _copies as n"
    )
    found = samples_of(counted, ["doc_id", "_h"], ["n"], samples)
    return sizes.alias("s").join(found.alias("f"), F.expr("s.doc_id <=> f.doc_id and s._h = f._h"), "left").select(
        "s.doc_id", F.col("f.n").alias("samples"), written(F.col("f.n")).alias("fingerprint"),
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) characters replaced by as many first characters
    of the next document, in ascending doc_id, the first following the last. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Null texts are empty ones. Rows that share a doc_id have the same next document, the one of
    the next larger doc_id (of several rows there, the one of the smallest hash); rows without
    doc_id come first. A single document is its own next."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    # Both uses of a text below read these three columns, so that it is shuffled once.
    rows = docs.select(key.alias("key"), text.alias("text"), F.xxhash64(text).alias("h"))
    # Who follows whom: ids alone, in ranges, and one row per range for what lies across.
    ids = durable(
        docs.select(key.alias("key"), F.floor(F.length(text) / 2).cast("int").alias("half")).groupBy("key").agg(F.max("half").alias("half"))
        .repartitionByRange("key").withColumn("part", F.spark_partition_id())
    )
    borders = ids.groupBy("part").agg(F.max(F.struct("key", "half")).alias("last"))
    over = Window.orderBy("part")
    borders = borders.select(
        "part", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last")
    )
    within = Window.partitionBy("part").orderBy("key")
    before = ids.withColumn("before", F.lag(F.struct("key", "half")).over(within)).join(borders, "part").select(
        "key", F.coalesce("before", "last").alias("before")
    ).select("key", F.col("before.key").alias("before"), F.col("before.half").alias("take"))
    own = rows.repartition("key").groupBy("key", "h").agg(
        F.first("text").alias("text"), F.count("*").alias("copies")
    )
    known = own.join(before, "key")
    heads = known.select(F.col("before").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"), "h").groupBy("key").agg(
        F.min_by("head", "h").alias("head"), F.min("h").alias("next_h")
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = known.join(heads, "key").select(
        "key", "h", "copies", n.cast("long").alias("n_chars"), "text",
        F.substring(F.col("text"), F.lit(1), n - half).alias("left"), F.substring(F.col("head"), F.lit(1), half).alias("head"),
    )
    details = both.select("key", "h", "copies", "n_chars", F.sha2(F.concat("left", "head"), 256).alias("edited_sha256"))
    # Words before the last space of the part that stays are in both texts; the others differ.
    core = F.regexp_extract("left", f"(?s)^.*{SPACE}", 0)
    parts = both.select("key", "h", core.alias("core"), "text", "left", "head")
    rest = F.length("core") + 1
    parts = parts.select(
        "key", "h", _hashes(F.col("core")).alias("c"), _hashes(F.substring(F.col("text"), rest, F.length("text"))).alias("t"),
        _hashes(F.concat(F.substring(F.col("left"), rest, F.length("left")), "head")).alias("e"),
    )
    listed = parts.select("key", "h", F.size("c").alias("m"), (F.size("c") + F.size("t")).alias("n"), F.posexplode(F.concat("c", "t", "e")).alias("at", "word"))
    counted = listed.groupBy("key", "h", "word").agg(
        F.sum((F.col("at") < F.col("n")).cast("long")).alias("plain"),
        F.sum(((F.col("at") < F.col("m")) | (F.col("at") >= F.col("n"))).cast("long")).alias("edited"),
    )
    found = samples_of(counted, ["key", "h"], ["plain", "edited"], samples)
    joined = durable(details.join(found, ["key", "h"], "left"))
    following = joined.join(before, "key").groupBy(F.col("before").alias("key")).agg(F.min_by("plain", "h").alias("next"))
    return joined.join(following, "key").select(
        F.nullif(F.col("key"), F.lit(-(2**63))).alias("doc_id"), "n_chars", "edited_sha256",
        written(F.col("plain")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("plain"), F.col("edited")).alias("near_edited"), likeness(F.col("plain"), F.col("next")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
