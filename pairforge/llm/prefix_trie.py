"""Prefix trie of conversations by the Euler-tour technique.

Conversations that begin with the same turns share trie nodes. A turn is a row (conversation,
depth, two 64-bit hashes of depth, role and text); the prefix of depth d is the exclusive-or of
its turns' hashes, a running total, so a conversation of any length is dealt over many tasks.
Equality of prefixes rests on these 128 bits and the depth.

The tour enters every node, visits its children and exits again: 2 arcs a node.

1. A *run* is a stretch of nodes that only one child follows and no conversation ends in: all
   have the same members, so (smallest member, members) names it. Its arcs are consecutive, so
   it takes part in the tour as one enter arc and one exit arc of its length.
2. Arcs are linked: enter to the first child's enter, exit to the next sibling's enter or the
   parent's exit. Siblings are linked within ranges of run ids, then between ranges.
3. The list is ranked (``list_rank``): every arc jumps by pointer doubling to the next sampled
   arc, the sampled arcs form a list ``SPARSE`` times shorter that is ranked the same way.
4. Leaves and savings of a subtree are differences of prefix sums, taken over all arcs in
   order of position: totals of position ranges first, then sums within a range."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import durable

#: One arc in so many is sampled for the shorter list; so few arcs are ranked by one task.
SPARSE, FEW = 64, 2048
#: Turns, conversations, siblings or positions that one range spans.
RANGE, POSITIONS = 4096, 65536

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (0-based, by turn, null first), ``content`` (hash of role and text),
    ``n_bytes`` of the text. Turns of one number are in order of role and content; rows without
    conv_id belong to no conversation. Sorted over ranges, so that no task holds a whole
    conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("content"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "content", "row"]
    ranged = durable(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0))
    ).drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return ranged.withColumn("place", place).join(before, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") + F.col("before")).cast("long").alias("pos"), "content", "n_bytes"
    )


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c again: the first h turns of c - c % ``family`` (fewer if it has fewer), then
    its own after its first h, with h = crc32(c in decimal) % ``most``. Returns ``conv_id``,
    ``n_turns`` of each conversation, and ``conv_id``, ``depth`` (from 1), content and bytes of each turn."""
    sizes = durable(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = sizes.select(
        "conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ).join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = durable(convs.withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0)))))
    first = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base").join(
        convs.select("base", "conv_id", "lent"), "base"
    ).where("pos < lent").select("conv_id", (F.col("pos") + 1).alias("depth"), "content", "n_bytes")
    rest = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("lent") + F.col("pos") - F.col("h") + 1).alias("depth"), "content", "n_bytes"
    )
    n_turns = F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv_id", n_turns.alias("n_turns")), first.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn: ``conv_id``, ``depth``, the prefix it ends (``x``, ``y``), the one before it
    (``px``, ``py``) and ``n_bytes``."""
    own = turns.select(
        "conv_id", "depth", "n_bytes", F.floor(F.col("depth") / RANGE).alias("range"),
        F.xxhash64("content", "depth").alias("ex"), F.xxhash64(F.lit("second"), "depth", "content").alias("ey"),
    )
    totals = own.groupBy("conv_id", "range").agg(F.bit_xor("ex").alias("tx"), F.bit_xor("ey").alias("ty"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(*_BEFORE)
    before = totals.select(
        "conv_id", "range", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(b) for t, b in (("tx", "bx"), ("ty", "by"))]
    )
    within = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(*_SO_FAR)
    summed = own.withColumns({"x": F.bit_xor("ex").over(within), "y": F.bit_xor("ey").over(within)}).join(before, ["conv_id", "range"])
    x, y = F.col("x").bitwiseXOR(F.col("bx")), F.col("y").bitwiseXOR(F.col("by"))
    return summed.select(
        "conv_id", "depth", "n_bytes", x.alias("x"), y.alias("y"),
        x.bitwiseXOR(F.col("ex")).alias("px"), y.bitwiseXOR(F.col("ey")).alias("py"),
    )


def _digests(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, joined by commas; rows are sorted by node and id range."""
    node, digest = None, None
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    for t in tables:
        out = []
        for *key, ids in zip(*(t[c].to_pylist() for c in ("depth", "x", "y", "ids")), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if node is not None:
        last = (*node, digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, schema, strict=True)], schema=schema)


def _ends(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end in a node. Ids are joined by ranges first,
    so a node in which many end is a sorted stream of long strings, hashed as it comes."""
    last = steps.select("conv_id", "depth", "x", "y").union(convs.where("n_turns = 0").select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    ended = last.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"])
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = ended.groupBy("depth", "x", "y", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(ids.alias("ids"))
    return ranges.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "range").mapInArrow(
        _digests, "depth long, x long, y long, ends_sha256 string"
    )


def trie_nodes(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a node: ``conv_id`` (its smallest member), ``depth``, ``n_convs``, ``saved`` of its
    last text, ``ends_sha256``, and its parent's ``parent_conv_id`` and ``parent_n_convs``."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    found = steps.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
        F.min("px").alias("px"), F.min("py").alias("py"),
    ).unionByName(root.select(
        "conv_id", "n_convs", *[zero.alias(c) for c in ("depth", "x", "y", "n_bytes")], *[F.lit(None).cast("long").alias(c) for c in ("px", "py")]
    ))
    nodes = durable(found.join(_ends(convs, steps), ["depth", "x", "y"], "left"))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n_convs"),
    )
    return nodes.join(above, ["depth", "px", "py"], "left").select(
        "conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "parent_conv_id", "parent_n_convs",
    )


def _runs(nodes: DataFrame) -> DataFrame:
    """``run`` id, name (``conv_id``, ``n_convs``), depths ``top`` and ``bottom``, ``parent`` run."""
    named = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"),
        # The parent of the topmost node; null for the run of the root.
        F.min(F.struct("depth", "parent_conv_id", "parent_n_convs")).alias("up"),
    ).select("conv_id", "n_convs", "top", "bottom", F.col("up.parent_conv_id").alias("pc"), F.col("up.parent_n_convs").alias("pn"))
    runs = durable(named.withColumn("run", F.monotonically_increasing_id()))
    names = runs.select(F.col("conv_id").alias("pc"), F.col("n_convs").alias("pn"), F.col("run").alias("parent"))
    return durable(runs.join(names, ["pc", "pn"], "left").drop("pc", "pn"))


def _tour(runs: DataFrame) -> DataFrame:
    """Arcs ``id`` (2 * run enters, 2 * run + 1 exits), ``next`` and ``weight``."""
    siblings = runs.where("parent is not null").select("run", "parent", F.floor(F.col("run") / RANGE).alias("range"))
    firsts = siblings.groupBy("parent", "range").agg(F.min("run").alias("first"))
    follows = firsts.withColumn("following", F.lead("first").over(Window.partitionBy("parent").orderBy("range"))).drop("first")
    after = siblings.withColumn("after", F.lead("run").over(Window.partitionBy("parent", "range").orderBy("run"))).join(
        follows, ["parent", "range"]
    ).select("run", F.coalesce("after", "following").alias("after"))
    eldest = firsts.groupBy("parent").agg(F.min("first").alias("eldest")).withColumnRenamed("parent", "run")
    linked = runs.join(after, "run", "left").join(eldest, "run", "left").withColumn("weight", F.col("bottom") - F.col("top") + 1)
    enter = F.struct((F.col("run") * 2).alias("id"), F.coalesce(F.col("eldest") * 2, F.col("run") * 2 + 1).alias("next"), "weight")
    leave = F.struct((F.col("run") * 2 + 1).alias("id"), F.coalesce(F.col("after") * 2, F.col("parent") * 2 + 1).alias("next"), "weight")
    return linked.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*")


def _walk(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    after, weight = {}, {}
    for t in tables:
        for i, n, w in zip(*(t[c].to_pylist() for c in ("id", "next", "weight")), strict=True):
            after[n], weight[i] = i, w
    ids, ranks, at, so_far = [], [], after.get(None), 0
    while at is not None:
        so_far += weight[at]
        ids.append(at), ranks.append(so_far)
        at = after.get(at)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int64())], ["id", "rest"])


def list_rank(links: DataFrame, sparse: int = SPARSE, few: int = FEW, level: int = 0) -> DataFrame:
    """``id`` and ``rest``: the weight of the list from ``id`` to its end, itself included.
    ``links``: id, next (null at the end), weight, one list. Pointer doubling stops at sampled
    ids, which come next once in ``sparse``; they form the list of the next level, until one
    has at most ``few`` links and a task walks it."""
    links = durable(links)
    if links.count() <= few:
        return links.coalesce(1).mapInArrow(_walk, "id long, rest long")

    def sampled(c: Column) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(level)), F.lit(sparse)) == 0

    def open_end(c: Column) -> Column:
        return c.isNotNull() & ~sampled(c)

    # An arc and the one that jumps over it meet in a group, not in a join: a checkpoint keeps its plan's
    # estimate of bytes, a join multiplies those of its sides, and after some 20 rounds that number alone
    # would fill the driver. Settled arcs pass through the same group, so that a round leaves no more
    # partitions than its shuffle has.
    none = F.lit(None).cast("long")
    sent = F.array(
        F.struct(F.col("id").alias("at"), "next", "weight", none.alias("from"), none.alias("before")),
        F.when(open_end(F.col("next")), F.struct(
            F.col("next").alias("at"), none.alias("next"), none.alias("weight"), F.col("id").alias("from"), F.col("weight").alias("before")
        )),
    )
    settled = F.when(~open_end(F.col("next")), F.struct(F.col("at").alias("id"), "next", "weight"))
    jumped = F.when(F.col("from").isNotNull(), F.struct(F.col("from").alias("id"), "next", (F.col("weight") + F.col("before")).alias("weight")))
    hops = links
    while not hops.where(open_end(F.col("next"))).isEmpty():
        met = hops.select(F.inline(F.array_compact(sent))).groupBy("at").agg(*[F.max(c).alias(c) for c in ("next", "weight", "from", "before")])
        hops = durable(met.where("weight is not null").select(F.inline(F.array_compact(F.array(settled, jumped)))))
    ranked = list_rank(hops.where(sampled(F.col("id"))), sparse, few, level + 1)
    rest = ranked.select(F.col("id").alias("next"), "rest")
    between = hops.where(~sampled(F.col("id"))).join(rest, "next", "left").select(
        "id", (F.col("weight") + F.coalesce("rest", F.lit(0))).alias("rest")
    )
    return ranked.union(between)


def _subtree_sums(nodes: DataFrame, places: DataFrame, spans: dict[str, Column]) -> DataFrame:
    """``conv_id``, ``depth`` and each expression summed over the node's subtree: prefix sums at
    its exit less those before its entry."""
    arcs = nodes.join(places, ["conv_id", "n_convs"]).select(
        "conv_id", "depth", *[v.alias(n) for n, v in spans.items()],
        F.explode(F.array(
            F.struct(F.lit(1).alias("way"), (F.col("enter") + F.col("depth") - F.col("top")).alias("pos")),
            F.struct(F.lit(-1).alias("way"), (F.col("leave") + F.col("bottom") - F.col("depth")).alias("pos")),
        )).alias("arc"),
    ).select("conv_id", "depth", "arc.*", *[F.when(F.col("arc.way") == 1, F.col(n)).otherwise(0).alias(n) for n in spans])
    arcs = durable(arcs.withColumn("range", F.floor(F.col("pos") / POSITIONS)))
    earlier = Window.orderBy("range").rowsBetween(*_BEFORE)
    before = arcs.groupBy("range").agg(*[F.sum(n).alias(f"b_{n}") for n in spans]).select(
        "range", *[F.coalesce(F.sum(f"b_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in spans]
    )
    within = Window.partitionBy("range").orderBy("pos").rowsBetween(*_SO_FAR)
    sums = arcs.withColumns({f"s_{n}": F.sum(n).over(within) for n in spans}).join(before, "range")
    return sums.groupBy("conv_id", "depth").agg(*[
        F.sum(F.when(F.col("way") == 1, F.col(n) - F.col(f"s_{n}") - F.col(f"b_{n}")).otherwise(F.col(f"s_{n}") + F.col(f"b_{n}"))).alias(n)
        for n in spans
    ])


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations (see ``rebuilt``), the
    textless root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that sharing saves in the subtree) and ends_sha256.

    Reads conv_id, turn, role and text. Null role or text is empty; null turns come first; turns
    of one number, repeated rows among them, all count, in order of role and content. Rows without
    conv_id belong to no conversation. No conversation: no node, not even the root."""
    convs, turns = rebuilt(durable(ordered_turns(conversations)), family, most)
    steps = durable(prefixes(turns))
    nodes = durable(trie_nodes(convs, steps))
    runs = _runs(nodes)
    ranks = list_rank(_tour(runs))
    total = nodes.count() * 2
    arc = ranks.select(F.floor(F.col("id") / 2).alias("run"), (F.col("id") % 2 == 0).alias("enters"), (F.lit(total) - F.col("rest")).alias("pos"))
    where = arc.groupBy("run").agg(F.min(F.when(F.col("enters"), F.col("pos"))).alias("enter"), F.min(F.when(~F.col("enters"), F.col("pos"))).alias("leave"))
    places = runs.join(where, "run").select("conv_id", "n_convs", "top", "bottom", "enter", "leave")
    childless = nodes.join(
        nodes.where("depth > 0").groupBy("parent_conv_id", "depth").agg(F.count("*").alias("n_children")).select(
            F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "n_children"
        ), ["conv_id", "depth"], "left",
    ).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = durable(childless)
    sums = _subtree_sums(full, places, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved")})
    return full.join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long"), "n_leaves", "saved_tokens", "ends_sha256"
    )
