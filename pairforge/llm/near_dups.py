"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Each document keeps ``PERMUTATIONS`` minima, of which bands of ``ROWS`` make candidate keys and
the low ``BITS`` bits of all are packed into a sketch. Equal sets are one node, so copies are
never paired. Within a bucket of a band:

1. the bucket is dealt by hash of the id into pieces of about ``MEMBERS``. Every member meets
   its piece's pivot (the member closest to the piece's majority sketch) and keeps its best
   pivot, one pair a document; pivots of pieces meet in the same way until the bucket has one.
   Pairs whose estimate, corrected for chance agreement, can reach the threshold are confirmed
   on the sets, and components formed;
2. members that are still in different components are compared by bit counts: those outside
   the bucket's largest component, in pieces, with every slice of the bucket. A task holds one
   piece and one slice. Members that can reach the threshold with another component meet there
   once more with their sets: pairs are confirmed inside the task, and only a forest over the
   components leaves it, never the pairs.

Links inside a component change nothing, so no pair within it is needed, and the pairs of a
large group of copies stay linear in its size. Components are found by large-star and
small-star steps on written tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import durable, texts
from pairforge.llm.hashing import Words, batches, mix, utf8, windows

PERMUTATIONS, BITS = 384, 4
#: A pair at similarity 0.85 shares none of 24 bands of 4 with probability 2e-8; at 0.8, 3e-6.
BANDS, ROWS = 24, 4
#: A pair is dropped unconfirmed when its estimate lies this many standard errors too low.
ERRORS = 4.5
#: Members of a bucket, and shingles of their sets, that one group of a task holds, as hashes of ids deal them.
MEMBERS, SHINGLES = 4096, 2_000_000

_SEED = np.random.default_rng(20240521)
_MUL = _SEED.integers(0, 1 << 31, size=(2, PERMUTATIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOW = np.uint64(0x1111111111111111)


def shingle_sets(rows: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a text with fewer words is one shingle."""
    for part in batches(rows):
        w = Words([r.lower() for r in rows[part]])  # bytes: A-Z only
        own = w.hashes()
        h, at = windows(own, w.first, size)
        cut = np.searchsorted(at, w.first)
        for i in range(len(w.first) - 1):
            begin, end = w.first[i], w.first[i + 1]
            if 0 < end - begin < size:
                short = np.uint64(0)
                for x in own[begin:end]:
                    short = mix(np.array([short], dtype=np.uint64) + x)[0]
                yield np.array([short], dtype=np.uint64)
            else:
                yield np.unique(h[cut[i] : cut[i + 1]])


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each permutation, mixed to 32 even bits."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, (_MUL[0] * low[i : i + 1024] + _MUL[1] * high[i : i + 1024]).min(axis=1), out=least)
    least ^= least >> np.uint32(16)
    least *= np.uint32(0x85EBCA6B)
    least ^= least >> np.uint32(13)
    least *= np.uint32(0xC2B2AE35)
    return least ^ (least >> np.uint32(16))


def pack(least: np.ndarray) -> bytes:
    """Low four bits of each minimum, two to a byte."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (rows of 64-bit words): share of equal minima, less
    what chance makes equal in ``BITS`` bits."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unequal = np.bitwise_count(x & _LOW).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Below this estimate a pair does not reach ``percent``."""
    chance = 1 / (1 << BITS)
    equal = percent / 100 * (1 - chance) + chance
    return percent / 100 - ERRORS * (equal * (1 - equal) / PERMUTATIONS) ** 0.5 / (1 - chance)


def _sketches(size: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            n, node, sketch, bands = [], [], [], []
            for s in shingle_sets(utf8(t["text"]), size):
                n.append(len(s))
                if not len(s):
                    node.append(None), sketch.append(None), bands.append(None)
                    continue
                least = minima(s)
                keys = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[r : BANDS * ROWS : ROWS])
                node.append(mix(s).sum().tobytes() + mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().tobytes())
                sketch.append(pack(least))
                bands.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "sketch", "bands"],
            )

    return run


def _groups(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole groups of a stream that is sorted by key and part: borders between them, and the rows."""
    left = None
    for t in tables:
        table = pa.Table.from_batches([t])
        table = table if left is None else pa.concat_tables([left, table])
        keys, parts = table["key"].to_numpy(), table["part"].to_numpy()
        starts = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
        last = int(starts[-1]) if len(starts) else 0
        left = table.slice(last)
        if last:
            yield np.concatenate([[0], starts]), table.slice(0, last)
    if left is not None and left.num_rows:
        yield np.array([0, left.num_rows]), left


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, PERMUTATIONS * BITS // 64)


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _pivots(percent: int):
    cut = least_estimate(percent)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for borders, t in _groups(tables):
            ids, n, sketch = t["id"].to_numpy(), t["n"].to_numpy(), _matrix(t["sketch"])
            pivot = np.repeat(borders[:-1], np.diff(borders))
            for begin, end in zip(borders[:-1], borders[1:], strict=True):
                if end - begin == 2:
                    pivot[begin:end] = begin + int(ids[begin + 1] < ids[begin])
                elif end - begin > 2:
                    own = sketch[begin:end]
                    by = np.ascontiguousarray(own).view(np.uint8)
                    digits = np.stack([by & 15, by >> 4], axis=2).reshape(len(own), -1).astype(np.int64)
                    places = np.arange(PERMUTATIONS) * 16
                    votes = np.bincount((digits + places).ravel(), minlength=PERMUTATIONS * 16)
                    close = votes[digits + places].sum(axis=1)
                    pivot[begin:end] = begin + np.lexsort((ids[begin:end], -close))[0]
            estimate = agreement(sketch, sketch[pivot])
            # The pivot of a piece stays, as a pair with itself.
            keep = np.where(ids == ids[pivot], t["pieces"].to_numpy() > 1, (estimate >= cut) & _fits(n, n[pivot], percent))
            columns = t["key"].to_numpy(), ids, ids[pivot], estimate, t["pieces"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["key", "a", "b", "estimate", "pieces"])

    return run


class _Members:
    """Columns of whole groups of members, made once for all groups of a table."""

    def __init__(self, t: pa.Table, percent: int):
        self.ids, self.n, self.comp, self.key = (t[c].to_numpy() for c in ("id", "n", "comp", "key"))
        self.outside, self.in_piece, self.in_slice = (t[c].to_numpy() for c in ("outside", "in_piece", "in_slice"))
        self.sketch = _matrix(t["sketch"])
        self.bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.percent, self.cut = percent, least_estimate(percent)

    def group(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the members of a group that its piece and its slice hold."""
        return begin + np.flatnonzero(self.in_piece[begin:end]), begin + np.flatnonzero(self.in_slice[begin:end])

    def alike(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Which of ``rest`` may be linked with ``x``, by sizes and sketches."""
        # Two members outside the largest component meet twice: the smaller id's piece counts.
        rest = rest[(~self.outside[rest] | (self.ids[rest] > self.ids[x])) & _fits(self.n[rest], self.n[x], self.percent)]
        rest = rest[agreement(self.sketch[rest], self.sketch[x]) >= self.cut]
        # A pair that shares several bands is met in the first of them.
        return rest[self.bands[x][(self.bands[rest] == self.bands[x]).argmax(axis=1)] == self.key[x]]


def _to_compare(percent: int):
    """Members of each group that may be linked with a member of another component: whole rows."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for borders, t in _groups(tables):
            m, keep = _Members(t, percent), np.zeros(t.num_rows, dtype=bool)
            for begin, end in zip(borders[:-1], borders[1:], strict=True):
                piece, slice_ = m.group(begin, end)
                for x in piece:
                    rest = m.alike(x, slice_[m.comp[slice_] != m.comp[x]])
                    keep[rest] = True
                    keep[x] |= len(rest) > 0
            yield from t.filter(pa.array(keep)).to_batches()

    return run


def _across(percent: int):
    """Links between components, confirmed on the full sets inside the task: per group a forest
    over its components, at most one link for each."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for borders, t in _groups(tables):
            m = _Members(t, percent)
            label = m.comp.copy()
            sizes = np.array([len(s) // 8 for s in t["shingles"].to_pylist()])
            ends = np.cumsum(sizes)
            _, shingle = np.unique(np.frombuffer(b"".join(t["shingles"].to_pylist()), dtype="<u8"), return_inverse=True)
            marked = np.zeros(int(shingle.max()) + 1, dtype=bool)
            for begin, end in zip(borders[:-1], borders[1:], strict=True):
                links, own_label = [], label[begin:end]
                piece, slice_ = m.group(begin, end)
                for x in piece:
                    rest = m.alike(x, slice_[label[slice_] != label[x]])
                    if not len(rest):
                        continue
                    own = shingle[ends[x] - sizes[x] : ends[x]]
                    marked[own] = True
                    offsets = np.cumsum(sizes[rest]) - sizes[rest]
                    of_rest = np.repeat(ends[rest] - sizes[rest] - offsets, sizes[rest]) + np.arange(int(sizes[rest].sum()))
                    shared = np.add.reduceat(marked[shingle[of_rest]], offsets, dtype=np.int64)
                    marked[own] = False
                    linked = rest[100 * shared >= percent * (sizes[rest] + sizes[x] - shared)]
                    others, at = np.unique(label[linked], return_index=True)
                    if len(others):
                        links += [(m.ids[x], m.ids[y]) for y in linked[at]]
                        own_label[np.isin(own_label, others)] = label[x]
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _sets(size: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            rows = [s.tobytes() for s in shingle_sets(utf8(t["text"]), size)]
            yield pa.RecordBatch.from_arrays([t["doc_id"], pa.array(rows, pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            keep = []
            for x, y in zip(t["x"], t["y"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id in ``edges`` (a, b): large-star and small-star steps,
    each written to the shared folder, until every id points to one root that points nowhere."""
    def settled(star: DataFrame) -> bool:
        rows, ids = star.agg(F.count("*"), F.countDistinct("a")).first()
        return rows == ids and star.join(star.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()

    star = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not settled(star):
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        star = durable(
            large.join(lower, "a").select(F.explode(F.array(
                F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
            )).alias("e")).select("e.*").where("a <> b").distinct()
        )
    return star.select("a", F.col("b").alias("component"))


def _in_pieces(members: DataFrame, most: int) -> DataFrame:
    """``members`` (key, id, k of the key) with the number of pieces of the bucket and the
    member's own, so that a piece has about ``most``."""
    return members.withColumn("pieces", F.ceil(F.col("k") / most)).withColumn(
        "part", F.expr("pmod(xxhash64(id), pieces)")
    ).drop("k")


def _piece_by_slice(known: DataFrame, most: int) -> DataFrame:
    """``known`` (key, id, comp, n, further columns) of buckets with several components, a row for
    each (piece, slice) the member is compared in. Slices deal the whole bucket, pieces the
    members outside its largest component, both about ``most`` at a time, or ``SHINGLES`` of their
    shingles where ``known`` has ``n``."""
    shingles = F.sum("n") if "n" in known.columns else F.lit(0)
    sizes = known.groupBy("key", "comp").agg(F.count("*").alias("members"), shingles.alias("shingles")).groupBy("key").agg(
        F.max(F.struct("members", "comp", "shingles")).alias("large"), F.sum("members").alias("k"), F.sum("shingles").alias("s")
    ).where("large.members < k").select(
        "key", F.col("large.comp").alias("large"),
        F.greatest(F.ceil((F.col("k") - F.col("large.members")) / most), F.ceil((F.col("s") - F.col("large.shingles")) / SHINGLES)).alias("pieces"),
        F.greatest(F.ceil(F.col("k") / most), F.ceil(F.col("s") / SHINGLES)).alias("slices"),
    )
    return known.join(sizes, "key").withColumns({
        "outside": F.col("comp") != F.col("large"),
        "piece": F.expr("pmod(xxhash64(id, 1), pieces)"), "slice": F.expr("pmod(xxhash64(id), slices)"),
    }).drop("large")


def _spread(known: DataFrame) -> DataFrame:
    """A row for each pair of a piece and a slice that the member is in one of."""
    return known.withColumn("e", F.expr("""explode(concat(
        transform(sequence(0, pieces - 1), p -> struct(slice * pieces + p as part, outside and p = piece as in_piece, true as in_slice)),
        transform(filter(sequence(0, slices - 1), s -> outside and s <> slice),
                  s -> struct(s * pieces + piece as part, true as in_piece, false as in_slice))
    ))""")).select("*", "e.*").drop("e", "piece", "slice", "pieces", "slices")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, most: int = MEMBERS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_shingles``, ``component_id`` (the smallest doc_id
    reachable over links, itself included) and ``kept`` (it is that document).

    A set is the distinct ``size``-word shingles of the text with A-Z lower-cased; fewer words
    are one shingle. Tasks hold about ``most`` members of a bucket, or ``SHINGLES`` of their shingles,
    and larger buckets take another plan of pieces; results do not depend on it. An empty table
    has no rows.
    Two documents are linked when 100 * intersection >= percent * union. Null,
    empty and blank texts have no set and no links. Rows that share a doc_id are one document,
    linked where any of them is; rows without doc_id have no links, no component and are kept."""
    rows = durable(texts(docs).mapInArrow(
        _sketches(size), "doc_id long, n_shingles long, node binary, sketch binary, bands array<long>"
    ))
    linkable = rows.where("doc_id is not null and node is not null")
    nodes = linkable.groupBy("node").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    # A doc_id on rows with different texts has several nodes: they are linked by the id.
    same_id = linkable.join(nodes.select("node", "id"), "node").where("doc_id <> id").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b")
    )
    keys = nodes.select("id", "n", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    members = durable(keys.join(shared, "key"))
    sketches = nodes.select("id", "n", "sketch", "bands")
    sets = durable(
        texts(docs).join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id").mapInArrow(
            _sets(size), "doc_id long, shingles binary"
        ).distinct()
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")
        )

    def by_group(df: DataFrame) -> DataFrame:
        return df.repartition("key", "part").sortWithinPartitions("key", "part")

    def met(level: DataFrame) -> DataFrame:
        own = _in_pieces(level.select("key", "id", "k"), most).join(sketches, "id").select("key", "part", "pieces", "id", "n", "sketch")
        return by_group(own).mapInArrow(_pivots(percent), "key long, a long, b long, estimate double, pieces long")

    largest = members.agg(F.max("k")).first()[0] or 0
    found, between = met(members.where(F.col("k") <= most)), []
    if largest > most:
        hot = durable(met(members.where(F.col("k") > most)))
        found = found.union(hot.where("a <> b"))
        while largest > most:
            largest = -(-largest // most)
            hot = durable(met(hot.where("a = b and pieces > 1").select("key", F.col("a").alias("id"), F.col("pieces").alias("k"))))
            between.append(hot.where("a <> b").select("a", "b"))
    best = found.groupBy("a").agg(F.max(F.struct("estimate", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b"))
    if between:
        best = reduce(DataFrame.union, between, best).distinct()
    first = components(confirmed(best).union(same_id))
    known = members.join(first, members.id == first.a, "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("comp")
    )
    dealt = by_group(_spread(_piece_by_slice(known, most).join(sketches.drop("n"), "id")))
    to_compare = dealt.mapInArrow(_to_compare(percent), dealt.schema)
    of_set = sets.select(F.col("doc_id").alias("id"), "shingles")
    across = by_group(to_compare.join(of_set, "id")).mapInArrow(_across(percent), "a long, b long").distinct()
    # New links are between components: only those go into the second search.
    of_a, of_b = first.toDF("a", "ca"), first.toDF("b", "cb")
    links = across.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    second = components(links).toDF("old", "new")
    labels = (
        nodes.select("node", "id").join(first, F.col("id") == first.a, "left").select("node", F.coalesce("component", "id").alias("old"))
        .join(second, "old", "left").select("node", F.coalesce("new", "old").alias("least"))
    )
    return rows.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, whole rows, with one document of each group left: the one of the smallest
    doc_id. Of rows that share a doc_id one stays; rows without doc_id all stay."""
    kept = near_duplicates(docs, percent).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"))
    left = docs.join(kept.where("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.union(docs.where("doc_id is null"))
