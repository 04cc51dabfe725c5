"""Phrase collocations by vertical partitioning of the suffixes, as ERA builds suffix trees.

Every word starts a suffix, cut after ``longest`` words or where its piece of text ends. Suffixes
are dealt to groups by their prefix, so that a group fits a memory budget:

1. a first scan counts words per language: how often each one-word prefix begins a suffix;
2. in order of their hash, words are put into groups of about ``budget`` suffixes; a word with
   more becomes a range of groups by itself, in which the rest of the suffix chooses;
3. a second scan turns every batch of texts into its subtrees: per group one block of distinct
   suffixes with counts, words as numbers into the block's list of hashes;
4. each group merges its blocks into one subtree, level by level. A suffix is a path, its count
   a leaf total, and the count of a node is the sum of the leaf totals below it.

Nodes of a word that has several groups are summed once more. Words are 64-bit hashes until
phrases are written out; the table of words proves that no two of a language share one, else
the other hash family is taken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import durable
from pairforge.llm.hashing import batches, pieces_hash, utf8

#: Suffixes of a group, and text bytes of a block. Groups are about ``MOST_GROUPS`` at most, whose
#: borders (8 bytes each) every task gets: from 1.5 * 10**12 words on the budget grows instead.
BUDGET, BLOCK_BYTES, MOST_GROUPS = 1_500_000, 4_000_000, 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


class Pieces:
    """Words of a batch of lower-cased texts, their hashes and the piece each lies in."""

    def __init__(self, rows: list[bytes], family: int):
        self.data = np.frombuffer(b"\n" + b"\n".join(r.lower() for r in rows) + b"\n", dtype=np.uint8)  # bytes: A-Z only
        ends_piece = _BREAK[self.data]
        inside = ~(ends_piece | _BLANK[self.data])
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.piece = np.cumsum(ends_piece, dtype=np.int64)[self.starts]
        self.hashes = self.hashed(family)
        self.hashes[self.hashes == 0] = 1  # zero stands for no word

    def hashed(self, family: int) -> np.ndarray:
        return pieces_hash(self.data, self.starts, self.ends, family)

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def _by_lang(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``BLOCK_BYTES`` at a time; a longer text stands alone."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for t in tables:
        langs = t["lang"].to_pylist()
        rows = utf8(t["text"])
        for part in batches(rows, BLOCK_BYTES):
            for lang, row in zip(langs[part], rows[part], strict=True):
                held.setdefault(lang, []).append(row)
                size += len(row)
            if size >= BLOCK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _count_words(family: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows in _by_lang(tables):
            p = Pieces(rows, family)
            h, at, number, n = np.unique(p.hashes, return_index=True, return_inverse=True, return_counts=True)
            # Another word under the hash of a listed one shows in the other family: it is listed, too.
            other = p.hashed(1 - family)
            clash = np.flatnonzero(other != other[at][number])
            h, at, n = np.concatenate([h, p.hashes[clash]]), np.concatenate([at, clash]), np.concatenate([n, 0 * clash])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(h), pa.string()), pa.array([p.word(i) for i in at], pa.string()), pa.array(h.view(np.int64)), pa.array(n)],
                ["lang", "word", "h", "n"],
            )

    return run


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """``lang``, ``word``, its hash ``h`` and count ``n`` over ``docs`` (lang, text), and the hash
    family under which no two words of a language share a hash."""
    for family in (0, 1):
        found = durable(docs.mapInArrow(_count_words(family), "lang string, word string, h long, n long").groupBy(
            "lang", "word", "h"
        ).agg(F.sum("n").alias("n")))
        if found.groupBy("lang", "h").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            return found, family
    raise ValueError("two words share a hash under both families")


def _groups(words: DataFrame, budget: int, most: int) -> tuple[dict, dict]:
    """Per language the hash at which each group of rare words begins, and for words with more
    than ``budget`` suffixes how many groups they are. Both have about one entry for every
    ``budget`` words of text, ``most`` at most."""
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // most))
    frequent = {}
    for r in words.where(F.col("n") > budget).select("lang", "h", "n").collect():
        frequent.setdefault(r.lang, []).append((r.h, -(-r.n // budget)))
    # Totals of 2**20 equal ranges of hashes: their running sum says where a group is full.
    ranged = words.where(F.col("n") <= budget).groupBy("lang", F.shiftright("h", 44).alias("range")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = {}
    firsts = ranged.withColumn("group", F.floor(before / budget)).groupBy("lang", "group").agg(F.min("range").alias("range"))
    for r in firsts.select("lang", "range").collect():
        borders.setdefault(r.lang, []).append(r.range << 44)
    return (
        {lang: np.sort(np.array(b, dtype=np.int64)) for lang, b in borders.items()},
        {lang: (np.array([h for h, _ in sorted(f)], dtype=np.int64), np.array([k for _, k in sorted(f)])) for lang, f in frequent.items()},
    )


def _rank(parent: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each (parent node, word), and the first place of each number."""
    _, first, number = np.unique(parent.astype(np.uint64) * np.uint64(n_words) + word.astype(np.uint64), return_index=True, return_inverse=True)
    return number, first


def _sums(node: np.ndarray, counts: np.ndarray, n_nodes: int) -> np.ndarray:
    total = np.zeros(n_nodes, dtype=np.int64)
    np.add.at(total, node, counts)
    return total


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in two bytes each where they fit, else four."""
    return numbers.astype("<u2" if numbers.max() < 1 << 16 else "<u4").tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def _subtrees(family: int, longest: int, borders: dict, frequent: dict):
    none = np.zeros(0, dtype=np.int64)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows in _by_lang(tables):
            p = Pieces(rows, family)
            if not len(p.hashes):
                continue
            words, number = np.unique(np.concatenate([[np.uint64(0)], p.hashes]), return_inverse=True)  # 0: no word
            number = number[1:]
            path, node = [number], number
            for k in range(1, longest):
                follows = np.zeros(len(number), dtype=number.dtype)
                follows[:-k] = np.where(p.piece[k:] == p.piece[:-k], number[k:], 0)
                path.append(follows)
                node, first = _rank(node, follows, len(words))
            if longest == 1:
                node, first = _rank(node, np.zeros_like(node), 1)
            counts = np.bincount(node)
            path = [c[first] for c in path]
            h = words.view(np.int64)[path[0]]
            group = np.searchsorted(borders.get(lang, none), h, side="right")
            hot, n_groups = frequent.get(lang, (none, none))
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                is_hot = hot[at] == h
                rest = np.zeros(len(h), dtype=np.uint64)
                for c in path[1:]:
                    rest = rest * np.uint64(0x9E3779B97F4A7C15) + words[c]
                own = (rest >> np.uint64(33)).astype(np.int64) % n_groups[at]
                base = np.concatenate([[0], np.cumsum(n_groups)[:-1]])
                group = np.where(is_hot, -1 - (base[at] + own), group)
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1))
            for begin, end in zip(edges, [*edges[1:], len(order)], strict=True):
                rows_ = order[begin:end]
                flat = np.stack([c[rows_] for c in path])
                used, local = np.unique(flat, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([int(group[rows_[0]])], pa.int64()), pa.array([words[used].tobytes()], pa.binary()),
                     pa.array([_narrow(local)], pa.binary()), pa.array([_narrow(counts[rows_])], pa.binary()), pa.array([len(rows_)])],
                    ["lang", "group", "words", "paths", "counts", "size"],
                )

    return run


class _Subtree:
    """Distinct suffixes of a group, merged block by block: ``words`` are hashes, a path has a
    number into them for each level."""

    def __init__(self, longest: int):
        self.words, self.paths, self.counts = np.zeros(0, dtype=np.uint64), np.zeros((longest, 0), dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.blocks, self.held = [], 0

    def add(self, words: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> None:
        self.blocks.append((words, paths.reshape(len(self.paths), -1), counts))
        self.held += len(counts)
        if self.held > len(self.counts) + 500_000:
            self.merge()

    def merge(self) -> list[np.ndarray]:
        """Put all blocks into one; returns the node of each leaf at each level."""
        blocks = [(self.words, self.paths, self.counts), *self.blocks]
        self.blocks, self.held = [], 0
        self.words, number = np.unique(np.concatenate([w for w, _, _ in blocks]), return_inverse=True)
        begins = np.cumsum([0, *(len(w) for w, _, _ in blocks)])
        number = number.astype(np.int32)
        paths = np.concatenate([number[b : b + len(w)][p] for b, (w, p, _) in zip(begins, blocks, strict=False)], axis=1)
        counts = np.concatenate([c.astype(np.int64) for _, _, c in blocks])
        del blocks
        node, nodes = np.zeros(paths.shape[1], dtype=np.int32), []
        for level in paths:
            node, first = _rank(node, level, len(self.words))
            node = node.astype(np.int32)
            nodes.append(node)
        self.paths, self.counts = paths[:, first], _sums(node, counts, len(first))
        return [n[first] for n in nodes]

    def phrases(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per level from two words on: word hashes (a column each) and counts of all nodes with at least ``least``."""
        nodes = self.merge()
        for k in range(1, len(nodes)):
            number, first = np.unique(nodes[k], return_index=True)
            total = _sums(nodes[k], self.counts, int(number[-1]) + 1)
            keep = first[(total[number] >= least) & (self.words[self.paths[k, first]] != 0)]
            yield self.words[self.paths[: k + 1, keep]], total[nodes[k][keep]]


def _phrases(longest: int, least: int):
    def out(lang: str, group: int, tree: _Subtree) -> Iterator[pa.RecordBatch]:
        # Groups of one frequent word hold parts of a node's count, unless the node is a whole suffix.
        for k, (words, counts) in enumerate(tree.phrases(1 if group < 0 else least), 2):
            if k == longest:
                keep = counts >= least
                words, counts = words[:, keep], counts[keep]
            if len(counts):
                flat = np.ascontiguousarray(words.T).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, k, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), lists, pa.array(counts)], ["lang", "words", "n"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for t in tables:
            for i in range(t.num_rows):
                lang, group, words, paths, counts, size = (t[c][i].as_py() for c in ("lang", "group", "words", "paths", "counts", "size"))
                if at != (lang, group):
                    if at is not None:
                        yield from out(*at, tree)
                    at, tree = (lang, group), _Subtree(longest)
                tree.add(np.frombuffer(words, dtype="<u8"), _numbers(paths, longest * size), _numbers(counts, size))
        if at is not None:
            yield from out(*at, tree)

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, family: int, longest: int, least: int, budget: int, most: int) -> DataFrame:
    """``lang``, ``words`` (hashes), ``n`` of every phrase of 2 to ``longest`` words that occurs ``least`` times."""
    borders, frequent = _groups(words, budget, most)
    blocks = docs.mapInArrow(_subtrees(family, longest, borders, frequent), "lang string, group long, words binary, paths binary, counts binary, size long")
    found = blocks.repartition("lang", "group").sortWithinPartitions("lang", "group").mapInArrow(
        _phrases(longest, least), "lang string, words array<long>, n long"
    )
    return found.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, best: int = 2000,
    budget: int = BUDGET, most_groups: int = MOST_GROUPS,
) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a (its count), l and r (counts of
    its parts under the cut with the lowest score), n (words of the language), score.

    Texts lose the case of A-Z and are split at ``[.,;:!?\\n-\\r]`` into pieces, these at blanks
    and tabs into words. A phrase is 2 to ``longest`` words that follow each other in a piece and
    occur at least ``least`` times, overlaps included. Cut after k words it scores
    floor(10**6 * a * a / (l * r)); the lowest score counts, ties to the smallest k. A phrase whose
    words lie inside a longer one with 100 * a >= ``within`` * its own goes. Order: score and a
    descending, then phrase by bytes.

    Reads lang (null: ``und``) and text (null: empty) alone; doc_id is not used. Repeated rows count
    as often as they occur. No words: no rows."""
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words, family = word_counts(texts)
    phrases = durable(phrase_counts(texts, words, family, longest, least, budget, most_groups))
    parts = phrases.union(words.where(F.col("n") >= least).select("lang", F.array("h").alias("words"), "n"))
    cuts = phrases.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    scored = (
        cut.join(parts.select("lang", F.col("words").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("words").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .withColumns({"l_": _exact("l"), "r_": _exact("r"), "a_": _exact("a")})
        .withColumn("score", F.expr("cast((a_ * a_ * 1000000) div (l_ * r_) as bigint)"))
        .groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "words", "cut.*")
    )
    inside = phrases.where(F.size("words") > 2).select("lang", F.col("n").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))"
    )).alias("words")).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within))
    # Ties for the last place stay until their words are known.
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    leaders = durable(left.withColumn("place", F.rank().over(first)).where(F.col("place") <= best).drop("place", "longer"))
    spelled = leaders.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelling = spelled.groupBy("lang", "words").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return leaders.join(spelling, ["lang", "words"]).withColumn("rank", rank).where(F.col("rank") <= best).join(sizes, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"
    )
