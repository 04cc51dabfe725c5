"""Token ids in files, compressed by a Re-Pair grammar per block.

Rows are dealt by ranges of doc_id, so files hold documents in ascending order. Each task
encodes its texts and cuts its ids into blocks; a block replaces frequent id pairs by
nonterminals, round after round, and is one row of a Parquet table: Spark's writer commits it
once, whatever executors are lost. The payload of a block is a container of its own:

    bytes 0-3   "RPG1"
    then        5 x uint32: documents, symbols, rules, first nonterminal, bytes a symbol (2 or 4)
    then        documents x uint32: symbols of each document
    then        rules x 2 x uint32: what each nonterminal stands for
    then        rules x uint32: ids in its expansion
    then        symbols x uint16 or uint32: the compressed sequence

All little-endian. No nonterminal crosses the end of a document, so any one can be decoded
from its own symbols, and expansion lengths say where an id lies without decoding."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.llm.common import parts_for, texts
from pairforge.llm.hashing import Words, batches, pieces_hash, utf8
from pairforge.session import checkpoint_dir

#: Ids of a block, and text bytes of a range of documents.
BLOCK_IDS, RANGE_BYTES = 1_000_000, 64_000_000
#: Rows encoded at a time, so that a task holds few texts as Python objects.
SLICE_ROWS = 1024
#: Pieces that a worker remembers; past them it forgets all and starts again (about 36 bytes each).
MOST_PIECES = 1 << 20
#: Pairs replaced in a round, and occurrences that make a pair frequent.
PAIRS, FREQUENT = 2048, 24
#: A round that shortens its block by less than this share is the last one.
LEAST_GAIN = 1 / 128

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
#: How byte-level vocabularies write bytes that are no printable character of Latin-1; a blank stays.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_WRITTEN = np.arange(256, dtype="<u2")
_WRITTEN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_WRITTEN[0x20] = 0x20
#: Every character of which words are made that go to the vocabulary's model directly, and some words.
_PROBES = [
    *map(chr, [*range(0x21, 0x27), *range(0x28, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]),
    "abcdefghijklmnopqrstuvwxyz", "the", "Straße", "ÀÉÎÕÜ", "çàñøþ", "!!!", "--", "#$%&()*+,-./:;<=>?@[]^_`{|}~",
]


class Encoder:
    """Ids of texts under a tokenizer that drops white space, ignores the case of A-Z and never
    joins a letter with a mark or a digit: each distinct piece is encoded once, until ``most``
    are known and all are forgotten. A piece is looked up by its hash: first in one slot, where
    the last piece with those leading bits lies, and only what is not there among all. Pieces
    are cut only where the tokenizer always cuts (ASCII and U+00C0-U+00FF letters against ASCII
    marks and digits, apostrophes left alone); texts with special tokens are encoded whole."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.direct = self._words(" ".join(_PROBES).encode()) == self._ids([p.encode() for p in _PROBES])
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Know no piece: ``hashes``, ``begin`` and ``size`` in order of learning, ``keys`` and
        ``which`` (piece of each key) by hash, ``slots`` by leading bits."""
        self.keys = self.hashes = np.zeros(0, dtype=np.uint64)
        self.which = np.zeros(0, dtype=np.int32)
        self.begin = self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.slots = np.full(1 << 21, -1, dtype=np.int32)

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [e.ids for e in found]

    def _words(self, joined: bytes) -> list[list[int]]:
        """Ids of words of letters (ASCII, U+00C0-U+00FF), of marks, or of one digit, joined by
        blanks: what normalizing and splitting leave of them is known, so they go to the model."""
        model = self.tokenizer.model
        lower = np.frombuffer(joined.decode().lower().encode(), dtype=np.uint8)
        written = _WRITTEN[lower].tobytes().decode("utf-16-le")
        return [[t.id for t in model.tokenize(w)] for w in written.split(" ")]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> None:
        """Encode the pieces with these hashes; those marked ``word`` go to :meth:`_words`."""
        order = np.argsort(~word, kind="stable")
        keys, starts, ends, n = keys[order], starts[order], ends[order], int(word.sum()) if self.direct else 0
        found = []
        if n:
            long = ends[:n] - starts[:n] + 1
            joined = data[expand(starts[:n], long)]
            joined[np.cumsum(long) - 1] = 0x20
            found = self._words(joined[:-1].tobytes())
        found += self._ids([data[a:b].tobytes() for a, b in zip(starts[n:], ends[n:], strict=True)])
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(size.sum()))])
        which = np.arange(len(self.hashes), len(self.hashes) + len(keys), dtype=np.int32)
        self.hashes, self.begin, self.size = (
            np.concatenate(x) for x in ((self.hashes, keys), (self.begin, begin), (self.size, size))
        )
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.which = np.insert(self.keys, at, keys[order]), np.insert(self.which, at, which[order])

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys no piece known has."""
        if not len(self.keys):
            return np.ones(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def _find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Number of each piece. A piece of ``known`` bytes only is one word to the tokenizer: it
        is cut wherever letters, marks and digits meet."""
        if len(self.hashes):
            # An empty slot is -1 and means the last piece: equal hashes are right there as well.
            found = self.slots[hashes >> np.uint64(43)]
            missed = np.flatnonzero(self.hashes[found] != hashes)
        else:
            found, missed = np.empty(len(hashes), dtype=np.int32), np.arange(len(hashes))
        if not len(missed):
            return found
        keys, example, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
        new = self._unknown(keys)
        if new.any() and len(self.keys) and len(self.keys) + int(new.sum()) > self.most:
            self._forget()
            return self._find(data, starts, ends, hashes, known)
        if new.any():
            begin, end = starts[missed[example[new]]], ends[missed[example[new]]]
            so_far = np.concatenate([[0], np.cumsum(known)])
            self._learn(keys[new], data, begin, end, so_far[end] - so_far[begin] == end - begin)
        which = self.which[np.searchsorted(self.keys, keys)]
        self.slots[keys >> np.uint64(43)] = which
        found[missed] = which[back]
        return found

    def plain(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, joined, and how many each has."""
        w = Words([r.lower() for r in rows])
        data = w.data
        lead = data == 0xC3
        letter = _LETTER[data]
        second = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= second
        letter[:-1] |= second
        mark, digit = _MARK[data], _DIGIT[data]
        known = letter | mark | digit
        cut = known[:-1] & known[1:] & ((letter[:-1] != letter[1:]) | digit[1:] & digit[:-1] | (digit[1:] != digit[:-1]))
        inner = np.flatnonzero(cut) + 1
        begins, closes = np.zeros(len(data), dtype=bool), np.zeros(len(data) + 1, dtype=bool)
        begins[w.starts] = begins[inner] = closes[w.ends] = closes[inner] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes)
        found = self._find(data, starts, ends, pieces_hash(data, starts, ends), known)
        size, begin = self.size[found], self.begin[found]
        ids = self.flat[expand(begin, size)]
        done = np.concatenate([[0], np.cumsum(size)])
        borders = np.append(w.starts, len(data))[w.first] if len(w) else np.zeros(len(rows) + 1, dtype=np.int64)
        return ids, np.diff(done[np.searchsorted(starts, borders)])

    def __call__(self, rows: list[bytes]) -> Iterator[np.ndarray]:
        for part in batches(rows, 2 << 20):
            own = rows[part]
            special = [b"<|" in r for r in own]
            ids, counts = self.plain([b"" if s else r for r, s in zip(own, special, strict=True)])
            ends = np.cumsum(counts)
            for row, is_special, end, n in zip(own, special, ends, counts, strict=True):
                yield np.array(self._ids([row])[0], dtype=np.uint32) if is_special else ids[end - n : end]


@lru_cache(maxsize=1)
def _kept(path: str, changed: int, size: int) -> Encoder:
    return Encoder(path)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: later tasks find the pieces that earlier ones met. A
    changed file is loaded anew."""
    stat = os.stat(path)
    return _kept(path, stat.st_mtime_ns, stat.st_size)


def expand(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] values), then the same for the others."""
    done = np.cumsum(size)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(begin - done + size, size)


def _distinct(code: np.ndarray, slot: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in no order, which of them each row has, and how often. Codes of one slot
    are told apart: one stands for its slot, only rows of the others are sorted."""
    number = np.zeros((1 << 21) + 1, dtype=np.int64)
    number[used] = np.arange(len(used))
    back = number[slot]
    values = np.zeros(len(used), dtype=np.uint64)
    values[back] = code
    others = np.flatnonzero(values[back] != code)
    more, back_more = np.unique(code[others], return_inverse=True)
    back[others] = len(used) + back_more
    return np.concatenate([values, more]), back, np.bincount(back, minlength=len(used) + len(more))


def compress(ids: np.ndarray, counts: np.ndarray, first: int, pairs: int = PAIRS, rounds: int | None = None, frequent: int = FREQUENT):
    """Re-Pair over one block: (symbols, symbols of each document, rules, expansion lengths).

    Each round replaces up to ``pairs`` of the most frequent pairs at once, from the left;
    ``first`` is the first nonterminal. Rounds go on until no pair is frequent or a round gains
    less than :data:`LEAST_GAIN`, so that a repeat of any length becomes a few symbols; with
    ``rounds``, exactly so many are made unless no pair is frequent."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    rules, sizes = np.zeros((0, 2), dtype=np.uint32), np.ones(0, dtype=np.uint32)
    done = 0
    while len(seq) >= 2 and (rounds is None or done < rounds):
        done, before = done + 1, len(seq)
        code = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).view(np.int64)
        # Pairs over the end of a document have a slot of their own, which does not count.
        slot[np.flatnonzero(last[:-1])] = 1 << 21
        often = np.bincount(slot, minlength=(1 << 21) + 1) >= frequent
        often[-1] = False
        maybe = np.flatnonzero(often[slot])
        values, back, n = _distinct(code[maybe], slot[maybe], np.flatnonzero(often))
        many = np.flatnonzero(n >= frequent)
        chosen = many[np.lexsort((values[many], -n[many]))[:pairs]]
        chosen = chosen[np.argsort(values[chosen])]
        if not len(chosen):
            break
        name = np.full(len(values), -1, dtype=np.int64)
        name[chosen] = np.arange(len(chosen))
        name = name[back]
        at, name = maybe[name >= 0], name[name >= 0]
        # Of overlapping pairs the left one is taken: every second of a run.
        begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.flatnonzero(begins)
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, name = at[even], name[even]
        seq[at] = first + len(rules) + name
        last[at] = last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        new = np.stack([values[chosen] >> np.uint64(32), values[chosen] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        ones = np.ones(1, dtype=np.uint32)
        known = np.concatenate([ones, sizes])
        new_sizes = sum(known[np.where(new[:, i] >= first, new[:, i].astype(np.int64) - first + 1, 0)] for i in (0, 1))
        rules, sizes = np.concatenate([rules, new]), np.concatenate([sizes, new_sizes.astype(np.uint32)])
        if rounds is None and before - len(seq) < before * LEAST_GAIN:
            break
    ends = np.flatnonzero(last) + 1
    symbols = np.zeros(len(counts), dtype=np.int64)
    symbols[counts > 0] = np.diff(np.concatenate([[0], ends]))
    return seq, symbols, rules, sizes


def to_bytes(ids: np.ndarray, counts: np.ndarray, first: int, **how: int) -> bytes:
    seq, symbols, rules, sizes = compress(ids, counts, first, **how)
    width = 2 if first + len(rules) <= 1 << 16 and (not len(ids) or int(ids.max()) < 1 << 16) else 4
    head = np.array([len(counts), len(seq), len(rules), first, width], dtype="<u4")
    parts = (head, symbols.astype("<u4"), rules.astype("<u4"), sizes.astype("<u4"), seq.astype(f"<u{width}"))
    return b"RPG1" + b"".join(p.tobytes() for p in parts)


class Block:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG1":
            raise ValueError("not a block of token ids")
        docs, n, rules, self.first, width = (int(x) for x in np.frombuffer(payload, dtype="<u4", count=5, offset=4))
        at = 24
        self.symbols = np.frombuffer(payload, dtype="<u4", count=docs, offset=at).astype(np.int64)
        pairs = np.frombuffer(payload, dtype="<u4", count=2 * rules, offset=(at := at + 4 * docs)).reshape(-1, 2)
        sizes = np.frombuffer(payload, dtype="<u4", count=rules, offset=(at := at + 8 * rules)).astype(np.int64)
        self.seq = np.frombuffer(payload, dtype=f"<u{width}", count=n, offset=at + 4 * rules).astype(np.int64)
        self.ends = np.cumsum(self.symbols)
        # Expansions of nonterminals one after another; a rule only names earlier ones.
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.span = np.concatenate([np.ones(self.first, dtype=np.int64), sizes])
        self.flat = np.zeros(int(sizes.sum()), dtype=np.uint32)
        for (left, right), begin, size in zip(pairs.tolist(), self.begins.tolist(), sizes.tolist(), strict=True):
            end = begin
            for symbol in (left, right):
                if symbol < self.first:
                    self.flat[end] = symbol
                    end += 1
                else:
                    k = symbol - self.first
                    self.flat[end : end + sizes[k]] = self.flat[self.begins[k] : self.begins[k] + sizes[k]]
                    end += sizes[k]

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        return self.span[symbols]

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        size = self.lengths(symbols)
        done = np.cumsum(size)
        out = np.repeat(symbols, size).astype(np.uint32)
        rule = np.flatnonzero(symbols >= self.first)
        target = expand(done[rule] - size[rule], size[rule])
        out[target] = self.flat[expand(self.begins[symbols[rule] - self.first], size[rule])]
        return out

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, decoded alone."""
        return self.ids(self.seq[self.ends[i] - self.symbols[i] : self.ends[i]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each document has."""
        done = np.concatenate([[0], np.cumsum(self.lengths(self.seq))])
        return self.ids(self.seq), np.diff(np.concatenate([[0], done[self.ends]]))


def _write(encoder: Callable[[], Encoder], end_id: int, block_ids: int, how: dict[str, int]):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder()
        first = max(encode.tokenizer.get_vocab_size(), end_id + 1)
        names, ids, size, block = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            payload = to_bytes(np.concatenate(ids), counts, first, **how)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "block", "n_ids", "doc_ids", "payload"],
            )

        slices = (t.slice(at, SLICE_ROWS) for t in tables for at in range(0, t.num_rows, SLICE_ROWS))
        for t in slices:
            for doc_id, own in zip(t["doc_id"].to_pylist(), encode(utf8(t["text"])), strict=True):
                names.append(doc_id)
                ids.append(np.append(own, np.uint32(end_id)))
                size += len(ids[-1])
                if size >= block_ids:
                    yield flush()
                    names, ids, size, block = [], [], 0, block + 1
        if names:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS, range_bytes: int = RANGE_BYTES,
    **how: int,
) -> None:
    """Encode every text (null: empty) with the tokenizer file ``vocabulary``, close each
    document with ``end_id``, and write blocks to ``path`` in ascending doc_id order (rows
    without doc_id first; rows that share one by text). An empty table writes no block. ``how``
    sets ``pairs``, ``rounds`` and ``frequent`` of the grammar. Every executor needs the
    vocabulary file at that path."""
    parts = parts_for(docs, range_bytes)
    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(
        _write(lambda: worker_encoder(vocabulary), end_id, block_ids, how),
        "part int, block long, n_ids long, doc_ids array<long>, payload binary",
    ).write.option("compression", "zstd").parquet(path)


def _read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        for part, block, names, payload in zip(*(t[c].to_pylist() for c in ("part", "block", "doc_ids", "payload")), strict=True):
            ids, counts = Block(payload).documents()
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts) * 4]), pa.int32())
            data = pa.Array.from_buffers(
                pa.binary(), len(names), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())]
            )
            n = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(names, pa.int64()),
                 pa.array(np.cumsum(counts) - counts), pa.array(counts), data],
                ["part", "block", "doc_id", "offset", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: part, block, doc_id, offset (ids before it in its block),
    n_tokens and ids (little-endian uint32)."""
    return spark.read.parquet(path).select("part", "block", "doc_ids", "payload").mapInArrow(
        _read, "part int, block long, doc_id long, offset long, n_tokens long, ids binary"
    )


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids in front of each block: running sums within parts, then over one row per part."""
    heads = spark.read.parquet(path).select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return heads.join(parts, "part").select(
        "part", "block", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base")
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
