"""Exact substring de-duplication with fixed-block anchors.

A passage of ``window`` words that occurs twice contains, in its first copy, a whole block of
``block = (window + 1) // 2`` words that starts at a multiple of ``block``. So the blocks of
every document, cut without overlap, are the index, and every rolling window of ``block``
words probes it. Around each hit the exact ``window``-word sequences are compared, which
extends hits to maximal repeats: a word goes if any repeated window covers it.

Documents are dealt into chunks by a hash of their id. A chunk reports each block hash once,
however often it holds it, and gets one answer, so a passage shared by a third of all
documents costs one entry per chunk and never meets in one task. Three narrow passes over the
chunks (blocks, windows, removal) recompute word hashes, which is cheaper than moving them."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import parts_for, texts
from pairforge.llm.hashing import Words, batches, utf8, windows

#: Text bytes of a chunk: what one task holds at a time.
CHUNK_BYTES = 6_000_000
#: Text bytes whose windows meet in one bucket.
BUCKET_BYTES = 24_000_000
_NO_ID = -(2**63)
#: A block hash is cut to 48 bits: it only proposes windows, which 96 bits confirm.
_NARROW = np.uint64(16)
_HALF = np.uint64(0xFFFFFFFF)


def _order(table: pa.Table) -> pa.Table:
    """Rows of a chunk in the order that decides what is earlier: id (null first), then text."""
    ids, rows = table["doc_id"].to_pylist(), table["text"].to_pylist()
    at = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, rows[i]))
    return table.take(pa.array(at, type=pa.int64()))


def _hashed(table: pa.Table, *wanted: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Window hashes of the chunk for each (size, family); word offsets of the documents;
    starts of the windows of the first size."""
    rows = utf8(table["text"])
    found: list[list[np.ndarray]] = [[] for _ in wanted]
    starts, counts, base = [], [], 0
    for part in batches(rows):
        w = Words(rows[part])
        hashes = {k: w.hashes(k) for k in {k for _, k in wanted}}
        for i, (size, k) in enumerate(wanted):
            h, at = windows(hashes[k], w.first, size, k)
            found[i].append(h)
            if i == 0:
                starts.append(at + base)
        counts.append(np.diff(w.first))
        base += len(w)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64)
    none = np.zeros(0, dtype=np.uint64)
    return [np.concatenate(f) if f else none for f in found], offsets, np.concatenate(starts) if starts else none.astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Sorted values as steps of as many bytes as the widest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel())


def _deal(values: np.ndarray, parts: int) -> list[tuple[int, slice, np.ndarray]]:
    """Bucket of each value; order that puts buckets together."""
    bucket = (values % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(parts + 1))
    return [(b, slice(ends[b], ends[b + 1]), order) for b in range(parts) if ends[b + 1] > ends[b]]


def _blocks(size: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        """What a chunk reports to each bucket: block hashes it holds aligned, and the rest."""
        table = _order(table)
        (h,), offsets, at = _hashed(table, (size, 0))
        h = h >> _NARROW
        owner = np.searchsorted(offsets, at, side="right") - 1
        aligned = (at - offsets[owner]) % size == 0
        index = np.unique(h[aligned])
        probes = np.setdiff1d(h, index)
        sent: dict[int, list[bytes]] = {}
        for i, values in enumerate((index, probes)):
            for b, span, order in _deal(values, parts):
                sent.setdefault(b, [b"", b""])[i] = _pack(values[order[span]])
        chunk = table["chunk"][0].as_py()
        return pa.table({
            "bucket": pa.array(list(sent), pa.int64()),
            "chunk": pa.array([chunk] * len(sent), pa.int64()),
            "anchors": pa.array([v[0] for v in sent.values()], pa.binary()),
            "probes": pa.array([v[1] for v in sent.values()], pa.binary()),
        })

    return run


def _match(table: pa.Table) -> pa.Table:
    """Block hashes that another chunk holds too, one of them aligned; to each chunk its own."""
    chunks = table["chunk"].to_pylist()
    pieces, who, anchored = [], [], []
    for i, pair in enumerate(zip(table["anchors"].to_pylist(), table["probes"].to_pylist(), strict=True)):
        for is_anchor, blob in zip((True, False), pair, strict=True):
            values = _unpack(blob)
            pieces.append(values)
            who.append(np.full(len(values), i, dtype=np.int64))
            anchored.append(np.full(len(values), is_anchor))
    values, who, anchored = np.concatenate(pieces), np.concatenate(who), np.concatenate(anchored)
    order = np.argsort(values)
    values, who, anchored = values[order], who[order], anchored[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(begin, len(values)))
    hit = (size > 1) & np.logical_or.reduceat(anchored, begin)
    keep = np.repeat(hit, size)
    values, who = values[keep], who[keep]
    order = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[order], np.arange(len(chunks) + 1))
    out = [(chunks[i], _pack(values[order[ends[i] : ends[i + 1]]])) for i in range(len(chunks)) if ends[i + 1] > ends[i]]
    return pa.table({
        "chunk": pa.array([c for c, _ in out], pa.int64()), "hits": pa.array([h for _, h in out], pa.binary()),
    })


#: A window travels as 96 bits of hash; documents are named once for a run of windows.
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4")])
_RUN = np.dtype([("doc", "<i8"), ("n", "<u4")])


def _pack_runs(rows: np.ndarray, doc: np.ndarray) -> bytes:
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    runs = np.empty(len(begin), dtype=_RUN)
    runs["doc"], runs["n"] = doc[begin], np.diff(np.append(begin, len(doc)))
    return np.array([len(runs)], dtype="<u4").tobytes() + runs.tobytes() + rows.tobytes()


def _unpack_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, dtype="<u4", count=1)[0])
    runs = np.frombuffer(blob, dtype=_RUN, count=n, offset=4)
    return np.frombuffer(blob, dtype=_WINDOW, offset=4 + n * _RUN.itemsize), np.repeat(runs["doc"], runs["n"])


def _first_of_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first occurrence of each (a, b), in order of (a, b)."""
    order = np.lexsort((np.arange(len(a)), b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def _windows(size: int, block: int, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The exact windows around hits, each once: what the chunk reports to each bucket."""
        table = _order(table)
        sent: dict[int, bytes] = {}
        if table.num_rows:
            (h10, a, b), offsets, at10 = _hashed(table, (block, 0), (size, 0), (size, 1))
            h10 = h10 >> _NARROW
            owner = np.searchsorted(offsets, at10, side="right") - 1
            hits = np.concatenate([_unpack(x) for x in answers["hits"].to_pylist()] or [np.zeros(0, dtype=np.uint64)])
            hit = np.isin(h10, np.sort(hits))
            # Repeats within the chunk need no answer: an aligned block that it holds twice.
            values, counts = np.unique(h10, return_counts=True)
            twice = values[counts > 1]
            aligned = np.unique(h10[(at10 - offsets[owner]) % block == 0])
            hit |= np.isin(h10, np.intersect1d(twice, aligned, assume_unique=True))
            at = _starts(offsets, size)
            run_sum = np.zeros(offsets[-1] + 1, dtype=np.int64)
            mark = np.zeros(offsets[-1], dtype=np.int64)
            mark[at10[hit]] = 1
            np.cumsum(mark, out=run_sum[1:])
            near = run_sum[at + size - block + 1] > run_sum[at]
            a, b, at = a[near], b[near] & _HALF, at[near]
            first = _first_of_each(a, b)
            ids = table["doc_id"].to_pylist()
            doc = np.array([_NO_ID if x is None else x for x in ids], dtype=np.int64)
            first.sort()  # by document, for runs
            rows = np.empty(len(first), dtype=_WINDOW)
            rows["a"], rows["b"] = a[first], b[first]
            doc = doc[np.searchsorted(offsets, at[first], side="right") - 1]
            for bucket, span, order in _deal(rows["a"], parts):
                sent[bucket] = _pack_runs(rows[order[span]], doc[order[span]])
        chunk = table["chunk"][0].as_py() if table.num_rows else None
        return pa.table({
            "bucket": pa.array(list(sent), pa.int64()), "chunk": pa.array([chunk] * len(sent), pa.int64()),
            "windows": pa.array(list(sent.values()), pa.binary()),
        })

    return run


def _starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Where windows of ``size`` words start that stay within one document."""
    inside = np.ones(max(0, offsets[-1] - size + 1), dtype=bool)
    for end in offsets[1:-1]:
        inside[max(0, end - size + 1) : end] = False
    return np.flatnonzero(inside)


def _losers(table: pa.Table) -> pa.Table:
    """Windows whose first occurrence lies in another chunk; to each chunk its own."""
    chunks = table["chunk"].to_pylist()
    pieces = [_unpack_runs(x) for x in table["windows"].to_pylist()]
    rows, doc = np.concatenate([p for p, _ in pieces]), np.concatenate([d for _, d in pieces])
    who = np.repeat(np.arange(len(pieces)), [len(p) for p, _ in pieces])
    order = np.lexsort((doc, rows["b"], rows["a"]))
    rows, who = rows[order], who[order]
    later = np.zeros(len(rows), dtype=bool)
    later[1:] = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
    rows, who = rows[later], who[later]
    order = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[order], np.arange(len(chunks) + 1))
    out = []
    for i, chunk in enumerate(chunks):
        own = rows[order[ends[i] : ends[i + 1]]]
        if len(own):
            out.append((chunk, own["a"].tobytes(), own["b"].tobytes()))
    return pa.table({
        "chunk": pa.array([x[0] for x in out], pa.int64()), "a": pa.array([x[1] for x in out], pa.binary()),
        "b": pa.array([x[2] for x in out], pa.binary()),
    })


def _removed(size: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Words covered by repeated windows go; the rest is joined by one space."""
        table = _order(table)
        rows = utf8(table["text"])
        (a, b), offsets, at = _hashed(table, (size, 0), (size, 1))
        b &= _HALF
        again = np.ones(len(a), dtype=bool)
        again[_first_of_each(a, b)] = False
        pairs = np.empty((sum(map(len, (x for x in answers["a"].to_pylist()))) // 8, 2), dtype=np.uint64)
        if len(pairs):
            pairs[:, 0] = np.frombuffer(b"".join(answers["a"].to_pylist()), dtype="<u8")
            pairs[:, 1] = np.frombuffer(b"".join(answers["b"].to_pylist()), dtype="<u4")
            pairs = pairs[np.argsort(pairs[:, 0])]
            found = np.minimum(np.searchsorted(pairs[:, 0], a), len(pairs) - 1)
            again |= (pairs[found, 0] == a) & (pairs[found, 1] == b)
        edge = np.zeros(offsets[-1] + 1, dtype=np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + size, -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept, n_removed = [], []
        for row, begin, end in zip(rows, offsets[:-1], offsets[1:], strict=True):
            own = gone[begin:end]
            n_removed.append(int(own.sum()))
            kept.append(b" ".join(itertools.compress(row.split(), ~own) if n_removed[-1] else row.split()))
        return pa.table({
            "doc_id": table["doc_id"],
            "n_words": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, window: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_words``, ``n_removed`` and ``kept_text``, the
    words left, joined by one space.

    A word goes if a window of ``window`` consecutive words covers it whose words also start
    earlier: in a smaller doc_id, or earlier in the same document. Everything is judged on the
    input. Null or empty texts have no words; texts shorter than a window keep all. Rows that
    share a doc_id (or have none: they come first) are ordered by text, so of repeated rows one
    keeps its words. Window sequences are compared by 96-bit hashes."""
    block = (window + 1) // 2
    n_chunks = parts_for(docs, chunk_bytes)
    parts = max(1, n_chunks * chunk_bytes // BUCKET_BYTES)
    dealt = texts(docs).withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(n_chunks)))
    chunks = dealt.groupBy("chunk")
    anchors = chunks.applyInArrow(_blocks(block, parts), "bucket long, chunk long, anchors binary, probes binary")
    hits = anchors.groupBy("bucket").applyInArrow(_match, "chunk long, hits binary")
    sequences = chunks.cogroup(hits.groupBy("chunk")).applyInArrow(
        _windows(window, block, parts), "bucket long, chunk long, windows binary"
    )
    repeated = sequences.groupBy("bucket").applyInArrow(_losers, "chunk long, a binary, b binary")
    return chunks.cogroup(repeated.groupBy("chunk")).applyInArrow(
        _removed(window), "doc_id long, n_words long, n_removed long, kept_text string"
    )
