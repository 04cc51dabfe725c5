"""Language identification by unigram models of pieces, summed over all segmentations.

Each language has a probability for every piece of one public vocabulary (and for every single
byte, so that any text can be cut). A word's probability is the sum over all ways to cut it
into pieces, by the forward algorithm; a text's is the product over its words. Probabilities
are learned by expectation-maximisation: the forward-backward algorithm gives the expected
number of each piece over all segmentations of all words of the training texts.

Words, with a blank before them and A-Z lower-cased, are scored once per batch however often
they occur. Words over ``UNIT`` bytes are cut there, so a text without blanks costs no more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import durable, texts
from pairforge.llm.hashing import Words, batches, pieces_hash, utf8

#: Bytes of the longest unit; rounds of expectation-maximisation; least probability of a piece
#: that is a single byte (any piece: ``FLOOR`` squared), so that no unit underflows.
UNIT, ROUNDS, FLOOR = 64, 2, 1e-6
#: Probabilities are scaled by this factor a byte while they are summed.
_SCALE = float(np.exp(4.0))
#: Units that are summed together; text bytes of a batch; units a task remembers.
_TOGETHER, _BATCH, _KNOWN = 8192, 1 << 22, 400_000


def pieces_of(path: str) -> list[bytes]:
    """Distinct pieces of a sentencepiece file and all single bytes; its word mark is a blank,
    A-Z are lower-cased, control pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    found = {model.id_to_piece(i).replace("▁", " ").encode().lower() for i in plain}
    return sorted(p for p in found | {bytes([b]) for b in range(256)} if 0 < len(p) <= UNIT)


class Units:
    """Words of a batch as units of a blank and at most ``UNIT`` - 1 bytes, distinct ones once.

    ``data`` holds the distinct units one after another, longest first, from ``start`` on;
    ``of`` numbers the units of the batch in order, ``first`` is the range of each text."""

    def __init__(self, rows: list[bytes]):
        w = Words([r.lower() for r in rows])
        size = UNIT - 1
        cuts = (w.ends - w.starts + size - 1) // size
        word = np.repeat(np.arange(len(w)), cuts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = w.starts[word] + nth * size
        ends = np.minimum(starts + size, w.ends[word])
        self.first = np.concatenate([[0], np.cumsum(cuts)])[w.first]
        # Two units are one if 64 bits and the length agree: a clash changes one word's score.
        key = pieces_hash(w.data, starts, ends)
        self.key, at, self.of, self.times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        length = ends[at] - starts[at] + 1
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.of, at, self.times, self.length, self.key = place[self.of], at[order], self.times[order], length[order], self.key[order]
        self.start = np.cumsum(self.length) - self.length
        self._fill(w.data, starts[at])

    def _fill(self, data: np.ndarray, starts: np.ndarray) -> None:
        inside = np.arange(int(self.length.sum())) - np.repeat(self.start, self.length)
        self.data = np.where(inside == 0, 0x20, data[np.repeat(starts, self.length) + np.maximum(inside - 1, 0)]).astype(np.uint8)

    def only(self, which: np.ndarray) -> Units:
        """The distinct units at ``which`` (ascending) alone; texts are not kept."""
        own = object.__new__(Units)
        own.key, own.length, own.times = self.key[which], self.length[which], self.times[which]
        own.start = np.cumsum(own.length) - own.length
        own.data = self.data[np.repeat(self.start[which] - own.start, own.length) + np.arange(int(own.length.sum()))]
        return own


@dataclass
class Pieces:
    """Hashes of all pieces, sorted, how long each is, and which upper 20 bits of hashes occur."""

    hashes: np.ndarray
    sizes: np.ndarray
    upper: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        h = pieces_hash(data, ends - size, ends)
        order = np.argsort(h)
        if (np.diff(h[order]) == 0).any():
            raise ValueError("two pieces share a hash")
        upper = np.zeros(1 << 20, dtype=bool)
        upper[h >> np.uint64(44)] = True
        return cls(h[order], size[order], upper)

    def found(self, u: Units, begin: int, end: int) -> list[np.ndarray]:
        """For each length m from 1 on: the piece at every byte of units begin..end - 1 that is m
        bytes long, or -1 (none, or it would leave the unit)."""
        low, high = u.start[begin], u.start[end - 1] + u.length[end - 1]
        at = np.arange(low, high)
        stop = np.repeat((u.start + u.length)[begin:end], u.length[begin:end])
        out = []
        for m in range(1, min(int(self.sizes.max()), int(u.length[begin])) + 1):
            ids = np.full(len(at), -1, dtype=np.int32)
            fits = np.flatnonzero(at + m <= stop)
            h = pieces_hash(u.data[low:high], fits, fits + m)
            maybe = np.flatnonzero(self.upper[h >> np.uint64(44)])
            fits, h = fits[maybe], h[maybe]
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids[fits] = np.where(self.hashes[place] == h, place, -1)
            out.append(ids)
        return out


def _forward(found: list[np.ndarray], start: np.ndarray, length: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Scaled sums over all segmentations of each unit's first j bytes, an entry for each byte end;
    ``prob`` has a row a piece (the last: no piece) and a column a language."""
    total = np.zeros((int(length.sum()) + len(length), prob.shape[1]))
    base = start + np.arange(len(start))  # one more entry than bytes a unit
    total[base] = 1.0
    for j in range(1, int(length[0]) + 1):
        n = int(np.searchsorted(-length, -j, side="right"))  # longest first
        own = np.zeros((n, prob.shape[1]))
        for m in range(1, min(j, len(found)) + 1):
            ids = found[m - 1][start[:n] + j - m]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                own[hit] += total[base[hit] + j - m] * prob[ids[hit]]
        total[base[:n] + j] = own
    return total


def log_probabilities(u: Units, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Logarithm of each distinct unit's probability under each language; ``prob`` is scaled."""
    out = np.zeros((len(u.length), prob.shape[1]))
    for begin in range(0, len(u.length), _TOGETHER):
        end = min(begin + _TOGETHER, len(u.length))
        start, length = u.start[begin:end] - u.start[begin], u.length[begin:end]
        total = _forward(pieces.found(u, begin, end), start, length, prob)
        out[begin:end] = np.log(total[start + np.arange(len(start)) + length]) - np.log(_SCALE) * length[:, None]
    return out


class Remembered:
    """Logarithms of units by key, kept from batch to batch of a task; all are forgotten when
    there are more than ``_KNOWN``."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        self._forget()

    def _forget(self) -> None:
        self.keys, self.logs = np.zeros(0, dtype=np.uint64), np.zeros((0, self.prob.shape[1]))

    def of(self, u: Units) -> np.ndarray:
        """As ``log_probabilities``."""
        out = np.zeros((len(u.key), self.prob.shape[1]))
        place = np.minimum(np.searchsorted(self.keys, u.key), max(len(self.keys) - 1, 0))
        known = self.keys[place] == u.key if len(self.keys) else np.zeros(len(u.key), dtype=bool)
        out[known] = self.logs[place[known]]
        new = np.flatnonzero(~known)
        out[new] = log_probabilities(u.only(new), self.pieces, self.prob)
        if len(self.keys) + len(new) > _KNOWN:
            self._forget()
        if len(new) <= _KNOWN:
            keys, logs = np.concatenate([self.keys, u.key[new]]), np.concatenate([self.logs, out[new]])
            order = np.argsort(keys)
            self.keys, self.logs = keys[order], logs[order]
        return out


def expected_pieces(u: Units, weight: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the units, each ``weight`` times;
    ``prob`` of one language, scaled."""
    out = np.zeros(len(pieces.hashes))
    for begin in range(0, len(u.length), _TOGETHER):
        end = min(begin + _TOGETHER, len(u.length))
        start, length = u.start[begin:end] - u.start[begin], u.length[begin:end]
        found = pieces.found(u, begin, end)
        total = _forward(found, start, length, prob[:, None])[:, 0]
        base = start + np.arange(len(start))
        after = np.zeros_like(total)
        after[base + length] = weight[begin:end] / total[base + length]
        for j in range(int(length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-length, -j, side="left"))  # units longer than j
            own = np.zeros(n)
            for m in range(1, min(int(length[0]) - j, len(found)) + 1):
                ids = found[m - 1][start[:n] + j]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    share = prob[ids[hit]] * after[base[hit] + j + m]
                    own[hit] += share
                    np.add.at(out, ids[hit], total[base[hit] + j] * share)
            after[base[:n] + j] = own
    return out


@dataclass
class LangModel:
    """Languages, logarithms of their shares, and scaled probabilities of pieces (a row each)."""

    langs: list[str]
    share: np.ndarray
    pieces: Pieces
    prob: np.ndarray


def _scaled(counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    p = counts + 0.01
    p = np.maximum(p / p.sum(), np.where(pieces.sizes == 1, FLOOR, FLOOR**2))
    return p / p.sum() * _SCALE**pieces.sizes


def _gathered(tables: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows again, about ``rows`` at a time: short loops over many units cost least."""
    held, size = [], 0
    for t in tables:
        held.append(t)
        size += t.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _expected(langs: list[str], pieces: Pieces, prob: np.ndarray):
    number = {lang: i for i, lang in enumerate(langs)}

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for t in _gathered(tables, 1 << 16):
            of = np.array([number[x] for x in t["lang"].to_pylist()])
            words, n = utf8(t["word"]), t["n"].to_numpy()
            for lang in np.unique(of):
                mine = np.flatnonzero(of == lang)
                u = Units([words[i] for i in mine])
                # Every unit of a word counts as often as the word.
                weight = np.bincount(u.of, weights=np.repeat(n[mine], np.diff(u.first)), minlength=len(u.length))
                total[lang] = total.get(lang, 0) + expected_pieces(u, weight, pieces, prob[:, lang])
        for lang, found in total.items():
            at = np.flatnonzero(found > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "piece", "n"]
            )

    return run


def _word_counts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        langs, rows = np.array(t["lang"].to_pylist(), dtype=object), utf8(t["text"])
        for part in batches(rows):
            for lang in sorted(set(langs[part])):
                u = Units([r for r, x in zip(rows[part], langs[part], strict=True) if x == lang])
                units = [u.data[s + 1 : s + n].tobytes() for s, n in zip(u.start, u.length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(units), pa.string()), pa.array(units, pa.binary()), pa.array(u.times)], ["lang", "word", "n"]
                )


def held_out(doc_id: Column) -> Column:
    """Documents kept from training; a null doc_id is not one, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, rounds: int = ROUNDS) -> LangModel:
    """Learn from text and lang of all rows of ``docs`` (no sample). Words are counted per
    language by Spark; each round sums expected pieces in tasks, and one number per language
    and piece comes to the driver."""
    rows = docs.where("lang is not null").select("lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shares = sorted(map(tuple, rows.groupBy("lang").count().collect()))
    langs = [lang for lang, _ in shares]
    pieces = Pieces.of(pieces_of(path))
    size = (len(pieces.hashes), len(langs))
    share = np.log(np.array([n for _, n in shares], dtype=float) / sum(n for _, n in shares)) if shares else np.zeros(0)
    prob = np.tile(_scaled(np.ones(size[0]), pieces)[:, None], (1, size[1]))
    if langs:
        words = durable(rows.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
        for _ in range(rounds):
            sums = words.mapInArrow(_expected(langs, pieces, prob), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
            counts = np.zeros(size)
            for t in sums.toArrow().to_batches():
                counts[t["piece"].to_numpy(), t["lang"].to_numpy()] = t["n"].to_numpy()
            prob = np.stack([_scaled(counts[:, i], pieces) for i in range(size[1])], axis=1)
    return LangModel(langs, share, pieces, prob)


def _identified(model: LangModel):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(model.pieces, model.prob)
        for t in tables:
            rows, letters = utf8(t["text"]), t["has_letter"].to_numpy(zero_copy_only=False)
            lang, score = [], []
            for part in batches(rows, _BATCH):
                u = Units(rows[part])
                each = known.of(u)[u.of]
                sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
                total = sums[u.first[1:]] - sums[u.first[:-1]] + model.share
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang += [model.langs[i] if ok else "und" for i, ok in zip(best, letters[part], strict=True)]
                score += list(np.where(letters[part], sure, 0.0))
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"], t["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (posterior probability) of every row.
    Texts that are null or have no letter, and all texts when nothing was learned, are ``und``
    with score 0; equal posteriors go to the first language by name. Reads doc_id and text alone."""
    rows = texts(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.col("text").rlike(r"\p{L}").alias("has_letter"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_identified(model), f"doc_id {key}, held_out boolean, lang_pred string, score double")
