"""Hashes of words and of word windows for a batch of texts, in numpy.

Texts are UTF-8. A word's hash is a polynomial over its bytes modulo 2**64, taken from one
running sum over the whole batch and then mixed; a window's hash combines word hashes. Two
independent families give 128 bits where equality of hashes stands for equality of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text whose running sum is held at a time; a longer piece has one of its own.
RUN_BYTES = (1 << 18) - 1
#: Odd multipliers, one per family.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit value (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown when a longer batch comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, by in (("up", self.base), ("down", self.inverse)):
                run = np.full(size, by, dtype=np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))
        return self.up, self.down


_FAMILIES: dict[int, _Powers] = {}


def family(k: int) -> _Powers:
    if k not in _FAMILIES:
        _FAMILIES[k] = _Powers(_BASES[k])
    return _FAMILIES[k]


def pieces_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """Hash of each byte range of ``data``; its length counts. Ranges are ascending. The running
    sum is made for about ``RUN_BYTES`` at a time: a hash does not depend on where its range lies,
    and a worker keeps powers for the longest run it has met."""
    powers, h = family(k), np.empty(len(starts), dtype=np.uint64)
    begin = 0
    while begin < len(starts):
        at = int(starts[begin])
        end = max(begin + 1, int(np.searchsorted(ends, at + RUN_BYTES, side="right")))
        part = data[at : int(ends[end - 1])]
        up, down = powers.of(len(part) + 1)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(powers.table[part] * up[: len(part)], out=run[1:])
        first = starts[begin:end] - at
        h[begin:end] = (run[ends[begin:end] - at] - run[first]) * down[first]
        begin = end
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """Words of a batch of texts: ``starts`` and ``ends`` in ``data``, and per text the range
    ``first[i]:first[i + 1]`` of its words."""

    def __init__(self, batch: list[bytes]):
        self.data = np.frombuffer(b" " + b" ".join(batch) + b" ", dtype=np.uint8)
        inside = ~_SPACE[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in batch), dtype=np.int64, count=len(batch))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], 1 + np.cumsum(sizes)]))
        if len(batch) == 0:
            self.first = np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, k: int = 0) -> np.ndarray:
        return pieces_hash(self.data, self.starts, self.ends, k)

    def owner(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(word_hash: np.ndarray, first: np.ndarray, size: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that stay within one text, and where they start."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    by = np.uint64(_BASES[k])
    h = word_hash[:n].copy()
    for j in range(1, size):
        h *= by
        h += word_hash[j : j + n]
    inside = np.ones(n, dtype=bool)
    for end in first[1:-1]:
        inside[max(0, end - size + 1) : end] = False
    at = np.flatnonzero(inside)
    return mix(h[at]), at


def batches(items: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """Ranges of consecutive items of about ``most`` bytes; a longer item stands alone."""
    begin = size = 0
    for i, item in enumerate(items):
        if size and size + len(item) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(item) + 1
    if begin < len(items):
        yield slice(begin, len(items))


def utf8(column) -> list[bytes]:
    """Bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
