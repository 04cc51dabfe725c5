"""Hashes of byte ranges: the same wherever the ranges lie, from short running sums."""

import numpy as np

from pairforge.llm import hashing


def test_hashes_of_a_long_batch_need_short_tables(monkeypatch):
    """3 MB of pieces of many lengths, one of them longer than a run: hashes as one by one."""
    monkeypatch.setattr(hashing, "_FAMILIES", {})
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 150_000)
    sizes[70_000] = 300_000
    data = rng.integers(0, 256, int(sizes.sum()), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for k in (0, 1):
        got = hashing.pieces_hash(data, starts, ends, k)
        for i in [0, 1, 69_999, 70_000, 70_001, *rng.integers(0, len(sizes), 200)]:
            one = data[starts[i] : ends[i]]
            assert hashing.pieces_hash(one, np.array([0]), np.array([len(one)]), k)[0] == got[i]
        assert len(hashing.family(k).up) <= 1 << 19  # 512 KiB of text; the whole batch would need 2**22


def test_hashes_of_no_pieces():
    none = np.zeros(0, dtype=np.int64)
    assert len(hashing.pieces_hash(np.zeros(3, dtype=np.uint8), none, none)) == 0
