"""Substring de-duplication and near duplicates against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairforge.llm import near_dups
from pairforge.llm.near_dups import agreement, components, drop_near_duplicates, minima, near_duplicates, pack, shingle_sets
from pairforge.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, size):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [True] * size
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_repeats_of_odd_rows(odd_docs, odd_rows):
    for chunk in (12_000_000, 2_000):
        got = [tuple(r) for r in remove_repeats(odd_docs, chunk_bytes=chunk).collect()]
        assert sorted(got, key=repr) == brute_repeats([r[:2] for r in odd_rows], 20)


def test_repeats_of_passages(spark):
    """Passages of many lengths at many offsets, in few words so that blocks repeat by chance."""
    rng = random.Random(5)
    rows = []
    passages = [[rng.choice("abc") for _ in range(rng.randint(5, 40))] for _ in range(12)]
    for i in range(120):
        text = [w for _ in range(rng.randint(0, 6)) for w in (rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(9)])]
        rows.append((rng.randint(0, 99), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (7, 20):
        got = [tuple(r) for r in remove_repeats(docs, window=size, chunk_bytes=400).collect()]
        assert sorted(got, key=repr) == brute_repeats(rows, size)


def test_repeats_of_nothing(no_docs):
    assert remove_repeats(no_docs).collect() == []


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_components(rows, percent):
    sets = sets_of(r for r in rows if r[0] is not None)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            linked = any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b])
            if a < b and linked:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows):
    got = near_duplicates(odd_docs, 85).collect()
    want = brute_components([r[:2] for r in odd_rows], 85)
    assert len(got) == len(odd_rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = sets_of(r[:2] for r in odd_rows)
    assert all(r.n_shingles == len(sizes[r.doc_id][0]) for r in got)


def test_near_duplicates_of_families(spark):
    """Families of edited copies whose similarities lie on both sides of the limit."""
    rng = random.Random(3)
    rows, i = [], 0
    for family in range(6):
        base = [f"f{family}w{rng.randint(0, 5000)}" for _ in range(150)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(text)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        want = brute_components(rows, percent)
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, percent).collect()} == want
        kept = drop_near_duplicates(docs, percent)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
        assert kept.columns == docs.columns


def test_near_duplicates_of_cut_buckets(spark):
    """Buckets of many pieces, piece pivots of several levels, give what whole buckets give."""
    rng = random.Random(7)
    rows, i = [], 0
    for family in range(3):
        base = [f"f{family}w{rng.randint(0, 5000)}" for _ in range(120)]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randint(0, 7)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(text)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 85)
    for most in (3, 10):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, 85, most=most).collect()} == want


def test_no_group_of_a_task_holds_a_whole_hot_bucket(spark):
    """Both dealings of one bucket of 5,000 members, at about 100 members a group."""
    members = spark.range(5000).select(F.lit(1).cast("long").alias("key"), "id", F.lit(5000).cast("long").alias("k"))
    pieces = near_dups._in_pieces(members, 100).groupBy("key", "part").count().collect()
    assert sum(r["count"] for r in pieces) == 5000 and max(r["count"] for r in pieces) < 200
    for outside in (1, 300, 4000):  # so many members outside the largest component, each its own
        known = members.select("key", "id", F.expr(f"if(id < {outside}, id, 9999)").alias("comp"))
        dealt = near_dups._spread(near_dups._piece_by_slice(known, 100))
        rows = dealt.groupBy("key", "part").agg(
            F.count("*").alias("n"), F.sum(F.col("in_slice").cast("long")).alias("s"), F.sum(F.col("in_piece").cast("long")).alias("p")
        ).collect()
        assert max(r.n for r in rows) < 400 and max(max(r.s, r.p) for r in rows) < 200
        assert sum(r.s * r.p for r in rows) == 5000 * outside  # every member meets every one outside


def test_near_duplicates_of_nothing(no_docs):
    assert near_duplicates(no_docs).collect() == []
    assert drop_near_duplicates(no_docs).collect() == []


def test_components_of_chains(spark):
    """A long chain, a ring and a star end in few rounds, whatever their order."""
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 200 + i) for i in range(1, 30)]
    rng.shuffle(edges)
    got = {r.a: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 109)) and all(got[i] == 200 for i in range(201, 230))


def test_agreement_estimates_similarity():
    words = [f"w{i}" for i in range(2000)]
    a, b = (next(shingle_sets([" ".join(t).encode()], 5)) for t in (words, words[:1700] + [f"v{i}" for i in range(300)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = (np.frombuffer(pack(minima(s)), dtype="<u8") for s in (a, b))
    assert abs(agreement(x, y) - true) < 0.1
    assert agreement(x, x) == 1


def test_pairs_of_unlike_families_stay_in_the_task(spark, monkeypatch):
    """Texts that share shingles at 0.75 and are no near duplicates at 0.8: many pairs to compare, few rows."""
    monkeypatch.setattr(near_dups, "SHINGLES", 20_000)
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join([*common, *(f"u{i}x{j}" for j in range(int(rng.integers(42, 52))))])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 400, 4)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, most=150).collect()}
    sets = {i: {tuple(w[j : j + 5]) for w in [x.split()] for j in range(len(w) - 4)} for i, x in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {i: root(i) for i in sets}


def test_links_between_components_are_a_forest():
    """One group of 400 members in components of their own, all linked: 399 links leave the task."""
    docs = [(" ".join(f"c{i}" for i in range(300)) + f" tail {k}").encode() for k in range(400)]
    sets = list(shingle_sets(docs, 5))
    sketches = [pack(minima(s)) for s in sets]
    n = len(docs)
    t = pa.table({
        "key": np.zeros(n, dtype=np.int64), "part": np.zeros(n, dtype=np.int64), "id": np.arange(n), "n": np.array([len(s) for s in sets]),
        "comp": np.arange(n), "sketch": sketches, "bands": [[0] * near_dups.BANDS] * n, "outside": np.arange(n) > 0,
        "in_piece": np.arange(n) > 0, "in_slice": np.ones(n, dtype=bool), "shingles": [s.tobytes() for s in sets],
    })
    rows = pa.Table.from_batches(list(near_dups._to_compare(80)(iter(t.to_batches()))))
    assert rows.num_rows == n
    links = pa.Table.from_batches(list(near_dups._across(80)(iter(rows.to_batches()))))
    assert links.num_rows == n - 1
