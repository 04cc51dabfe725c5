"""Conversation trie, collocations and language models against brute force."""

import collections
import hashlib
import math
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import collocations, lang_pieces, prefix_trie
from pairforge.llm.queries import LLM_QUERIES, _vocabulary

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [t[-1] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += children[k] == 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {min(t, c % 3)} é") for c in range(-7, 40) for t in range(c % 6 + 1)]
    rows += [(c, t, "user", f"shared {t}") for c in range(100, 130) for t in range(12)]  # copies
    rows += [(200, t, "bot", f"long {t}") for t in range(120)] + [(204, t, "bot", f"long {t}") for t in range(119)]
    rows += [(300, None, None, None), (300, None, "a", ""), (300, 1, "", "a"), (300, 1, "", "a"), (301, 1, "x", "b"), (None, 0, "user", "lost")]
    rows += [(402, 0, "u", "base is absent")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("span,positions", [(4096, 65536), (7, 50)])
def test_trie_matches_brute_force(spark, odd_conversations, monkeypatch, span, positions):
    monkeypatch.setattr(prefix_trie, "RANGE", span)
    monkeypatch.setattr(prefix_trie, "POSITIONS", positions)
    clashing = odd_conversations.withColumns({c: F.lit("own") for c in ("pos", "depth", "part", "row", "n", "x", "h", "run", "range", "content")})
    got = prefix_trie.prefix_trie(clashing.repartition(5)).collect()
    rows = [tuple(r) for r in odd_conversations.collect()]
    assert sorted(map(tuple, got)) == brute_trie(rows)
    assert prefix_trie.prefix_trie(odd_conversations.where("1 = 0")).collect() == []


def test_given_conversations(spark):
    got = LLM_QUERIES["op11_prefix_trie"](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect())) == brute_trie(rows)


def test_list_ranking_by_levels(spark):
    order = np.random.default_rng(3).permutation(3000)
    rows = [(int(a), int(b) if b is not None else None, int(a) % 7) for a, b in zip(order, [*order[1:], None], strict=True)]
    ranked = prefix_trie.list_rank(spark.createDataFrame(rows, "id long, next long, weight long"), sparse=8, few=20)
    rest = np.cumsum(order[::-1] % 7)[::-1]
    assert {r.id: r.rest for r in ranked.collect()} == {int(a): int(b) for a, b in zip(order, rest, strict=True)}


def test_rounds_of_list_ranking_do_not_square_the_estimate(spark):
    """A checkpoint keeps the estimated bytes of its plan. Were the rounds joins, that number would have
    twice as many digits after each of them, until it fills the driver."""
    order = [int(i) for i in np.random.default_rng(5).permutation(80)]
    rows = [(a, b, 1) for a, b in zip(order, [*order[1:], None], strict=True)]
    ranked = prefix_trie.list_rank(spark.createDataFrame(rows, "id long, next long, weight long"), sparse=4, few=5)
    assert ranked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert sorted(map(tuple, ranked.collect())) == sorted((a, 80 - i) for i, a in enumerate(order))


def brute_phrases(rows, longest=3, least=10, within=50, best=2000):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= within * f[p[i : i + m]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,best,budget", [(3, 10, 2000, 4_000_000), (3, 2, 50, 300), (4, 3, 2000, 40), (2, 2, 2000, 20)])
def test_collocations_match_brute_force(spark, longest, least, best, budget):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").repartition(4)
    rows = [("x", "a b a b a b. a b, a b"), ("x", "A  B\ta b;a\x0bb"), (None, "x y z " * 30), (None, "x y z."), ("y", None), ("z", " ?! "), ("z", "ß𝒳 é " * 20)]
    both = docs.union(spark.createDataFrame(rows, "lang string, text string"))
    clashing = both.withColumns({c: F.lit("own") for c in ("word", "words", "h", "n", "a", "l", "r", "score", "rank", "k", "doc_id")})
    got = collocations.collocations(clashing, longest=longest, least=least, best=best, budget=budget)
    assert sorted(map(tuple, got.collect())) == brute_phrases([tuple(r) for r in both.collect()], longest, least, best=best)
    assert collocations.collocations(both.where("1 = 0")).collect() == []


def test_collocation_blocks(spark, monkeypatch):
    """Texts longer than a block, and many blocks a group."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    rows = [("x", f"one two three four {i % 5} " * 40) for i in range(30)] + [("y", "one two three")] * 20
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    words, family = collocations.word_counts(docs)
    borders, frequent = collocations._groups(words, 100, 1000)
    tables = [b for b in docs.toArrow().to_batches()]
    blocks = list(collocations._subtrees(family, 3, borders, frequent)(iter(tables)))
    assert len(blocks) > 60 and any(b["group"][0].as_py() < 0 for b in blocks)
    blocks.sort(key=lambda b: (b["lang"][0].as_py(), b["group"][0].as_py()))
    got = collections.Counter()
    for t in collocations._phrases(3, 10)(iter(blocks)):
        for lang, phrase, n in zip(*(t[c].to_pylist() for c in ("lang", "words", "n")), strict=True):
            got[lang, tuple(phrase)] += n
    spelled = {(r.lang, r.h): r.word for r in words.collect()}
    got = {(lang, " ".join(spelled[lang, h] for h in p)): n for (lang, p), n in got.items() if n >= 10}
    want = collections.Counter()
    for lang, text in rows:
        ws = text.split()
        want.update((lang, " ".join(ws[i : i + k])) for k in (2, 3) for i in range(len(ws) - k + 1))
    assert got == {k: n for k, n in want.items() if n >= 10}


def test_sums_over_segmentations():
    pieces = lang_pieces.pieces_of(_vocabulary("piece_bpe_32k.model"))
    index = lang_pieces.Pieces.of(pieces)
    share = np.random.default_rng(1).random(len(pieces)) ** 8 + 1e-9
    share /= share.sum()
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    place = np.searchsorted(index.hashes, lang_pieces.pieces_hash(data, ends - [len(p) for p in pieces], ends))
    prob = np.zeros(len(pieces))
    prob[place] = share * lang_pieces._SCALE ** index.sizes[place]
    by_piece = dict(zip(pieces, share, strict=True))

    def brute(word):
        sums = [1.0]
        for j in range(1, len(word) + 1):
            sums.append(sum(sums[i] * by_piece.get(word[i:j], 0) for i in range(j)))
        return math.log(sums[-1])

    units = lang_pieces.Units([b"hello worlds of the THE x", b"", b"\xc3\xa9tait " + b"a" * 150, b"the of"])
    assert list(units.first) == [0, 6, 6, 10, 12]
    words = [units.data[s : s + n].tobytes() for s, n in zip(units.start, units.length, strict=True)]
    assert [words[i] for i in units.of[:6]] == [b" hello", b" worlds", b" of", b" the", b" the", b" x"]
    scores = lang_pieces.log_probabilities(units, index, prob[:, None])
    assert scores[:, 0] == pytest.approx([brute(w) for w in words])
    expected = lang_pieces.expected_pieces(units, units.times.astype(float), index, prob)
    for piece in (b" the", b"e", b"a", b"aa", b" h", b"or", b" of"):
        step = prob.copy()
        step[place[pieces.index(piece)]] *= 1 + 1e-6  # the expected number is the derivative by the logarithm
        change = ((lang_pieces.log_probabilities(units, index, step[:, None]) - scores)[:, 0] * units.times).sum()
        assert expected[place[pieces.index(piece)]] == pytest.approx(change / 1e-6, rel=1e-3, abs=1e-4)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in LLM_QUERIES["op13_language_pieces"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    right = total = 0
    for r in docs.select("doc_id", "lang", "text").collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (got[r.doc_id].lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
        assert 0 <= got[r.doc_id].score <= 1
        if got[r.doc_id].held_out:
            right, total = right + (got[r.doc_id].lang_pred == r.lang), total + 1
    assert right / total > 0.98


def test_odd_languages(spark, odd_docs, no_docs):
    path = _vocabulary("piece_bpe_32k.model")
    odd = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 8, "en").when(F.col("doc_id") < 11, "de"))
    model = lang_pieces.fit(odd, path, rounds=2)
    assert model.langs == ["de", "en"]
    got = lang_pieces.identify(odd, model).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "und") for r in got)
    nothing = lang_pieces.fit(no_docs, path)
    assert {(r.lang_pred, r.score) for r in lang_pieces.identify(odd, nothing).collect()} == {("und", 0.0)}
    assert lang_pieces.identify(no_docs, model).collect() == []
