"""Fingerprints, mixing, token files, packing and the pipeline."""

import collections
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairforge.llm import fingerprints, mixing, packing, token_files
from pairforge.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jaccard(a, b):
    a, b = (collections.Counter(WORD.findall(x)) for x in (a, b))
    words = a.keys() | b.keys()
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def test_fingerprints_of_edits(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprints.with_edits(docs).collect()}
    off = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(got[i].near_edited - jaccard(text, edited))
        off.append(got[i].near_next - jaccard(text, after))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12
    by_text = collections.defaultdict(set)
    for i, text in rows:
        by_text[text].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    odd = fingerprints.with_edits(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in odd) == sorted((r[0] is None, r[0] or 0) for r in odd_rows)
    named = {r.doc_id: r for r in odd}
    assert named[1].fingerprint == named[3].fingerprint != "" and named[4].fingerprint == "" == named[6].fingerprint
    assert named[4].near_next == 1 and named[17].edited_sha256 == hashlib.sha256(b"ona").hexdigest()
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(odd_docs).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in odd}
    assert fingerprints.with_edits(no_docs).collect() == []


def test_targets_fill_like_water(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 500), ("é", 0), ("d", 300)]
    rows = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n_docs long")).collect()
    assert [r.source for r in sorted(rows, key=lambda r: r.number)] == ["a", "b", "c", "d", "é", None]
    left, level, open_ = float(sum(n for _, n in sizes)), 0.0, {s: ((5, 2, 1)[i % 3], 3.0 * dict(sizes)[s]) for i, s in enumerate(["a", "b", "c", "d", "é", None])}
    want = {}
    while True:
        level = left / sum(w for w, _ in open_.values())
        full = [s for s, (w, cap) in open_.items() if level * w > cap]
        if not full:
            want.update({s: level * w for s, (w, _) in open_.items()})
            break
        for s in full:
            want[s] = open_.pop(s)[1]
            left -= want[s]
    assert all(r.target == pytest.approx(want[r.source]) for r in rows)


def check_plan(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by_source[r.target, r.source_size].append(r)
    for (target, size), own in by_source.items():
        assert sum(r.size for r in own) % max(size, 1) == 0 or size == 0
    return by_source


def test_mixing(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix_plan(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in plan}
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1.001
        whole = int(own[0].target // own[0].source_size)
        assert all(whole * r.size <= r.taken <= (whole + 1) * r.size for r in own)
        assert sum(whole * r.size < r.taken < (whole + 1) * r.size for r in own) <= 1
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    rows = mixed.collect()
    odd = mixing.mix_plan(odd_docs).collect()
    assert len(odd) == len(odd_rows) and sum(r.taken for r in odd) == sum(len(WORD.findall(r.text)) for r in rows)
    assert all(r.key == "own key" and r.n_chars == len(r.text) for r in rows)
    assert mixing.mix(no_docs).collect() == []


def test_mix_against_plain_prefix_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")), 11) + 0.5) / F.lit(2.0**53)
    keyed = docs.select("doc_id", "source", "text", (-F.log(u)).alias("e"), mixing._measure("text").alias("m")).collect()
    want, sources = {}, sorted({r.source for r in keyed if r.source is not None}) + [None] * any(r.source is None for r in keyed)
    sizes = {s: sum(r.m.size for r in keyed if r.source == s) for s in sources}
    full, level, left = {}, list(sources), float(sum(sizes.values()))
    while True:  # sources above three times their size stop there, the rest is shared anew
        weights = {s: (5, 2, 1)[sources.index(s) % 3] for s in level}
        shares = {s: left * w / sum(weights.values()) for s, w in weights.items()}
        over = [s for s in level if shares[s] > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3.0 * sizes[s] for s in over}
        left, level = left - sum(3.0 * sizes[s] for s in over), [s for s in level if s not in over]
    for s, target in (full | shares).items() if level else full.items():
        if s in level or s in full:
            target = full.get(s, target)
            whole = int(target // sizes[s]) if sizes[s] else 0
            rest = target - whole * sizes[s]
            for r in sorted((r for r in keyed if r.source == s), key=lambda r: (r.e / r.m.weight, r.doc_id)):
                part = min(float(r.m.size), max(0.0, rest))
                want[r.doc_id] = whole * r.m.size + int(part + 1e-6)
                rest -= r.m.size
    got = {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()}
    assert got.keys() == want.keys()
    # Only the document on which a budget ends may differ by a word of rounding.
    assert all(abs(got[i] - want[i]) <= 1 for i in got) and sum(got[i] != want[i] for i in got) <= len(sources)


def test_ranges_of_keys_are_even_whatever_the_weights(spark):
    """Nine tenths of a source weigh the least there is."""
    rows = spark.range(40_000).select(
        F.lit(0).alias("number"), F.lit(40_000).alias("n_docs"), F.when(F.col("id") % 10 == 0, 1.05).otherwise(0.05 + (F.col("id") % 7) / 1000).alias("weight"),
        ((F.xxhash64("id") % 1_000_003 + 1_000_003.5) / 2_000_007).alias("u"),
    ).withColumn("key", -F.log("u") / F.col("weight"))
    spread = mixing.ranged(rows.join(mixing.weight_classes(rows, "number"), "number"), 400)
    sizes = spread.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("range").collect()
    assert sum(r.n for r in sizes) == 40_000 and len(sizes) >= 95 and max(r.n for r in sizes) < 800
    assert all(a.high <= b.low for a, b in zip(sizes, sizes[1:], strict=False))


def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return str(public_tokenizers.path("word_bpe_49k.json"))


def test_token_files(spark, odd_docs, odd_rows, no_docs):
    from tokenizers import Tokenizer

    path = token_files.scratch_path(spark, "tokens")
    token_files.write_token_files(odd_docs, vocabulary(), path, block_ids=500, range_bytes=100_000, frequent=2)
    docs = token_files.read_token_files(spark, path).join(token_files.block_starts(spark, path), ["part", "block"])
    rows = sorted(docs.collect(), key=lambda r: r.base + r.offset)
    encode = Tokenizer.from_file(vocabulary()).encode
    want = {r[0]: [*encode(r[1] or "", add_special_tokens=False).ids, 1] for r in odd_rows}
    start = 0
    for r in rows:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want[r.doc_id]
        assert r.base + r.offset == start and r.n_tokens == len(want[r.doc_id])
        start += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    for r in spark.read.parquet(path).collect():
        block = token_files.Block(bytes(r.payload))
        for i, doc_id in enumerate(r.doc_ids):
            assert block.document(i).tolist() == want[doc_id]
    empty = token_files.scratch_path(spark, "tokens")
    token_files.write_token_files(no_docs, vocabulary(), empty)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_pieces_are_learned_once_a_worker(odd_rows, tmp_path):
    """op9 went over its CPU budget: every task loaded the vocabulary and learned all pieces again."""
    import shutil

    from tokenizers import Tokenizer

    path = str(tmp_path / "vocabulary.json")
    shutil.copyfile(vocabulary(), path)
    rows = [(r[1] or "").encode() for r in odd_rows] + ["ÀÉ×÷ß it'S 12ab--é’s <|x".encode(), "Cafe\u0301 ﬁn 漢字".encode()]
    plain = Tokenizer.from_file(path).encode
    want = [plain(r.decode(), add_special_tokens=False).ids for r in rows]
    first = token_files.worker_encoder(path)
    assert [x.tolist() for x in first(rows)] == want
    known = len(first.hashes)
    again = token_files.worker_encoder(path)
    assert again is first and [x.tolist() for x in again(rows)] == want and len(again.hashes) == known
    # What a worker remembers is bounded; a vocabulary without the known way of writing words is asked in full.
    small = token_files.Encoder(path, most=50)
    for _ in range(2):
        for r, ids in zip(rows, want, strict=True):
            assert next(small([r])).tolist() == ids
    assert 0 < len(small.hashes) < known
    small.direct = False
    small._forget()
    assert [x.tolist() for x in small(rows)] == want
    shutil.copyfile(path, path + ".new")
    os.replace(path + ".new", path)
    os.utime(path, ns=(1, 1))
    assert token_files.worker_encoder(path) is not first


def test_grammar_round_trips_and_shrinks():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 40_000, 30)
    counts = rng.integers(0, 400, 200)
    ids = np.concatenate([np.tile(phrase, 20)[:n] if i % 2 else rng.integers(0, 9, n) for i, n in enumerate(counts)]).astype(np.uint32)
    payload = token_files.to_bytes(ids, counts, 49_408, frequent=4, rounds=6)
    back, sizes = token_files.Block(payload).documents()
    assert (back == ids).all() and (sizes == counts).all() and len(payload) < len(ids)
    wide = token_files.to_bytes(ids + np.uint32(1 << 20), counts, 1 << 21, frequent=4)
    assert (token_files.Block(wide).documents()[0] == ids + (1 << 20)).all()
    # A long repeat ends as a few symbols, whatever its length.
    long = np.tile(rng.permutation(500).astype(np.uint32), 2000)
    few = token_files.to_bytes(long, np.array([len(long)]), 49_408)
    assert (token_files.Block(few).documents()[0] == long).all() and len(few) < len(long) / 30
    nothing = token_files.Block(token_files.to_bytes(np.zeros(0, dtype=np.uint32), np.zeros(2, dtype=np.int64), 10))
    assert nothing.documents()[1].tolist() == [0, 0]


def test_best_bounds_beat_all_others():
    rng = np.random.default_rng(1)
    for _ in range(20):
        histogram = {int(x): int(rng.integers(1, 20)) for x in rng.choice(np.arange(1, 40), 9, replace=False)}
        for k in (1, 2, 3, 5, 12):
            def padding(bounds, histogram=histogram):
                return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())

            top = max(histogram)
            ways = [padding([*c, top]) for c in itertools.combinations(sorted(histogram)[:-1], min(k, 9) - 1)]
            assert padding(packing.best_bounds(histogram, k)) == min(ways)
            assert len(packing.best_bounds(histogram, k)) <= k
    assert packing.best_bounds({}, 4) == []


def test_packing(odd_docs, odd_rows, no_docs):
    rows = packing.pack(odd_docs, longest=512, buckets=3, budget=1024).collect()
    n_words = collections.Counter()
    for r in odd_rows:
        n_words[r[0]] += len(WORD.findall(r[1] or ""))
    for doc_id, n in n_words.items():
        own = [r for r in rows if r.doc_id == doc_id]
        assert own and sum(r.length for r in own) == n
        assert all(r.start == r.piece * 512 and r.length <= 512 for r in own)
    full = [r for r in rows if r.length]
    assert all(r.bucket is None and r.batch is None for r in rows if not r.length)
    assert all(r.length <= r.bucket for r in full) and len({r.bucket for r in full}) <= 3
    for bucket, own in itertools.groupby(sorted(full, key=lambda r: r.bucket), key=lambda r: r.bucket):
        sizes = collections.Counter(r.batch for r in own)
        cap = max(1, 1024 // bucket)
        assert sorted(sizes) == list(range(len(sizes))) and all(sizes[b] == cap for b in range(len(sizes) - 1))
    assert packing.pack(no_docs).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    clean = stages["personal_data"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where(F.col("text").contains("@mail")).count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r.row, r.piece) for r in rows}) == len(rows)
    assert all(len(WORD.findall(r.text)) == r.length for r in rows)


def test_packed_text(spark, odd_docs, odd_rows):
    """Every row's pieces, put together, are its words; repeated rows are packed each."""
    both = odd_docs.union(odd_docs)
    pieces = collections.defaultdict(list)
    for r in packing.pack(both, longest=500, buckets=4, budget=2000, with_text=True).collect():
        pieces[r.row, r.doc_id].append((r.piece, r.start, r.length, r.text))
    want = [(i, " ".join(WORD.findall(text or ""))) for i, text, _ in odd_rows] * 2
    got = []
    for (_, i), own in pieces.items():
        own.sort()
        assert [s for _, s, _, _ in own] == [500 * k for k in range(len(own))]
        got.append((i, " ".join(t for _, _, _, t in own)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(n for n in LLM_QUERIES if not n.startswith(("op11", "op12"))))
def test_queries_return_one_row_per_row(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = LLM_QUERIES[name](spark, SF)
    key = "page_id" if name.startswith("op3") else "doc_id"
    assert got.select(key).distinct().count() == n and got.count() >= n
    if name.startswith("op9"):
        rows = got.orderBy("start").collect()
        assert all(a.start + a.n_tokens == b.start and a.doc_id < b.doc_id for a, b in itertools.pairwise(rows))
        assert all(0 <= r.ids_crc32 < 1 << 32 for r in rows) and zlib.crc32(b"") == 0
