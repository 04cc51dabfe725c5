"""Lockout and activity: fixtures, brute force, long attacks, stream = batch."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pairforge.streaming.activity import activity_sessions, activity_stream
from pairforge.streaming.lockout import client_key, lockout_batch, lockout_stream, login_lockout, next_states

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(attempts, limit=5, ttl=300):
    """Per key: a counter and a block, each with its own expiry."""
    state, out = {}, []
    for key, at, good, i in sorted(attempts, key=lambda a: (a[1], a[3])):
        count, count_end, block_end = state.get(key, (0, 0, 0))
        if at < block_end:
            out.append((i, 429, None))
            continue
        if good:
            state.pop(key, None)
            out.append((i, 200, None))
            continue
        count = count + 1 if at < count_end else 1
        blocked = count >= limit
        state[key] = (count, at + ttl, at + ttl if blocked else 0)
        out.append((i, 429, None) if blocked else (i, 401, limit - count))
    return sorted(out)


def run(spark, attempts, **options):
    rows = [(k, START + timedelta(seconds=at), good, i) for k, at, good, i in attempts]
    df = spark.createDataFrame(rows, "key string, ts timestamp, ok boolean, i int").repartition(3)
    got = login_lockout(df, row_id="i", **options).select("i", "status", "attempts_left").collect()
    return sorted(map(tuple, got))


FIXTURES = [
    ([(0, False), (60, False), (120, False), (180, False), (240, False), (300, True), (540, True)],
     [(401, 4), (401, 3), (401, 2), (401, 1), (429, None), (429, None), (200, None)]),
    ([(0, False), (301, False)], [(401, 4), (401, 4)]),
    ([(0, False), (300, False)], [(401, 4), (401, 4)]),
    ([(0, False), (290, False), (580, False)], [(401, 4), (401, 3), (401, 2)]),
    ([(0, False), (10, True), (20, False)], [(401, 4), (200, None), (401, 4)]),
]


def test_fixtures(spark):
    attempts, want = [], []
    for k, (events, results) in enumerate(FIXTURES):
        for (at, good), result in zip(events, results):
            want.append((len(attempts), *result))
            attempts.append((f"k{k}", float(at), good, len(attempts)))
    assert run(spark, attempts) == want


def attack(seed, n, mean_gap, p_good, keys=("a", "b")):
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0.0, rng.expovariate(1 / mean_gap)])
        out.append((rng.choice(keys), round(at, 3), rng.random() < p_good, i))
    return out


@pytest.mark.parametrize("seed, gap, good", [(1, 40, 0.1), (2, 90, 0.3), (3, 8, 0.02), (4, 30, 0.0), (5, 250, 0.2), (6, 400, 0.0)])
def test_pieces_follow_one_timeline(spark, seed, gap, good):
    """Pieces of two lockout periods: nearly every segment is cut, nothing may change."""
    attempts = attack(seed, 700, gap, good)
    want = brute(attempts)
    assert run(spark, attempts, piece_buckets=2) == want
    assert run(spark, attempts, piece_buckets=3) == want
    assert run(spark, attempts) == want


def test_a_key_stays_in_one_partition_beside_a_broadcast(spark):
    """Many keys under attack: their start states meet them in a join that becomes a broadcast while
    the query runs; the partitions of the join must not be taken for those of the keys."""
    attempts = attack(7, 2000, 3, 0.1, keys=tuple("abcdefghijklmnop"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, attempts, piece_buckets=2) == brute(attempts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_without_key_or_time_stay(spark):
    attempts = [(None, float(10 * i), False, i) for i in range(6)] + [("a", 5.0, False, 6)]
    rows = [(k, START + timedelta(seconds=at), good, i) for k, at, good, i in attempts] + [("a", None, False, 7), (None, None, True, 8)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, ok boolean, i int")
    got = {r["i"]: (r["status"], r["attempts_left"]) for r in login_lockout(df, row_id="i").collect()}
    assert got == {0: (401, 4), 1: (401, 3), 2: (401, 2), 3: (401, 1), 4: (429, None), 5: (429, None), 6: (401, 4), 7: (None, None), 8: (None, None)}


def test_client_key(spark):
    df = spark.createDataFrame(
        [(" Bob ", "1.1.1.1, 2.2.2.2", "9.9.9.9"), ("bob", None, "1.1.1.1"), (None, "", None)], "u string, f string, r string"
    )
    got = [r[0] for r in df.select(client_key("u", "f", "r")).collect()]
    assert got == ["bob:1.1.1.1", "bob:1.1.1.1", ":0"]


def test_lockout_stream_equals_batch(spark, tmp_path):
    attempts = attack(9, 300, 40, 0.1)
    rows = [(k, START + timedelta(seconds=at + i / 1000), good, i) for k, at, good, i in attempts]
    df = spark.createDataFrame(rows, "key string, ts timestamp, ok boolean, i int")
    folder = str(tmp_path / "in")
    for part in range(3):
        df.filter(f"i >= {part * 100} and i < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    lockout_stream(source, str(tmp_path / "o"), str(tmp_path / "c"), row_id="i", piece_buckets=2).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "o" / "attempts")).select("key", "ts", "status", "attempts_left").collect()
    batch = login_lockout(df, row_id="i").select("key", "ts", "status", "attempts_left").collect()
    assert sorted(map(tuple, streamed), key=str) == sorted(map(tuple, batch), key=str)


@pytest.mark.parametrize("seed, gap, good, limit", [(21, 40, 0.1, 5), (22, 9, 0.02, 5), (23, 200, 0.2, 5), (24, 60, 0.1, 1)])
def test_states_between_batches(spark, seed, gap, good, limit):
    """One key holds nine tenths; a key without name, one that is silent for a while and an
    attempt without time. Cut anywhere, batches give what one run gives."""
    rows = [(k, START + timedelta(seconds=at + i / 1000), ok, i) for k, at, ok, i in attack(seed, 300, gap, good, ["a"] * 18 + ["b", None])]
    df = spark.createDataFrame([*rows, ("a", None, False, 300)], "key string, ts timestamp, ok boolean, i int")
    want = {r.i: (r.status, r.attempts_left) for r in login_lockout(df, row_id="i", max_failures=limit).collect()}
    before = spark.createDataFrame([], "who string, failures long, counter_until long, blocked_until long")
    got, cuts = {}, [0, 7, 150, 150, 301]
    for low, high in zip(cuts, cuts[1:]):
        done = lockout_batch(df.filter(f"i >= {low} and i < {high}"), before, row_id="i", max_failures=limit, piece_buckets=2)
        found = done.collect()
        got |= {r.i: (r.status, r.attempts_left) for r in found}
        assert len(found) == min(high, 301) - low
        done = spark.createDataFrame(found, done.schema)
        states = next_states(before, done, "key", -(2**63)).collect()
        before = spark.createDataFrame(states, before.schema)
    assert got == want
    assert next_states(before, done, "key", 2**62).collect() == []


def activity_brute(events, idle):
    out = []
    for key in {k for k, _ in events}:
        times = sorted(at for k, at in events if k == key)
        first = last = times[0]
        n = 0
        for at in times:
            if at - last > idle:
                out.append((key, first, last + idle, n))
                first, n = at, 0
            last, n = at, n + 1
        out.append((key, first, last + idle, n))
    return sorted(out)


def test_activity_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    events = [("a", 0.0), ("a", 1800.0), ("a", 3601.0)]
    events += [(rng.choice("bc"), round(rng.uniform(0, 200_000), 2)) for _ in range(200)]
    rows = [(k, START + timedelta(seconds=at)) for k, at in events]
    df = spark.createDataFrame(rows, "k string, ts timestamp")

    def plain(frame):
        seconds = [F.round(F.unix_micros(c) / 1e6 - START.timestamp(), 2) for c in ("session_start", "session_end")]
        return sorted(map(tuple, frame.select("k", *seconds, "n_events").collect()))

    want = activity_brute(events, 1800)
    got = plain(activity_sessions(df, "k"))
    assert [(k, pytest.approx(s), pytest.approx(e), n) for k, s, e, n in want] == got
    # An event far in the future lets the watermark pass every other session.
    end = spark.createDataFrame([("z", START + timedelta(days=30))], df.schema)
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    end.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).parquet(folder)
    query = (
        activity_stream(source, "k").writeStream.format("memory").queryName("active").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert plain(spark.table("active")) == got
