"""Login lockout: too many failures of one user from one address block it for a while.

The rule is sequential: an attempt during a block changes nothing, so windows alone
cannot express it. What can be cut is *where* the sequence must be followed: a pause of
one lockout period between failures ends every counter and every block. Each key is
cut there. Where no pause comes, a piece of the timeline is followed from every state it
can be entered in, so that the pieces of one key run in parallel as well."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairforge.functions.text import as_col, strip
from pairforge.session import grouped

# Failures until the block, seconds a counter or block lives.
ATTEMPTS, LOCKOUT_SECONDS = 5, 300
OK, WRONG, BLOCKED = 200, 401, 429
# Lockout periods followed by one task at most (a day at five minutes).
PIECE_BUCKETS = 288

State = tuple[int, int, int]  # failures, counter expiry, block expiry (microseconds)
CLEAR: State = (0, 0, 0)


def client_key(username: Column | str, forwarded_for: Column | str, remote_addr: Column | str) -> Column:
    """User (trimmed, lower case) and address: first forwarded entry, else the peer."""
    fwd = as_col(forwarded_for)
    address = F.when(F.coalesce(fwd != "", F.lit(False)), strip(F.split_part(fwd, F.lit(","), F.lit(1)))).otherwise(
        F.coalesce(as_col(remote_addr), F.lit("0"))
    )
    return F.concat(F.lower(strip(F.coalesce(as_col(username), F.lit("")))), F.lit(":"), address)


def step(state: State, ts: int, ok: bool, attempts: int, ttl: int) -> tuple[State, int, int | None]:
    """One attempt: (new state, status, attempts left)."""
    failures, counter_until, blocked_until = state
    if ts < blocked_until:
        return state, BLOCKED, None
    if ok:
        return CLEAR, OK, None
    failures = failures + 1 if ts < counter_until else 1
    if failures >= attempts:
        return (failures, ts + ttl, ts + ttl), BLOCKED, None
    return (failures, ts + ttl, 0), WRONG, attempts - failures


def bucket_table(staged: DataFrame, key: str, ok: str, ttl: Column) -> DataFrame:
    """Per (key, time bucket): first failure and the number of the segment the bucket is in."""
    failed_at = F.when(~F.col(ok), F.col("_us"))
    extremes = staged.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(
        F.min(failed_at).alias("_first"), F.max(failed_at).alias("_last")
    )
    by_time = Window.partitionBy("_key").orderBy("_b")
    previous = F.max("_last").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("_first") - previous >= ttl, 1).otherwise(0)
    return extremes.withColumn("_starts", starts).withColumn("_segment", F.sum("_starts").over(by_time))


def with_pieces(
    attempts: DataFrame, key: str, ts: str, ok: str, lockout_seconds: int, piece_buckets: int
) -> tuple[DataFrame, DataFrame]:
    """Attempts with ``segment`` (counts pauses of at least one lockout period between
    failures) and ``piece`` (a stretch of ``piece_buckets`` periods), and the segments that
    reach over several pieces.

    Skew-safe: failures are first reduced to (key, time bucket) extremes. A bucket is one
    lockout period wide, so a pause can only lie between buckets and the ordered window
    sees a few numbers per bucket, however many attempts a key has."""
    ttl = F.lit(lockout_seconds * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    staged = attempts.withColumn("_us", us).withColumn("_bucket", F.floor(us / ttl))
    buckets = bucket_table(staged, key, ok, ttl)
    piece = F.floor(F.col("_b") / piece_buckets)
    # Rows ahead of the failure that starts a segment still belong to the one before.
    before_start = F.coalesce((F.col("_starts") == 1) & (F.col("_us") < F.col("_first")), F.lit(False))
    cut = (
        staged.join(buckets, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("segment", F.col("_segment") - before_start.cast("int"))
        .withColumn("piece", piece)
        .select(*attempts.columns, "_us", "segment", "piece")
    )
    long = (
        buckets.select(
            "_key", piece.alias("_p"),
            F.explode(F.array_distinct(F.array("_segment", F.col("_segment") - F.col("_starts")))).alias("_s"),
        )
        .groupBy("_key", "_s").agg(F.min("_p").alias("_from"), F.max("_p").alias("_to"))
        .filter(F.col("_from") < F.col("_to"))
        .select(F.col("_key").alias(key), F.col("_s").alias("segment"))
    )
    return cut, long


def all_ways_through(events: Iterator[tuple[int, bool]], window_end: int, attempts: int, ttl: int):
    """Follow one piece from every state it can be entered in, in one pass.

    Ways in: clear from any event of the first lockout period (a block from before ends
    there), or with 1..n-1 live failures at the first event. Ways that reach the same state
    are one from then on, and not blocked ones differ by their count only, so an event
    touches at most ``attempts`` groups. Yields (live failures, event time, state after)."""
    parent: list[int] = []
    entries: list[tuple[int, int, int]] = []
    free: list[int | None] = [None] * attempts  # group per failure count
    blocked: deque[tuple[int, int]] = deque()  # (end of block, group), ends ascending
    counter_until, last_entry, closed = 0, None, False

    def enter(live: int, at: int) -> None:
        parent.append(len(parent))
        entries.append((live, at, len(parent) - 1))
        join(live, len(parent) - 1)

    def join(count: int, group: int) -> None:
        if free[count] is None:
            free[count] = group
        else:
            parent[group] = free[count]

    def merge_free() -> None:
        for count in range(1, attempts):
            if free[count] is not None:
                join(0, free[count])
                free[count] = None

    for at, good in events:
        while blocked and blocked[0][0] <= at:
            join(0, blocked.popleft()[1])
        if last_entry is None:
            counter_until = at + 1  # the live failures of an entry are alive here
            for live in range(1, attempts):
                enter(live, at)
        if not closed and at != last_entry:
            enter(0, at)
            last_entry, closed = at, at >= window_end
        if good or at >= counter_until:
            merge_free()
        if not good:
            if free[-1] is not None:
                blocked.append((at + ttl, free[-1]))
            free[1:] = free[:-1]
            free[0] = None
            counter_until = at + ttl
    final = {g: (c, counter_until, 0) if c else CLEAR for c, g in enumerate(free) if g is not None}
    final.update({g: (attempts, end, end) for end, g in blocked})
    for live, at, node in entries:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        yield live, at, final[node]


STATE_FIELDS = [T.StructField(n, T.LongType()) for n in ("failures", "counter_until", "blocked_until")]


def start_states(long_events: DataFrame, key: str, ok: str, order: list[str], max_failures: int, ttl: int,
                 piece_us: int) -> DataFrame:
    """(key, segment, piece, state at its start) of long segments.

    Pieces are followed in parallel from all states they can be entered in; the resulting
    small tables (entry, exit) are then chained per segment. Both run as sorted streams."""
    where = [long_events.schema[key], T.StructField("segment", T.LongType()), T.StructField("piece", T.LongType())]
    ways_schema = T.StructType([
        *where, T.StructField("first_us", T.LongType()), T.StructField("live", T.IntegerType()),
        T.StructField("entry_us", T.LongType()), *STATE_FIELDS,
    ])
    starts_schema = T.StructType([*where, *STATE_FIELDS])

    def rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
        for pdf in batches:
            yield from zip(*(pdf[c].tolist() for c in columns))

    def frames(found: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
        while part := list(islice(found, 10_000)):
            yield pd.DataFrame(part, columns=columns)

    def ways(stream: Iterator[tuple]) -> Iterator[tuple]:
        for place, events in groupby(stream, key=lambda r: r[:3]):
            followed = list(all_ways_through(
                ((r[3], r[4]) for r in events), place[2] * piece_us + ttl, max_failures, ttl
            ))
            first = followed[0][1]
            # Of neighbouring clear entries with one exit the last stands for all.
            for way, after in zip(followed, followed[1:] + [None]):
                if way[0] or after is None or (after[0], after[2]) != (0, way[2]):
                    yield (*place, first, way[0], way[1], *way[2])

    def chain(stream: Iterator[tuple]) -> Iterator[tuple]:
        current, state = None, CLEAR
        for place, table in groupby(stream, key=lambda r: r[:3]):
            if place[:2] != current:
                current, state = place[:2], CLEAR
            yield (*place, *state)
            failures, counter_until, blocked_until = state
            table = list(table)
            first = table[0][3]
            if blocked_until <= first and 0 < failures and first < counter_until:
                match = (r for r in table if r[4] == failures)
            else:
                match = (r for r in table if r[4] == 0 and r[5] >= blocked_until)
            # Without a way in, the whole piece lies inside the block.
            state = next((r[6:9] for r in match), state)

    def follow_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames(ways(rows(batches, [key, "segment", "piece", "_us", ok])), ways_schema.names)

    def chain_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames(chain(rows(batches, ways_schema.names)), starts_schema.names)

    passed = (
        grouped(long_events, [key, "segment", "piece"], order)
        .mapInPandas(follow_pieces, ways_schema)
    )
    return (
        grouped(passed, [key, "segment"], ["piece", "live", "entry_us"])
        .mapInPandas(chain_pieces, starts_schema)
    )


def login_lockout(
    attempts: DataFrame,
    key: str = "key",
    ts: str = "ts",
    ok: str = "ok",
    row_id: str | list[str] | None = None,
    max_failures: int = ATTEMPTS,
    lockout_seconds: int = LOCKOUT_SECONDS,
    piece_buckets: int = PIECE_BUCKETS,
    states: bool = False,
) -> DataFrame:
    """Add ``status`` (200 / 401 / 429) and ``attempts_left`` to every attempt.

    Attempts are followed in time order (``row_id``, one or more columns, breaks ties) as sorted streams with one
    small state, so no group is held in memory. A stretch without a pause that reaches over
    several pieces of ``piece_buckets`` lockout periods (a key under attack) is followed piece
    by piece, from start states found by :func:`start_states`; all others start clear.

    Attempts without a key are one key. Attempts without a time cannot be placed: they keep
    their row, with NULL status and attempts left, and count for nobody. ``states`` adds the
    state of the key after each attempt (``failures``, ``counter_until``, ``blocked_until``) and
    the attempt's place among those of its key (``segment``, ``piece``, ``seq``)."""
    ttl = lockout_seconds * 1_000_000
    columns = attempts.columns
    added = [T.StructField("status", T.IntegerType()), T.StructField("attempts_left", T.IntegerType())]
    if states:
        added += [*STATE_FIELDS, *(T.StructField(n, T.LongType()) for n in ("segment", "piece", "seq"))]
    untimed = attempts.filter(F.col(ts).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    # Keys as text that is never NULL, so that joins lose no row.
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    attempts, key = attempts.filter(F.col(ts).isNotNull()).withColumn("_who", name), "_who"
    place = [key, "segment", "piece"]
    order = ["_us"] + ([row_id] if isinstance(row_id, str) else row_id or [])
    out = T.StructType([f for f in attempts.schema.fields if f.name in columns] + added)
    cut, long = with_pieces(attempts, key, ts, ok, lockout_seconds, piece_buckets)
    marked = cut.join(long.withColumn("_long", F.lit(True)), [key, "segment"], "left")
    starts = start_states(marked.filter("_long"), key, ok, order, max_failures, ttl, piece_buckets * ttl)
    staged = (
        marked.withColumn("piece", F.when(F.col("_long"), F.col("piece")).otherwise(0))
        .join(starts, place, "left").fillna(0, [f.name for f in STATE_FIELDS])
    )

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, seq = None, CLEAR, 0
        for pdf in batches:
            status, left, after = [], [], []
            inputs = [pdf[c].tolist() for c in (*place, "_us", ok, *(f.name for f in STATE_FIELDS))]
            for k, segment, piece, at, good, *start in zip(*inputs):
                if (k, segment, piece) != current:
                    current, state, seq = (k, segment, piece), tuple(start), 0
                state, code, remaining = step(state, at, good, max_failures, ttl)
                status.append(code)
                left.append(remaining)
                if states:
                    seq += 1
                    after.append((*state, segment, piece, seq))
            done = pdf[columns].assign(status=status, attempts_left=pd.array(left, dtype="Int32"))
            if states:
                done[[f.name for f in added[2:]]] = pd.DataFrame(after, index=done.index, dtype="int64")
            yield done

    followed = grouped(staged, place, order).mapInPandas(follow, out)
    return followed.unionByName(untimed)


def next_states(before: DataFrame, followed: DataFrame, key: str, since_us: int) -> DataFrame:
    """State per key (``who``) after a batch: of its last attempt, or the one from before where it made
    none. Clear states and those that ran out by ``since_us`` go."""
    names = [f.name for f in STATE_FIELDS]
    place = [F.col(c) for c in ("segment", "piece", "seq")]
    last = followed.filter(F.col("seq").isNotNull()).groupBy(F.col(key).cast("string").alias("who")).agg(
        F.max_by(F.struct(*names), F.struct(*place)).alias("_state")
    ).select("who", *[F.col(f"_state.{n}").alias(n) for n in names])
    kept = before.join(last.select(F.col("who").alias("_who")), F.col("who").eqNullSafe(F.col("_who")), "left_anti")
    return kept.unionByName(last).filter((F.col("failures") > 0) & (F.greatest("counter_until", "blocked_until") > since_us))


def lockout_batch(
    attempts: DataFrame, before: DataFrame, key: str = "key", ts: str = "ts", ok: str = "ok", row_id: str | None = None,
    max_failures: int = ATTEMPTS, lockout_seconds: int = LOCKOUT_SECONDS, piece_buckets: int = PIECE_BUCKETS,
) -> DataFrame:
    """:func:`login_lockout` with ``states`` for attempts that meet the states ``before`` (``who``
    and the state's three numbers).

    A state is what its failures were: they are put ahead of the attempts again, at the time of
    the last one, and leave after. So a key of any size goes through the sorted pieces of the
    batch operator. Attempts older than their key's last failure count as made at that time."""
    ttl = lockout_seconds * 1_000_000
    columns = attempts.columns
    live = before.select("who", F.col("failures").cast("int").alias("_n"), (F.col("counter_until") - ttl).alias("_since"))
    timed = attempts.join(live, F.col(key).cast("string").eqNullSafe(F.col("who")), "left")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    at = F.when(F.col(ts).isNotNull(), F.timestamp_micros(F.greatest(us, F.col("_since"))))
    timed = timed.withColumns({"_at": at, "_phase": F.lit(1)}).select(*columns, "_at", "_phase")
    again = live.select("who", "_since", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_phase"))
    values = {key: F.col("who").cast(attempts.schema[key].dataType), ok: F.lit(False), "_at": F.timestamp_micros("_since"), "_phase": F.col("_phase")}
    replayed = again.select(*[
        values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in timed.schema.fields
    ])
    order = ["_phase", ts] + ([row_id] if row_id else [])
    followed = login_lockout(
        replayed.unionByName(timed), key, "_at", ok, order, max_failures, lockout_seconds, piece_buckets, states=True
    )
    return followed.filter("_phase = 1").drop("_at", "_phase")


def lockout_stream(
    attempts: DataFrame, out: str, checkpoint: str, key: str = "key", ts: str = "ts", ok: str = "ok",
    row_id: str | None = None, max_failures: int = ATTEMPTS, lockout_seconds: int = LOCKOUT_SECONDS,
    watermark_seconds: int = 60, piece_buckets: int = PIECE_BUCKETS,
) -> StreamingQuery:
    """The same rule on a stream of attempts: judge what is there and stop (``availableNow``); run
    again for more. Writes ``<out>/attempts/batch=<n>`` (attempts with status and the key's state
    after them) and ``<out>/states/batch=<n>``, the states of all live keys that the next
    micro-batch starts from.

    Attempts of a micro-batch are taken in time order, micro-batches in order of arrival. A
    retried batch starts from the same states and overwrites its own folders. States go
    ``watermark_seconds`` after counter and block have run out; no attempt is dropped."""
    held = T.StructType([T.StructField("who", T.StringType()), *STATE_FIELDS])

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], held)
        if batch_id > 0:
            before = spark.read.schema(held).parquet(f"{out}/states/batch={batch_id - 1}")
        followed = lockout_batch(batch, before, key, ts, ok, row_id, max_failures, lockout_seconds, piece_buckets)
        path = f"{out}/attempts/batch={batch_id}"
        followed.write.mode("overwrite").parquet(path)
        done = spark.read.schema(followed.schema).parquet(path)
        newest = done.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
        since = -(2**63) if newest is None else newest - watermark_seconds * 1_000_000
        next_states(before, done, key, since).write.mode("overwrite").parquet(f"{out}/states/batch={batch_id}")

    return (
        attempts.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
