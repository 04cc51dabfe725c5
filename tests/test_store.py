"""Store operators under a hot session, uniqueness, splits."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pairforge.functions.maps import merge_meta
from pairforge.functions.rules import first_reason
from pairforge.operators.ranking import even_ranges, int_bucket, with_position
from pairforge.operators.store import (
    FEW_IDS,
    apply_changes,
    cascade_delete,
    sessions_with_items,
    unique_ci,
    within_quota,
)
from pairforge.operators.training import train_eval_split
from pairforge.sources.store import store_rules, with_defaults

T0 = datetime(2024, 1, 1)


def hot_items(spark, n=600):
    """One session holds most rows."""
    rng = random.Random(4)
    rows = [(i, 1 if rng.random() < 0.8 else rng.randint(2, 9), T0 + timedelta(minutes=rng.randint(0, 3000)), f"t{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, session_id long, created_at timestamp, generated_tests string").repartition(4)


def test_position_equals_row_number(spark):
    rows, df = hot_items(spark)
    got = with_position(df, ["session_id"], [F.col("id").asc()], int_bucket(F.col("id"), 16)).collect()
    for session in {r[1] for r in rows}:
        ids = sorted(r[0] for r in rows if r[1] == session)
        assert {r["id"]: r["position"] for r in got if r["session_id"] == session} == {i: p for p, i in enumerate(ids)}


def test_even_ranges_under_a_hot_hour(spark):
    """Nine tenths of the rows in one hour, half of those at one time: no range is above twice
    its share, ranges follow the order, positions are exact."""
    rng = random.Random(11)
    rows = []
    for i in range(8000):
        hot = rng.random() < 0.9
        at = T0 + timedelta(microseconds=rng.choice([0, rng.randint(0, 3_599_000_000)])) if hot else T0 + timedelta(hours=rng.randint(1, 500))
        rows.append((i, 1 if hot else rng.randint(2, 9), at, i % 7))
    df = spark.createDataFrame(rows, "id long, session_id long, created_at timestamp, _bucket int").repartition(4)
    order = [F.col("created_at").desc(), F.col("id").desc()]
    ranges = even_ranges(df.drop("_bucket"), ["session_id"], order, parts=16).collect()
    sizes = Counter(r["_bucket"] for r in ranges)
    assert len(sizes) == 16 and max(sizes.values()) <= 2 * len(rows) / 16
    placed = sorted(ranges, key=lambda r: (r["session_id"], -r["created_at"].timestamp(), -r["id"]))
    assert [r["_bucket"] for r in placed] == sorted(r["_bucket"] for r in ranges)
    got = {r["id"]: (r["position"], r["_bucket"]) for r in with_position(df, ["session_id"], order).collect()}
    seen = Counter()
    for session, _, i in sorted((r[1], -r[2].timestamp(), -r[0]) for r in rows):
        assert got[-i] == (seen[session], -i % 7)  # a column named like the range stays
        seen[session] += 1
    assert with_position(df.limit(0), ["session_id"], order).collect() == []


def test_sessions_with_items_pages(spark):
    rows, df = hot_items(spark)
    sessions = spark.range(1, 12).withColumn("title", F.lit("s"))
    pages = sessions_with_items(sessions, df, page_size=100).collect()
    for session in range(1, 12):
        mine = sorted((p for p in pages if p["id"] == session), key=lambda p: p["page"])
        got = [i["id"] for p in mine for i in p["items"]]
        want = [r[0] for r in sorted((r for r in rows if r[1] == session), key=lambda r: (r[2], r[0]), reverse=True)]
        assert got == want and all(len(p["items"]) <= 100 for p in mine)
        assert [p["page"] for p in mine] == list(range(max(1, math.ceil(len(want) / 100))))


def test_many_deleted_ids_are_held_in_shares(spark):
    """a task held all ids (taken for few by the size of their file), or sorted the rows it compared."""
    many = FEW_IDS + 50_000
    sessions = spark.range(2 * many)
    sessions = sessions.union(sessions.limit(1).select(F.lit(None).cast("long")))
    items = spark.range(3 * many).select("id", (F.col("id") % (many + 1000)).alias("session_id"))
    items = items.union(spark.range(500).selectExpr("id", "CAST(NULL AS BIGINT)"))
    ids = spark.range(many).union(spark.range(20_000).selectExpr("CAST(7 AS BIGINT)")).union(spark.range(3).selectExpr("CAST(NULL AS BIGINT)"))
    for gone, join in ((ids, "ShuffledHashJoin"), (ids.where("id < 5 OR id IS NULL"), "BroadcastHashJoin")):
        n = many if join == "ShuffledHashJoin" else 5
        left, kept = cascade_delete(sessions, items, gone)
        assert left.agg(F.count("*"), F.min("id")).first() == (2 * many + 1 - n, n)
        want = items.where(f"session_id IS NULL OR session_id >= {n}").agg(F.count("*"), F.sum("id")).first()
        assert kept.agg(F.count("*"), F.sum("id")).first() == want
        for df in (left, kept):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "SortMergeJoin" not in plan


def test_quota_per_session(spark):
    rows, df = hot_items(spark)
    got = {r["id"] for r in within_quota(df.withColumn("item_limit", F.col("session_id") * 20), F.col("item_limit")).collect()}
    want = set()
    for session in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == session), key=lambda r: (r[2], r[0]))
        want |= {r[0] for r in ordered[: session * 20]}
    assert got == want
    assert {r["id"] for r in within_quota(df, 5).collect()} <= {r["id"] for r in df.collect()}


def test_unique_on_two_columns(spark):
    rng = random.Random(8)
    new = [(i, rng.choice(["Ann", "BOB ", "cy", "Dee", "eve"]) + rng.choice(["", "1", "2"]), f"{rng.choice('abcdefghij')}@x.org") for i in range(80)]
    existing = [("ann", "z@x.org"), ("q", "A@X.org")]
    users, mails = {"ann", "q"}, {"z@x.org", "a@x.org"}
    want = []
    for i, user, mail in new:
        u, m = user.strip().lower(), mail.strip().lower()
        if u not in users and m not in mails:
            users.add(u)
            mails.add(m)
            want.append(i)
    got = unique_ci(
        spark.createDataFrame(new, "i int, username string, email string").repartition(3),
        spark.createDataFrame(existing, "username string, email string"), ["username", "email"], "i",
    )
    assert sorted(r["i"] for r in got.collect()) == want


def test_apply_changes_and_meta(spark):
    items = spark.createDataFrame([(1, "a", {"x": "1"}), (2, "b", None)], "id int, generated_tests string, meta map<string,string>")
    changes = spark.createDataFrame(
        [(1, 1, "old", {"x": "2"}), (1, 2, "new", {"y": "3"}), (9, 1, "ghost", {})], "id int, changed_at int, generated_tests string, meta map<string,string>"
    )
    got = {r["id"]: (r["generated_tests"], r["meta"]) for r in apply_changes(items, changes, changed_at=["changed_at"]).collect()}
    assert got == {1: ("new", {"x": "1", "y": "3"}), 2: ("b", None)}
    merged = items.select("id", merge_meta("meta", F.create_map(F.lit("x"), F.lit("9"))).alias("m")).collect()
    assert {r["id"]: r["m"] for r in merged} == {1: {"x": "9"}, 2: {"x": "9"}}


def test_defaults_and_rules(spark):
    old = spark.createDataFrame([(1, "x" * 121), (2, None)], "id int, title string")
    full = with_defaults(old, "sessions")
    got = {r["id"]: (r["item_limit"], r["r"]) for r in full.withColumn("r", first_reason(store_rules("sessions"))).collect()}
    assert got == {1: (50, "title_too_long"), 2: (50, None)}
    assert full.filter("id = 2").first()["title"] == "New Session"


def test_split_is_stable_and_exact(spark):
    df = spark.range(1237).withColumn("key", F.concat(F.lit("k"), "id"))
    a = {r["key"]: r["split"] for r in train_eval_split(df.repartition(1), "key").collect()}
    b = {r["key"]: r["split"] for r in train_eval_split(df.repartition(6), "key").collect()}
    assert a == b
    half = {r["key"]: r["split"] for r in train_eval_split(df.limit(600), "key").collect()}
    assert all(a[k] == v for k, v in half.items())
    exact = train_eval_split(df, "key", exact=True)
    assert exact.filter("split = 'eval'").count() == math.ceil(1237 * 0.1)
    assert train_eval_split(df, "key", seed=7, exact=True).exceptAll(exact).count() > 0
