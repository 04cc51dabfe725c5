"""Session and item tables: list, latest, quota, search, delete, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.maps import merge_meta
from pairforge.functions.text import strip
from pairforge.operators.ranking import with_position
from pairforge.session import cut_lineage

PAGE_SIZE = 1000
#: Ids that every task can hold, and ids of a share that one task holds of more.
FEW_IDS, SHARE_IDS = 100_000, 500_000


def newest(item_time: str = "created_at", item_id: str = "id") -> list[Column]:
    return [F.col(item_time).desc(), F.col(item_id).desc()]


# --- joins ------------------------------------------------------------------------


def sessions_with_items(
    sessions: DataFrame,
    items: DataFrame,
    session_id: str = "id",
    item_session: str = "session_id",
    item_time: str = "created_at",
    item_id: str = "id",
    bucket: Column | None = None,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Sessions with their items embedded as an array, newest first; a session
    without items keeps an empty array.

    An array cell must fit into memory, so items come in pages of ``page_size``:
    page 0 alone for any session within its usual limit, further rows for larger
    ones. Nothing is dropped, and no task holds more than one page of a session. Without
    ``bucket`` positions come from ranges of alike many rows, so a busy hour is no hot task."""
    placed = with_position(items, [item_session], newest(item_time, item_id), bucket, "_position", descending=True)
    fields = [c for c in items.columns if c != item_session]
    pages = (
        placed.withColumn("page", F.floor(F.col("_position") / page_size))
        .groupBy(F.col(item_session).alias("_session"), "page")
        .agg(F.array_sort(F.collect_list(F.struct("_position", *fields))).alias("items"))
        .withColumn("items", F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in fields])))
    )
    # The pages of one session can be split over tasks in an inner join, not as the right side
    # of a left one; sessions without items come by an anti join.
    columns = [*sessions.columns, "page", "items"]
    found = pages.join(sessions, F.col(session_id) == F.col("_session")).select(*columns)
    used = items.select(F.col(item_session).alias("_session")).distinct()
    unused = sessions.join(used, F.col(session_id) == F.col("_session"), "left_anti")
    empty = F.array().cast(pages.schema["items"].dataType)
    return found.unionByName(unused.select("*", F.lit(0).cast("bigint").alias("page"), empty.alias("items")))


def owned_by(items: DataFrame, sessions: DataFrame, user: Column, item_session: str = "session_id",
             session_id: str = "id") -> DataFrame:
    """Items whose session satisfies ``user`` (a condition on the session table)."""
    mine = sessions.filter(user).select(F.col(session_id).alias("_owned"))
    return items.join(mine, F.col(item_session) == F.col("_owned"), "left_semi")


def cascade_delete(sessions: DataFrame, items: DataFrame, ids: DataFrame, session_id: str = "id",
                   item_session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in ``ids`` (one column; ids may repeat).

    How ids meet the rows goes by their number, which is counted first, not by the size of the
    files they come from: up to ``FEW_IDS`` go to every task. More are dealt by hash with the
    rows into shares of about ``SHARE_IDS`` or fewer, whose number adaptive execution keeps. A
    task holds one share, each id once; rows of both tables pass by unsorted."""
    gone = ids.toDF("_gone")
    n = gone.count()
    if n <= FEW_IDS:
        gone = F.broadcast(gone)
    else:
        shares = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARE_IDS))
        gone = gone.repartition(shares, "_gone").hint("shuffle_hash")
    return (
        sessions.join(gone, F.col(session_id) == F.col("_gone"), "left_anti"),
        items.join(gone, F.col(item_session) == F.col("_gone"), "left_anti"),
    )


def unique_ci(new: DataFrame, existing: DataFrame, columns: list[str], order: str) -> DataFrame:
    """New rows accepted one after the other in ``order`` (a unique column), each only
    if none of ``columns`` equals, ignoring case and outer blanks, a value that exists
    or was accepted before.

    One column needs one pass. With several, a row rejected for its email must not
    block its user name, so rounds accept every row that comes first on all its keys
    among the undecided rows, reject what clashes with it, and go on until no row is
    undecided. Per key only its first row is shuffled to a winner check."""
    keys = {c: f"_ci_{c}" for c in columns}
    pending = new.withColumns({k: F.lower(strip(c)) for c, k in keys.items()})
    for c, k in keys.items():
        taken = existing.select(F.lower(strip(c)).alias(k)).distinct()
        pending = pending.join(taken, k, "left_anti")

    def firsts(df: DataFrame) -> DataFrame:
        """Order values of rows that come first on every key."""
        winners = None
        for k in keys.values():
            first = df.groupBy(k).agg(F.min(order).alias(order)).select(order)
            winners = first if winners is None else winners.join(first, order, "left_semi")
        return winners

    if len(columns) == 1:
        first = F.min_by(F.struct(*new.columns), order).alias("_row")
        return pending.groupBy(*keys.values()).agg(first).select("_row.*")

    accepted: list[DataFrame] = []
    pending = cut_lineage(pending)
    while not pending.isEmpty():
        won = cut_lineage(pending.join(firsts(pending), order, "left_semi"))
        accepted.append(won.select(*new.columns))
        # Every round decides at least the globally first pending row.
        for k in keys.values():
            pending = pending.join(won.select(k), k, "left_anti")
        pending = cut_lineage(pending)
    result = accepted[0] if accepted else new.limit(0)
    for part in accepted[1:]:
        result = result.unionByName(part)
    return result


# --- latest, order, quota -----------------------------------------------------------


def latest_item(items: DataFrame, item_session: str = "session_id", item_time: str = "created_at",
                item_id: str = "id") -> DataFrame:
    """Newest item per session; ties go to the higher id. An aggregate, so each map
    task sends one row per session however large the session is."""
    rest = [c for c in items.columns if c != item_session]
    return (
        items.groupBy(item_session)
        .agg(F.max_by(F.struct(*rest), F.struct(item_time, item_id)).alias("_row"))
        .select(item_session, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*items.columns)
    )


def newest_first(df: DataFrame, time: str, row_id: str, limit: int | None = None) -> DataFrame:
    """Whole table newest first (range-partitioned sort), or the newest ``limit`` rows."""
    ordered = df.orderBy(*newest(time, row_id))
    return ordered if limit is None else ordered.limit(limit)


def within_quota(items: DataFrame, limit: int | Column, item_session: str = "session_id",
                 item_time: str = "created_at", item_id: str = "id", bucket: Column | None = None) -> DataFrame:
    """The first ``limit`` items of each session, in order of arrival.

    A number allows Spark's window group limit: every map task keeps at most that
    many rows per session before the shuffle. A per-session limit column uses the
    skew-safe position instead, over ranges of alike many rows if no ``bucket`` is given."""
    order = [F.col(item_time).asc(), F.col(item_id).asc()]
    if isinstance(limit, int):
        rank = F.row_number().over(Window.partitionBy(item_session).orderBy(*order))
        return items.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    placed = with_position(items, [item_session], order, bucket, "_rank")
    return placed.filter(F.col("_rank") < limit).drop("_rank")


def touch_session(sessions: DataFrame, items: DataFrame, session_id: str = "id", updated: str = "updated_at",
                  item_session: str = "session_id", changed: str = "created_at") -> DataFrame:
    """``updated_at`` moves to the time of the last item change."""
    last = items.groupBy(F.col(item_session).alias("_session")).agg(F.max(changed).alias("_last"))
    return (
        sessions.join(last, F.col(session_id) == F.col("_session"), "left")
        .withColumn(updated, F.greatest(updated, "_last"))
        .drop("_session", "_last")
    )


def items_per_session(sessions: DataFrame, items: DataFrame, session_id: str = "id",
                      item_session: str = "session_id") -> DataFrame:
    counts = items.groupBy(F.col(item_session).alias("_session")).agg(F.count("*").alias("n_items"))
    n = F.coalesce("n_items", F.lit(0))
    label = (
        F.when(n == 0, "No items yet").when(n == 1, "1 item").otherwise(F.concat(n.cast("string"), F.lit(" items")))
    )
    return (
        sessions.select(session_id).join(counts, F.col(session_id) == F.col("_session"), "left")
        .select(session_id, n.alias("n_items"), label.alias("label"))
    )


# --- search and updates ----------------------------------------------------------------


def search_sessions(sessions: DataFrame, items: DataFrame, query: str, session_id: str = "id",
                    title: str = "title", item_session: str = "session_id",
                    item_texts: tuple[str, ...] = ("pasted_code", "generated_tests")) -> DataFrame:
    """Sessions whose title (or default title) or any item text contains the query,
    ignoring case. Items are filtered before they meet the sessions."""
    needle = query.strip().lower()
    if not needle:
        return sessions.limit(0)
    default = F.concat(F.lit("Session #"), F.col(session_id).cast("string"))
    shown = F.lower(F.coalesce(F.nullif(title, F.lit("")), default))
    hit = F.lit(False)
    for c in item_texts:
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    hits = items.filter(hit).select(F.col(item_session).alias("_session"), F.lit(True).alias("_hit")).distinct()
    return (
        sessions.join(hits, F.col(session_id) == F.col("_session"), "left")
        .filter(shown.contains(needle) | F.coalesce("_hit", F.lit(False)))
        .drop("_session", "_hit")
    )


def apply_changes(items: DataFrame, changes: DataFrame, item_id: str = "id", changed_at: list[str] = ("changed_at",),
                  text: str = "generated_tests", meta: str | None = "meta") -> DataFrame:
    """Latest change per item replaces its text and merges its meta; other items stay.

    Changes are reduced to one row per item first (``changed_at`` lists the columns
    that order them), so the join is one to one."""
    payload = [text] + ([meta] if meta else [])
    latest = (
        changes.groupBy(F.col(item_id).alias("_id"))
        .agg(F.max_by(F.struct(*payload), F.struct(*changed_at)).alias("_new"))
    )
    out = items.join(latest, F.col(item_id) == F.col("_id"), "left")
    out = out.withColumn(text, F.coalesce(F.col(f"_new.{text}"), F.col(text)))
    if meta:
        merged = merge_meta(meta, F.col(f"_new.{meta}"))
        out = out.withColumn(meta, F.when(F.col("_id").isNotNull(), merged).otherwise(F.col(meta)))
    return out.select(*items.columns)
