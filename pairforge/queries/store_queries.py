"""Sessions and items, selection among candidates, splits, time-driven rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import rules as rl
from pairforge.functions.literals import compare_close
from pairforge.operators import store as st
from pairforge.operators.blocks import merge_tests
from pairforge.operators.candidates import (
    first_passing,
    regeneration_budget,
    rejection_counts,
    union_stages,
    with_presets,
)
from pairforge.operators.compare import reconcile
from pairforge.operators.training import split_hash, train_eval_split
from pairforge.queries import query
from pairforge.queries.tables import table
from pairforge.session import scratch_path
from pairforge.sources.source_files import decode_source
from pairforge.sources.store import with_defaults
from pairforge.streaming.activity import activity_sessions
from pairforge.streaming.lockout import lockout_stream, login_lockout


def as_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per customer; its items are the customer's orders."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "c_mktsegment")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("generated_tests"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", "text")


# --- the store ---------------------------------------------------------------------------


@query("""SELECT conv_id AS session_id, turn AS id, CASE WHEN role = 'user' THEN 'upload' ELSE 'paste' END AS input_method,
  text AS generated_tests, CAST(0 AS INTEGER) AS n_meta, source_filename IS NULL AS no_file
FROM (SELECT *, CAST(NULL AS VARCHAR) AS source_filename FROM conversations)""")
def q_store_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old item layout: no meta, no file name, input method not always known."""
    old = turns(spark, sf_dir).select(
        "session_id", "id", F.when(F.col("role") == "user", "upload").alias("input_method"), F.col("text").alias("generated_tests")
    )
    full = with_defaults(old, "items")
    return full.select(
        "session_id", "id", "input_method", "generated_tests", F.size("meta").alias("n_meta"),
        F.col("source_filename").isNull().alias("no_file"),
    )


@query("""WITH ranked AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS p
  FROM orders),
pages AS (SELECT o_custkey, p // 4 AS page, string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY p) AS items, count(*) AS n FROM ranked GROUP BY ALL)
SELECT c_custkey AS id, c_name AS title, CAST(coalesce(page, 0) AS BIGINT) AS page, coalesce(items, '') AS items, CAST(coalesce(n, 0) AS INTEGER) AS n_items
FROM customer LEFT JOIN pages ON c_custkey = o_custkey""")
def q_sessions_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four items, so that paging itself is exercised."""
    nested = st.sessions_with_items(sessions(spark, sf_dir).drop("c_mktsegment"), items(spark, sf_dir), page_size=4)
    shown = F.transform("items", lambda i: F.concat(i["id"].cast("string"), F.lit(":"), i["generated_tests"]))
    return nested.select("id", "title", "page", F.array_join(shown, ",").alias("items"), F.size("items").alias("n_items"))


@query("""SELECT o_orderkey AS id, o_custkey AS session_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_owned_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = st.owned_by(items(spark, sf_dir), sessions(spark, sf_dir), F.col("c_mktsegment") == "BUILDING")
    return mine.select("id", "session_id")


@query("""SELECT 'session' AS kind, o_orderkey AS id, CAST(0 AS INTEGER) AS line FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'item', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    gone = orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    left, kept = st.cascade_delete(orders, lines, gone, "o_orderkey", "l_orderkey")
    return left.select(F.lit("session").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("line")).unionByName(
        kept.select(F.lit("item").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    )


NEW_USERS_SQL = """WITH new AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE ' ' || lower(c_mktsegment) || ' ' END
  || c_nationkey AS username FROM customer),
taken AS (SELECT DISTINCT 'building' || s_nationkey AS k FROM supplier),
ranked AS (SELECT c_custkey, username, lower(trim(username)) AS k, row_number() OVER (PARTITION BY lower(trim(username)) ORDER BY c_custkey) AS rn FROM new)
SELECT c_custkey, username FROM ranked WHERE rn = 1 AND k NOT IN (SELECT k FROM taken)"""


@query(NEW_USERS_SQL)
def q_unique_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    name = F.concat(
        F.when(F.col("c_custkey") % 2 == 0, F.upper(segment)).otherwise(F.concat(F.lit(" "), F.lower(segment), F.lit(" "))),
        F.col("c_nationkey").cast("string"),
    )
    new = table(spark, sf_dir, "customer").select("c_custkey", name.alias("username"))
    taken = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Building"), F.col("s_nationkey").cast("string")).alias("username"))
    return st.unique_ci(new, taken, ["username"], "c_custkey")


@query("""SELECT c_custkey, CASE WHEN length(trim(u)) = 0 THEN 'username_required' WHEN length(trim(u)) < 3 THEN 'username_too_short'
  WHEN length(trim(u)) > 150 THEN 'username_too_long' WHEN m = '' THEN 'email_required' WHEN length(m) > 254 THEN 'email_too_long'
  WHEN c_custkey % 11 IN (6, 7) THEN 'email_invalid' WHEN c_custkey % 11 = 8 THEN 'password_too_short' END AS reason
FROM (SELECT c_custkey, CASE c_custkey % 11 WHEN 1 THEN '  ' WHEN 2 THEN ' ab ' WHEN 3 THEN repeat(c_name, 10) ELSE c_name END AS u,
  CASE c_custkey % 11 WHEN 4 THEN '' WHEN 5 THEN repeat('a', 260) ELSE 'x' END AS m FROM customer)""")
def q_valid_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey") % 11, F.col("c_name")
    user = F.when(k == 1, "  ").when(k == 2, " ab ").when(k == 3, F.repeat(name, F.lit(10))).otherwise(name)
    plain = F.concat(F.lit(" "), F.replace(name, F.lit("#"), F.lit(".")), F.lit("@mail.example.org "))
    mail = (
        F.when(k == 4, " ").when(k == 5, F.repeat(F.lit("a"), F.lit(260))).when(k == 6, "a@b")
        .when(k == 7, F.concat(name, F.lit("@@x.org"))).otherwise(plain)
    )
    length = F.when(k == 8, 7).otherwise(8)
    reason = rl.first_reason(rl.registration_rules(user, mail, length))
    return table(spark, sf_dir, "customer").select("c_custkey", reason.alias("reason"))


# --- latest, order, quota ------------------------------------------------------------------


@query("""SELECT session_id, id, text FROM (SELECT conv_id AS session_id, turn AS id, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC, turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def q_latest_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = turns(spark, sf_dir).withColumn("created_at", F.floor(F.col("id") / 2)).drop("role")
    return st.latest_item(timed).select("session_id", "id", "text")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def q_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = st.newest_first(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")
    return ordered.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT 'fixed' AS kind, id, session_id FROM r WHERE rn <= 3 UNION ALL SELECT 'own', id, session_id FROM r WHERE rn <= session_id % 8""")
def q_within_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    fixed = st.within_quota(df, 3)
    own = st.within_quota(df, F.col("session_id") % 8)
    return fixed.select(F.lit("fixed").alias("kind"), "id", "session_id").unionByName(
        own.select(F.lit("own").alias("kind"), "id", "session_id")
    )


@query("""SELECT c_custkey AS id, CAST(count(o_orderkey) AS BIGINT) AS n_items, CASE count(o_orderkey) WHEN 0 THEN 'No items yet' WHEN 1 THEN '1 item'
  ELSE count(o_orderkey) || ' items' END AS label FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def q_items_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.items_per_session(sessions(spark, sf_dir), items(spark, sf_dir))


@query("""SELECT c_custkey AS id, strftime(greatest(TIMESTAMP '1997-01-01', max(o_orderdate)), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def q_touch_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = sessions(spark, sf_dir).withColumn("updated_at", F.lit("1997-01-01").cast("timestamp_ntz"))
    return st.touch_session(old, items(spark, sf_dir)).select("id", as_text(F.col("updated_at")).alias("updated_at"))


SEARCH_SQL = """SELECT '{0}' AS query, id, title FROM heads h WHERE contains(lower(CASE WHEN title = '' THEN 'Session #' || id ELSE title END), '{0}')
  OR EXISTS (SELECT 1 FROM conversations i WHERE i.conv_id = h.id AND contains(lower(i.text), '{0}'))"""
SEARCHES = ("about 1", "session #1", "que la")


@query("""WITH heads AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Chat about ' || (conv_id % 50) END AS title
  FROM conversations)
""" + " UNION ALL ".join(SEARCH_SQL.format(q) for q in SEARCHES))
def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns(spark, sf_dir)
    title = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("Chat about "), (F.col("id") % 50).cast("string")))
    heads = found.select(F.col("session_id").alias("id")).distinct().withColumn("title", title)
    texts = found.select("session_id", F.col("text").alias("pasted_code"), F.lit(None).cast("string").alias("generated_tests"))
    parts = [
        st.search_sessions(heads, texts, f" {q.upper()} ").select(F.lit(q).alias("query"), "id", "title") for q in SEARCHES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH latest AS (SELECT l_orderkey, arg_max(l_returnflag || l_linenumber, struct_pack(d := l_shipdate, n := l_linenumber, p := l_partkey, e := l_extendedprice)) AS t,
  arg_max(l_linestatus, struct_pack(d := l_shipdate, n := l_linenumber, p := l_partkey, e := l_extendedprice)) AS s FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce(t, o_orderpriority) AS generated_tests, CASE WHEN s IS NULL THEN 'generate' ELSE 'regenerate' || s END AS origin,
  'base' AS mode FROM orders LEFT JOIN latest ON l_orderkey = o_orderkey""")
def q_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changes of their order: the last shipped one wins."""
    meta = F.create_map(F.lit("origin"), F.lit("generate"), F.lit("mode"), F.lit("base"))
    changed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice",
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("generated_tests"),
        F.create_map(F.lit("origin"), F.concat(F.lit("regenerate"), "l_linestatus")).alias("meta"),
    )
    out = st.apply_changes(items(spark, sf_dir).withColumn("meta", meta), changed, changed_at=["l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"])
    return out.select("id", "generated_tests", F.col("meta")["origin"].alias("origin"), F.col("meta")["mode"].alias("mode"))


@query("""WITH s AS (SELECT conv_id, turn // 4 AS page, turn, text FROM conversations)
SELECT conv_id, CAST(page AS BIGINT) AS page, CASE WHEN page = 0 THEN '# Origin: Beams (multi-function)' || chr(10) ELSE '' END ||
  string_agg(CASE WHEN turn = 0 THEN 'import pytest' || chr(10) ELSE '' END || 'def test_t' || turn || '():' || chr(10) || '    # ' || replace(text, chr(10), ' '),
    chr(10) || chr(10) ORDER BY turn) AS block FROM s GROUP BY conv_id, page""")
def q_merge_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as single tests, each with its own origin line and import."""
    snippet = F.concat(
        F.lit("# Origin: Beams \nimport pytest\ndef test_t"), F.col("id").cast("string"), F.lit("():\n    # "),
        F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\n"),
    )
    blocks = merge_tests(
        turns(spark, sf_dir).withColumn("snippet", snippet), ["session_id"], [F.col("id")], page_size=4
    )
    return blocks.withColumnRenamed("session_id", "conv_id")


# --- candidates ----------------------------------------------------------------------------


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates of their source: stage by language, index by id."""
    reason = rl.first_reason([
        ("too_long", F.col("n_chars") > 8000),
        ("forbidden_token", rl.has_forbidden_tokens("text")),
        ("too_short", F.length("text") < 400),
    ])
    stage = F.when(F.col("lang") == "en", 2).otherwise(1)
    return table(spark, sf_dir, "documents").select(
        "source", stage.alias("stage"), F.col("doc_id").alias("idx"), reason.alias("reason"), "text"
    )


OFFERS_SQL = """WITH offers AS (SELECT source, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS stage, doc_id AS idx, text,
  CASE WHEN n_chars > 8000 THEN 'too_long' WHEN contains(text, '__') OR contains(text, 'import ') OR contains(text, ';') THEN 'forbidden_token'
    WHEN length(text) < 400 THEN 'too_short' END AS reason FROM documents)
"""


@query(OFFERS_SQL + """, best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stage, idx) AS rn FROM offers WHERE reason IS NULL)
SELECT s.source, CAST(s.n AS BIGINT) AS n_candidates, CAST(b.stage AS INTEGER) AS stage, b.idx, b.text
FROM (SELECT source, count(*) AS n FROM offers GROUP BY source) s LEFT JOIN best b ON b.source = s.source AND b.rn = 1""")
def q_first_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_passing(offers(spark, sf_dir), ["source"])


@query(OFFERS_SQL + "SELECT source, reason, CAST(count(*) AS BIGINT) AS n FROM offers WHERE reason IS NOT NULL GROUP BY ALL")
def q_rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejection_counts(offers(spark, sf_dir), ["source"])


@query("""SELECT doc_id, CAST(1 AS INTEGER) AS stage FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, 3 FROM documents""")
def q_union_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = docs.filter("lang <> 'en'"), docs.filter("lang = 'en'"), docs
    return union_stages(*parts).select("doc_id", "stage")


MARKERS_SQL = " + ".join(
    f"CAST(contains(t, '{m}') AS INT)" for m in rl.NUMERIC_MARKERS
), " + ".join("CAST(contains(t, '" + m.replace("'", "''") + "') AS INT)" for m in rl.STRING_MARKERS)
KIND_SQL = rf"""SELECT *, CASE WHEN {MARKERS_SQL[0]} > {MARKERS_SQL[1]} THEN 'numeric' ELSE 'string' END AS kind
  FROM (SELECT doc_id, n_chars, regexp_replace(lower(text), '(".*?"|''.*?'')', '', 'g') AS t FROM documents)"""


@query(f"SELECT doc_id, kind FROM ({KIND_SQL})")
def q_task_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rl.task_kind("text").alias("kind"))


@query(f"""SELECT doc_id, kind, CAST(CASE WHEN n_chars > 2000 THEN 9 WHEN kind = 'string' THEN 4 ELSE 6 END AS INTEGER) AS num_beams,
  CAST(CASE WHEN kind = 'string' THEN 12 ELSE 4 END AS INTEGER) AS sample_candidates, CASE WHEN kind = 'string' THEN 0.85 ELSE 0.4 END::DOUBLE AS temperature
FROM ({KIND_SQL})""")
def q_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("own_beams", F.when(F.col("n_chars") > 2000, 9))
    return with_presets(docs, "text", {"num_beams": "own_beams"}).select(
        "doc_id", "kind", "num_beams", "sample_candidates", "temperature"
    )


@query(f"""SELECT doc_id, CAST(greatest(samples, CASE WHEN kind = 'string' THEN 16 ELSE 8 END) AS INTEGER) AS sample_candidates,
  CASE WHEN kind = 'string' THEN greatest(temperature, 0.95) ELSE least(temperature, 0.8) END AS temperature,
  CAST(CASE WHEN kind = 'string' THEN greatest(top_k, 120) ELSE least(top_k, 40) END AS INTEGER) AS top_k
FROM (SELECT *, doc_id % 20 AS samples, CAST(doc_id % 4 AS DOUBLE) / 4 + 0.5 AS temperature, doc_id % 150 AS top_k FROM ({KIND_SQL}))""")
def q_regeneration_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling parameters of a regeneration, raised or lowered to what the kind of text needs."""
    docs = table(spark, sf_dir, "documents").withColumn("kind", rl.task_kind("text"))
    asked = ((F.col("doc_id") % 20).cast("int"), (F.col("doc_id") % 4) / 4 + 0.5, (F.col("doc_id") % 150).cast("int"))
    return docs.select("doc_id", regeneration_budget(F.col("kind"), *asked).alias("b")).select(
        "doc_id", F.col("b.sample_candidates").cast("int").alias("sample_candidates"), "b.temperature", F.col("b.top_k").cast("int").alias("top_k")
    )


@query("""SELECT page_id, CASE WHEN url IS NULL OR NOT (url || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.py' END) LIKE '%.py' THEN 'not_a_py_file'
  WHEN length(html) * 400 > 524288 THEN 'file_too_large' END AS reason FROM pages""")
def q_client_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upload form refuses: names without the suffix, then sizes above the limit."""
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, "").otherwise(".py"))
    return table(spark, sf_dir, "pages").select("page_id", rl.first_reason(rl.client_file_rules(name, F.length("html") * 400)).alias("reason"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'x' || chr(233) || chr(255) || ' = ' || doc_id END AS code FROM documents""")
def q_decode_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as bytes: whole documents in UTF-8, and Latin-1 that is no valid UTF-8."""
    latin = F.encode(F.concat(F.lit("x\u00e9\u00ff = "), F.col("doc_id").cast("string")), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin)
    return table(spark, sf_dir, "documents").select("doc_id", decode_source(content).alias("code"))


# --- comparing, splitting --------------------------------------------------------------------


@query("""WITH billed AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey),
j AS (SELECT coalesce(o_orderkey, l_orderkey) AS k, o_totalprice AS a, v AS b, o_orderkey IS NULL AS no_l, l_orderkey IS NULL AS no_r
  FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') FULL JOIN billed ON o_orderkey = l_orderkey)
SELECT k, CASE WHEN no_r THEN 'left_only' WHEN no_l THEN 'right_only' WHEN abs(a - b) <= greatest(0.5 * greatest(abs(a), abs(b)), 1e-9) THEN 'matching'
  ELSE 'differing' END AS status, CASE WHEN NOT no_l AND NOT no_r THEN a < b AND NOT abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9) END AS below FROM j""")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the sum of their lines, within half of the larger value."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    left = orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    billed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    both = reconcile(left, billed, ["k"], "v", rtol=0.5)
    return both.select("k", "status", compare_close(F.col("left_value"), F.col("right_value"), "<").alias("below"))


@query("""SELECT doc_id, CAST(h AS BIGINT) AS h, CASE WHEN h < 429496729 THEN 'eval' ELSE 'train' END AS split
FROM (SELECT doc_id, ('0x' || substring(md5('42:' || doc_id), 1, 8))::BIGINT AS h FROM documents)""")
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return train_eval_split(docs, "doc_id").select("doc_id", split_hash(F.col("doc_id")).alias("h"), "split")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) <= ceil(0.1 * (SELECT count(*) FROM documents)) THEN 'eval' ELSE 'train' END AS split
FROM documents""")
def q_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_eval_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", exact=True)


# --- time-driven rules --------------------------------------------------------------------------

# Purchases stand for good logins, everything else for wrong ones; the lockout lasts half
# a day so that the events of one user fall into each other's reach.
HALF_DAY = 43_200


LOCKOUT_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM (SELECT *, event_type = 'purchase' AS ok FROM (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN -1 ELSE user_id END AS user_id) FROM events))
  WHERE event_id % 17 <> 0),
run AS (
  SELECT user_id, n, event_id, CASE WHEN ok THEN 0 ELSE 1 END AS fails, CASE WHEN ok THEN 0 ELSE t + {HALF_DAY}000000 END AS counter_until,
    CAST(0 AS BIGINT) AS blocked_until, CASE WHEN ok THEN 200 ELSE 401 END AS status FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id,
    CASE WHEN e.t < run.blocked_until THEN run.fails WHEN e.ok THEN 0 WHEN e.t < run.counter_until THEN run.fails + 1 ELSE 1 END,
    CASE WHEN e.t < run.blocked_until THEN run.counter_until WHEN e.ok THEN 0 ELSE e.t + {HALF_DAY}000000 END,
    CASE WHEN e.t < run.blocked_until THEN run.blocked_until WHEN e.ok THEN 0
      WHEN (CASE WHEN e.t < run.counter_until THEN run.fails + 1 ELSE 1 END) >= 5 THEN e.t + {HALF_DAY}000000 ELSE 0 END,
    CASE WHEN e.t < run.blocked_until THEN 429 WHEN e.ok THEN 200
      WHEN (CASE WHEN e.t < run.counter_until THEN run.fails + 1 ELSE 1 END) >= 5 THEN 429 ELSE 401 END
  FROM run JOIN e ON e.user_id = run.user_id AND e.n = run.n + 1)
SELECT event_id, CAST(status AS INTEGER) AS status, CAST(CASE WHEN status = 401 THEN 5 - fails END AS INTEGER) AS attempts_left FROM run
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 17 = 0"""


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 13th event has no key (they are one key), every 17th no time."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("ts"),
        F.when(F.col("event_id") % 13 != 0, F.col("user_id").cast("string")).alias("key"), (F.col("event_type") == "purchase").alias("ok"),
    )


@query(LOCKOUT_SQL)
def q_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return login_lockout(logins(spark, sf_dir), row_id="event_id", lockout_seconds=HALF_DAY).select("event_id", "status", "attempts_left")


@query(LOCKOUT_SQL)
def q_lockout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same attempts in three arrivals, split by time; states travel between micro-batches."""
    attempts = logins(spark, sf_dir)
    folder, out, offsets = (scratch_path(spark, n) for n in ("logins", "lockout", "offsets"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, second = attempts.select(us.cast("double").alias("us")).approxQuantile("us", [0.3, 0.6], 0.01) or (0.0, 0.0)
    arrival = F.when(us > second, 2).when(us > first, 1).otherwise(0)
    for n in range(3):
        attempts.filter(arrival == n).write.mode("append").parquet(folder)
        source = spark.readStream.schema(attempts.schema).parquet(folder)
        lockout_stream(source, out, offsets, row_id="event_id", lockout_seconds=HALF_DAY).awaitTermination()
    judged = spark.read.schema("event_id long, status int, attempts_left int").parquet(out + "/attempts")
    return judged.select("event_id", "status", "attempts_left")


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {HALF_DAY}000000 THEN 0 ELSE 1 END AS fresh
  FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, CAST(count(*) AS BIGINT) AS n_events FROM s GROUP BY user_id, no""")
def q_activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity_sessions(table(spark, sf_dir, "events"), "user_id", idle_seconds=HALF_DAY)
    return found.select("user_id", as_text("session_start").alias("session_start"), as_text("session_end").alias("session_end"), "n_events")


