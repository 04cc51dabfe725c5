"""One query per operator, over its whole table with production settings, and SQL where
SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import lang_pieces
from pairforge.llm.collocations import collocations
from pairforge.llm.fingerprints import with_edits
from pairforge.llm.mixing import mix_plan
from pairforge.llm.near_dups import near_duplicates
from pairforge.llm.packing import pack
from pairforge.llm.pii_crf import KINDS, find_personal
from pairforge.llm.prefix_trie import prefix_trie
from pairforge.llm.quality_pu import classify, fit, held_out
from pairforge.llm.rule_votes import base_failed
from pairforge.llm.rule_votes import judge as judge_rules
from pairforge.llm.substrings import remove_repeats
from pairforge.llm.token_files import block_starts, read_token_files, scratch_path, write_token_files
from pairforge.llm.url_filter import judge as judge_urls

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register under the function's name; without SQL, tests compare with brute force."""

    def register(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql is not None:
            LLM_ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of each document, numbered over the table in order of (doc_id, position).
WORDS_SQL = r"""listed AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents)"""


@query(rf"""WITH {WORDS_SQL},
starts AS (
  SELECT doc_id, unnest(range(len(ws) - 19)) AS p,
    unnest(list_transform(range(len(ws) - 19), lambda i: array_to_string(list_slice(ws, i + 1, i + 20), ' '))) AS w
  FROM listed WHERE len(ws) >= 20),
windows AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM windows WHERE nth > 1),
gone_lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, len(l.ws) AS n_words, coalesce(len(g.ps), 0) AS n_removed,
    CASE WHEN g.ps IS NULL THEN l.ws
      ELSE list_transform(list_filter(range(len(l.ws)), lambda i: NOT list_contains(g.ps, i)), lambda i: l.ws[i + 1]) END AS ws
  FROM listed l LEFT JOIN gone_lists g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(ws, ' '), '')) AS kept_sha256 FROM kept""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier 20-word sequence, removed from every document."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query(r"""WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
      ELSE list_transform(range(len(ws) - 4), lambda i: list_slice(ws, i + 1, i + 5)) END) AS s FROM listed)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id""")
def op5_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets are at least 0.85 alike."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in grammar-compressed blocks and read back."""
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), path)
    docs = read_token_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return docs.join(block_starts(spark, path), ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a positive-unlabelled classifier."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query()
def op2_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts by consistent weighted sampling."""
    return with_edits(table(spark, sf_dir, "documents"))


@query()
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL: rules, else a regression on character n-grams."""
    return judge_urls(table(spark, sf_dir, "pages"))


@query()
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document and the verdict of its posterior."""
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judge_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior",
    )


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query()
def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: patterns and what the random field adds."""
    base = F.filter("spans", lambda s: s["base"])

    def found(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_personal(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[found(kind) for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


@query()
def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in optimal length buckets and batches of a word budget."""
    return pack(table(spark, sf_dir, "documents"))


#: CRC-32 of a number in decimal, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, b: list_reduce(list_concat([xor(r, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


@query(f"""WITH turns AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id),
heads AS (SELECT c AS conv_id, c - c % 5 AS base, {CRC32_SQL} % 9 AS h FROM (SELECT conv_id AS c FROM own)),
convs AS (
  SELECT o.conv_id, list_concat(coalesce(b.ts[1:h], []), o.ts[h + 1:]) AS ts
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = heads.base),
members AS (
  SELECT conv_id, d AS depth, ts[1:d] AS k FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM convs)),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY k, depth),
children AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT ts AS k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM convs GROUP BY ts),
facts AS (
  SELECT n.k, n.depth, n.conv_id, n.n_convs, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children, sha256(coalesce(e.ids, '')) AS ends_sha256,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.k[-1].text) END AS saved
  FROM nodes n LEFT JOIN children c ON c.k = n.k LEFT JOIN ends e ON e.k = n.k
  LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]),
sums AS (
  SELECT k[1:d] AS k, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT k, saved, n_children, unnest(range(depth + 1)) AS d FROM facts) GROUP BY 1)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s ON s.k = f.k""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with what its subtree saves."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query(r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
listed AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
spans AS (
  SELECT lang, ws[i:i + m - 1] AS p FROM (
    SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM listed, (SELECT unnest([1, 2, 3]) AS m))),
f AS (SELECT lang, p, count(*) AS n FROM spans GROUP BY lang, p),
sizes AS (SELECT lang, sum(n) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
candidates AS (SELECT lang, p, n AS a FROM f WHERE len(p) > 1 AND n >= 10),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates),
scores AS (
  SELECT c.lang, c.p, c.a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(a) AS a FROM (
    SELECT lang, p[1:2] AS p, a FROM candidates WHERE len(p) = 3 UNION ALL SELECT lang, p[2:3], a FROM candidates WHERE len(p) = 3)
  GROUP BY lang, p),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p WHERE g.a IS NULL OR 100 * g.a < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, sizes.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


@query()
def op13_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by models of pieces learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(F.col("doc_id").isNotNull() & ~lang_pieces.held_out(F.col("doc_id")))
    return lang_pieces.identify(docs, lang_pieces.fit(learned, _vocabulary("piece_bpe_32k.model")))
