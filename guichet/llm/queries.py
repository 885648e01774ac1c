"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from guichet.llm import (
    graph_search,
    minhash_join,
    mixing,
    pii,
    prefix_trie,
    quality_forest,
    segment_sampling,
    sharding,
    source_audit,
    suffix_dedup,
    token_counts,
    url_rules,
    warc,
)
from guichet.llm.common import table
from guichet.operators.settle import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


@register("op1_sample_segmentations")
def sample_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sample its rank, number of pieces, a digest of them, and the scores."""
    sampled = segment_sampling.sample_segmentations(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return sampled.select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("digest"), "log_prob", "log_inclusion", "round_trip"
    )


@register("op2_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).report()


@register("op3_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


_PLACES = """p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
)"""


@register(
    "op4_url_rules",
    f"""WITH {_PLACES}, r(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path
           ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS place
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN fits ON p.host = fits.host AND p.path = fits.path AND place = 1""",
)
def judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


@register("op5_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@register("op6_quality_forest")
def judge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality_forest.fit_forest(docs, table(spark, sf_dir, "labels"))
    return quality_forest.judge(docs, forest)


@register("op7_graph_search")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


_DIGEST = " || ".join(
    f"substr('{warc.BASE32}', ((('0x' || substr(sha1, {g * 5 + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)


@register(
    "op8_warc_round_trip",
    f"""WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha1 FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY sha1) AS first FROM p)
SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@register(
    "op9_minhash_join",
    r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT shingle FROM s GROUP BY 1 HAVING count(*) > 1),
t AS MATERIALIZED (SELECT s.* FROM s SEMI JOIN shared USING (shingle)),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.seen = links.u
), c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN c ON documents.doc_id = c.doc_id LEFT JOIN n ON documents.doc_id = n.doc_id""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_surrogates")
def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the text with surrogates, and the mentions of each type."""
    replaced = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), counts="mentions")
    numbers = [F.col("mentions")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.TYPES)]
    return replaced.select("doc_id", "text", F.aggregate("mentions", F.lit(0), lambda a, x: a + x).alias("n_mentions"), *numbers)


@register("op11_shuffle_shards")
def shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents, shuffled into shards and written; the figures are of what was written."""
    shards = sharding.write_shards(table(spark, sf_dir, "documents"), shared_folder(spark))
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


_PROBABILITY = "(1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 5)) // ({total} + 5 * v))::BIGINT"


@register(
    "op12_source_audit",
    rf"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), c AS MATERIALIZED (
  SELECT id, lang, source, term, count(*) AS n
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
  GROUP BY ALL
), kept AS MATERIALIZED (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), n AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         {_PROBABILITY.format(n="n", total="total")} AS p, {_PROBABILITY.format(n="lang_n", total="lang_total")} AS q
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
  LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
  GROUP BY ALL
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= 50""",
)
def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


# The checksum of decimal digits, bit by bit, from its fixed polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
           list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
         lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


@register(
    "op13_prefix_trie",
    f"""WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT *, {_CRC32} % 9 AS h FROM t),
r AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
), m AS (SELECT conv_id, len(path) AS length, unnest(range(0, len(path) + 1)) AS depth, path FROM r),
nodes AS MATERIALIZED (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends,
         (count(*) - 1) * coalesce(strlen(any_value(path[depth].text)), 0) AS saved
  FROM m GROUP BY ALL
), kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
k AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
below AS (
  SELECT prefix, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT unnest(list_transform(range(0, depth + 1), lambda i: prefix[1:i])) AS prefix, saved, n_children FROM k)
  GROUP BY 1
)
SELECT k.conv_id, k.depth, parent.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN below USING (prefix) LEFT JOIN k parent ON k.depth > 0 AND parent.prefix = k.prefix[1:k.depth - 1]""",
)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
