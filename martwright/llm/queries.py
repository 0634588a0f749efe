"""Registered queries of the pipeline operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import (
    bpe,
    exact_dedup,
    merkle,
    packing,
    prefix_trie,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    """Place of the public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeat_report(documents(spark, folder))


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(documents(spark, folder))


@query
def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), tokenizer_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(documents(spark, folder), labels(spark, folder))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = labels(spark, folder).filter("quality = 1")
    return quality_rules.held_out_verdicts(documents(spark, folder), trusted)


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


SQL["op7_exact_dedup"] = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       text_sha256
FROM hashed
WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), tokenizer_path())


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    history = warc.archive_pages(spark.read.parquet(f"{folder}/pages.parquet"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = """
WITH payload AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
),
marked AS (
  SELECT page_id, strlen(body) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY body) AS first_id
  FROM payload
)
SELECT page_id,
       payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(hex, CAST(1 + (5 * i) // 4 AS INTEGER), 2) AS INTEGER)
                   >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31 AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM marked
"""


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), tokenizer_path())


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tamper_check(documents(spark, folder))


# CRC-32 of a decimal number, bit by bit.
CRC32_MACRO = """
xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_prepend(xor(c, x), CAST(range(8) AS BIGINT[])),
    lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)
"""

_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(_FRAMED.format(c) for c in fields) + ")"


SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {CRC32_MACRO.format(id="doc_id")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql("text")} END AS seen
  FROM documents
),
trees AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves GROUP BY source
),
start AS (
  SELECT tree, n, row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf, doc_id, seen
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source
),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM start
  UNION ALL
  SELECT tree, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3
),
over AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM trees) AS n, digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM over WHERE n > 1 GROUP BY level, idx // 3
),
runs AS (
  SELECT tree, level, idx // 3 AS run, string_agg(digest, '' ORDER BY idx) AS joined FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, level, idx // 3, string_agg(digest, '' ORDER BY idx) FROM over WHERE n > 1 GROUP BY ALL
),
walk AS (
  SELECT doc_id, leaf, tree, tree AS here, 0 AS level, idx, n, CAST(0 AS BIGINT) AS step, '' AS proof, seen AS held, idx AS start_idx FROM start
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree,
         CASE WHEN r.joined IS NULL THEN -1 ELSE w.here END,
         CASE WHEN r.joined IS NULL THEN 0 ELSE w.level + 1 END,
         CASE WHEN r.joined IS NULL THEN w.tree ELSE w.idx // 3 END,
         CASE WHEN r.joined IS NULL THEN (SELECT count(*) FROM trees) ELSE (w.n + 2) // 3 END,
         w.step + 1,
         w.proof || coalesce(r.joined[:64 * (w.idx % 3)] || r.joined[64 * (w.idx % 3) + 65:], ''),
         CASE WHEN r.joined IS NULL THEN w.held
              ELSE sha256(r.joined[:64 * (w.idx % 3)] || w.held || r.joined[64 * (w.idx % 3) + 65:]) END,
         w.start_idx
  FROM walk w LEFT JOIN runs r ON r.tree = w.here AND r.level = w.level AND r.run = w.idx // 3
  WHERE w.here >= 0 OR w.n > 1
),
done AS (SELECT * FROM walk WHERE here = -1 AND n = 1)
SELECT d.doc_id, d.leaf, s.digest AS subroot, o.digest AS root, sha256(d.proof) AS proof_sha256,
       d.held AS folded_root, d.held = o.digest AS verified
FROM done d
JOIN (SELECT tree, digest FROM nodes WHERE n = 1) s ON s.tree = d.tree
JOIN (SELECT digest FROM over WHERE n = 1) o ON true
"""


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


SQL["op11_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS framed,
         length(coalesce(text, '')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, count(*) AS size, conv_id - conv_id % 100 AS first_id, {CRC32_MACRO.format(id="conv_id")} % 6 AS h
  FROM turns GROUP BY conv_id
),
convs AS (
  SELECT o.conv_id, o.first_id, o.h, least(o.h, coalesce(f.size, 0)) AS taken,
         least(o.h, coalesce(f.size, 0)) + greatest(o.size - o.h, 0) AS total
  FROM own o LEFT JOIN own f ON f.conv_id = o.first_id
),
rebuilt AS (
  SELECT c.conv_id, t.rank + 1 AS depth, c.total, t.framed, t.n
  FROM convs c JOIN turns t ON t.conv_id = c.first_id AND t.rank < c.h
  UNION ALL
  SELECT c.conv_id, c.taken + t.rank - c.h + 1, c.total, t.framed, t.n
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank >= c.h
),
path AS (
  SELECT conv_id, depth, total, n,
         string_agg(sha256(framed), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS way FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, total, 0, '' FROM convs
),
nodes AS (
  SELECT depth, way, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n,
         string_agg(CASE WHEN total = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM path GROUP BY depth, way
),
family AS (
  SELECT p.depth, p.way, sum((n.n_convs - 1) * n.n) AS saved,
         sum(CASE WHEN n.n_convs = len(string_split(n.ends, ',')) THEN 1 ELSE 0 END) AS leaves
  FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth
  GROUP BY p.depth, p.way
),
kids AS (
  SELECT depth - 1 AS depth, way[:64 * (depth - 1)] AS way, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, CAST(f.leaves AS BIGINT) AS n_leaves,
       CAST(f.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n
JOIN family f ON f.depth = n.depth AND f.way = n.way
LEFT JOIN kids k ON k.depth = n.depth AND k.way = n.way
LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.way = n.way[:64 * (n.depth - 1)]
"""


@query
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeat_report(documents(spark, folder))


SQL["op12_substring_dedup"] = """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split)
),
repeats AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, i) > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM repeats),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
single AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
kept AS (
  SELECT s.doc_id, count(*) AS n, string_agg(s.word, ' ' ORDER BY s.i) AS text
  FROM single s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id
)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words,
       CAST(len(s.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
