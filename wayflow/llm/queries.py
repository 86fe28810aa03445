"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, exact_dedup, fingerprints, language, near_dedup, packing, prefix_trie, quality, secrets, segmenting, toxicity, training, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "worth", "passages")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenting.segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.learn())


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT k, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs)
),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
each_one AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, t.term) AS of_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total, v
  FROM groups g JOIN kept t USING (lang) JOIN vocabulary USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
shares AS (
  SELECT lang, source, term, n, (1 + (1000000000 * (n + 1)::HUGEINT) // (total + v)::HUGEINT)::HUGEINT AS p,
         (1 + (1000000000 * (of_lang + 1)::HUGEINT) // (lang_total + v)::HUGEINT)::HUGEINT AS q FROM each_one
),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM best))
WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || t)) AS pos, r, t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
),
crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(s))
),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(s)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.pos, r, t FROM convs c JOIN turns t ON t.conv_id = c.head AND t.pos <= h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, r, t FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h
),
paths AS (
  SELECT conv_id, coalesce(list({'r': r, 't': t} ORDER BY own, pos) FILTER (WHERE r IS NOT NULL), []) AS path
  FROM (SELECT * FROM rebuilt UNION ALL SELECT conv_id, 2, 0, NULL, NULL FROM convs) GROUP BY conv_id
),
steps AS (SELECT conv_id, d, path[1:d] AS node, len(path) = d AS ends FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY node, d
),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT a.*, coalesce(k.n, 0) AS n_children, CASE WHEN a.d = 0 THEN 0 ELSE (n_convs - 1) * length(a.node[a.d].t) END AS saved FROM nodes a LEFT JOIN kids k USING (node)),
sums AS (
  SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node[1:up] AS node, leaf, saved FROM (SELECT node, (n_children = 0)::INT AS leaf, saved, unnest(range(d + 1)) AS up FROM own)) GROUP BY node
)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (node) LEFT JOIN nodes p ON o.d > 0 AND p.node = o.node[1:o.d - 1]
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_fingerprints": op1_fingerprints,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_segmentations": op7_segmentations,
    "op8_packing": op8_packing,
    "op9_exact_duplicates": op9_exact_duplicates,
    "op10_url_filter": op10_url_filter,
    "op11_source_audit": op11_source_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op9_exact_duplicates": OP9_SQL, "op11_source_audit": OP11_SQL, "op13_prefix_trie": OP13_SQL}
