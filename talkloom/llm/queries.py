"""The registered queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import centroid_clustering, decontamination, html_extraction, language_id, license_scan, mixing, ngram_jaccard, prefix_trie, quality_rules, substring_dedup, token_counts, url_filter, warc
from talkloom.llm._spark import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.drop("rule")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.shared_path(spark)
    warc.archive(read(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_html_extraction": op2_html_extraction,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_mixing": op4_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_quality_rules": op6_quality_rules,
        "op7_license_scan": op7_license_scan,
        "op8_warc": op8_warc,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_language_id": op10_language_id,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_url_filter": op12_url_filter,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


# links are pairs with a shingle in common whose sets pass the threshold; components are what they reach
_JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
sizes AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
members AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n >= 75 * (x.n_shingles + y.n_shingles - n)),
edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM edges
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT doc_id, n_shingles, coalesce(r.least, doc_id) AS component_id
FROM sizes LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) r USING (doc_id)
"""

# strings are taken from hexadecimal blocks of 256 bytes and 99 more; equal ones are told by MD5
_REPEATS_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (
  SELECT *, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM t),
blocks AS (
  SELECT doc_id, n_bytes, 256 * b AS base, substr(h, 512 * b + 1, 710) AS part
  FROM (SELECT *, unnest(range(0, n_bytes // 256 + 1)) AS b FROM n WHERE n_bytes >= 100)),
strings AS (
  SELECT doc_id, base + i AS pos, md5_number(substr(part, 2 * i + 1, 200)) AS k
  FROM (SELECT *, unnest(range(0, least(256, n_bytes - 99 - base))) AS i FROM blocks)),
firsts AS (
  SELECT k, min(row(doc_id, pos)) AS first FROM strings GROUP BY k HAVING count(*) > 1),
later AS (
  SELECT doc_id, pos FROM strings JOIN firsts USING (k) WHERE row(doc_id, pos) <> first),
marked AS (
  SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER w <= 100 THEN 0 ELSE 1 END AS fresh FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
islands AS (
  SELECT doc_id, island, min(pos) AS a, max(pos) + 100 AS b
  FROM (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked) GROUP BY 1, 2),
cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM islands),
pieces AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS stop, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
  FROM cuts JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN pieces USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": _JACCARD_SQL, "op4_mixing": mixing.ORACLE, "op8_warc": _WARC_SQL, "op9_substring_dedup": _REPEATS_SQL, "op11_prefix_trie": prefix_trie.ORACLE, "op13_centroid_clustering": centroid_clustering.oracle()}
