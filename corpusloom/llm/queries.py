"""The registered queries of this subpackage: each applies one operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, filter_audit, gif, kmeans_tree, lexical, packing, quality, simhash, substrings, threshold, token_counts, toxicity, url_rules

LIMIT = 1024


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so every call does the whole job."""
    counted = token_counts.token_counts(_read(spark, sf_dir, "documents"), common.scratch(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(_read(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), size=LIMIT)


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(_read(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_digests(_read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_read(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.search(_read(spark, sf_dir, "embeddings"))


OPERATORS = (op1_token_counts, op2_quality_classifier, op3_nearest_neighbours, op4_packing, op5_gif_media, op6_toxicity, op7_url_filters, op8_simhash, op9_substring_dedup, op10_bpe, op11_lexical_search, op12_filter_audit, op13_inner_product)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


#: Every window of 50 words as text, the smallest document it starts in, and the words that a later document's copy covers.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS window_text FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
m AS (SELECT window_text, min(doc_id) AS least FROM s GROUP BY window_text),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM s JOIN m USING (window_text) WHERE s.doc_id > m.least),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
e AS (SELECT k.doc_id, string_agg(u.word, ' ' ORDER BY u.j) AS kept FROM k, LATERAL (SELECT unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j) u LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = u.j WHERE c.j IS NULL GROUP BY k.doc_id)
SELECT k.doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(e.kept, '')) AS kept_sha256 FROM k LEFT JOIN e ON e.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: tokenizers, XXH64, CRC-32, learned models and approximate search are tested by brute force."""
    return {"op7_url_filters": url_rules.SQL, "op9_substring_dedup": SUBSTRING_SQL, "op11_lexical_search": lexical.SQL, "op12_filter_audit": filter_audit.SQL, "op13_inner_product": threshold.SQL}
