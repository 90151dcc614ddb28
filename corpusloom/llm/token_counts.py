"""Token counts behind a digest cache.

The cache is a Parquet table (tokenizer digest, text digest, n_tokens) in a
folder that all executors share. Documents are joined to it on the digest of
their normalised content (null becomes the empty text; nothing else is changed,
since every other change could alter the count) and the digest of the tokenizer
file. Only distinct texts that the cache lacks are encoded, and their counts are
appended. Digests are pre-aggregated in each task before texts are shuffled, so
any number of copies of a text sends one row per task; rows of a digest that many
share meet its count from a bounded broadcast, not in one task.

Nulls count as empty (0 bytes, 0 tokens); long texts are encoded whole; repeated
rows each get a row; an empty table gives an empty result; other columns, whatever
their names, are neither read nor returned.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, tokenizer

CACHE = "tokenizer string, digest binary, n_tokens long"


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path, created empty if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def _encode(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    counts = [len(tokenizer.encode_array(t, name)) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def _keyed(docs: DataFrame, *columns, text_col: str) -> DataFrame:
    return common.text_of(docs, *columns, text_col=text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))


def misses(docs: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (digest, text) for each distinct text of docs that the cache doesn't hold."""
    return _keyed(docs, text_col=text_col).groupBy("digest").agg(F.first("text").alias("text")).join(cache.select("digest"), "digest", "left_anti")


def token_counts(docs: DataFrame, cache_path: str, name: str = tokenizer.DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id as ``doc_id``, n_bytes, n_tokens. Fills the cache at cache_path as a side effect."""
    spark = docs.sparkSession
    version = tokenizer.vocabulary(name).version
    known = lambda: open_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh = common.map_rows(misses(docs, known(), text_col), lambda b: _encode(b, name), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    rows = common.written(_keyed(docs, docs[id_col].alias("doc_id"), text_col=text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    hot = common.hot_keys(rows.groupBy("digest").agg(F.count("*").alias("rows")), ["digest"], "rows", rows.count())
    return common.spread_join(rows, known(), ["digest"], hot).select("doc_id", "n_bytes", "n_tokens")
