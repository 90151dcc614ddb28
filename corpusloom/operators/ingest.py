"""Incremental embedding by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.shared import Settings, numbered, require


def last_per_hash(chunks: DataFrame, order_col: str, hash_col: str = "content_hash") -> DataFrame:
    """One row per content hash: the last in order."""
    last = Window.partitionBy(hash_col).orderBy(F.desc(order_col))
    return chunks.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def cached(hashes: DataFrame, store: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Stored vectors of the wanted hashes, one a hash."""
    return store.join(hashes.select(hash_col).distinct(), hash_col, "left_semi").dropDuplicates([hash_col])


def pending(chunks: DataFrame, store: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Distinct hashes that the store lacks."""
    return chunks.select(hash_col).distinct().join(store.select(hash_col), hash_col, "left_anti")


def budget(chunks: DataFrame, store: DataFrame, settings: Settings = Settings(), hash_col: str = "content_hash") -> DataFrame:  # noqa: B008
    """One row: total chunks, pending distinct hashes, reused = total - pending, batches, and whether they fit the budget."""
    known = store.select(hash_col).distinct().withColumn("known", F.lit(True))
    per_hash = chunks.groupBy(hash_col).agg(F.count("*").alias("n")).join(known, hash_col, "left")
    sums = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count_if(F.col("known").isNull()).alias("pending"))
    batches = F.ceil(F.col("pending") / settings.batch_size).cast("long")
    return sums.select("total", "pending", (F.col("total") - F.col("pending")).alias("reused"), batches.alias("batches"), (batches <= settings.max_batches).alias("within_budget"))


def batches(pending_hashes: DataFrame, settings: Settings = Settings(), hash_col: str = "content_hash") -> DataFrame:  # noqa: B008
    """Pending hashes with their place in order and batch number."""
    return numbered(pending_hashes, hash_col).withColumn("batch", F.floor(F.col("position") / settings.batch_size).cast("long"))


def with_vectors(chunks: DataFrame, vectors: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Every chunk with its vector; a missing vector fails the job."""
    joined = chunks.join(vectors.select(hash_col, "embedding"), hash_col, "left")
    return require(joined, F.col("embedding").isNotNull(), F.concat(F.lit("no vector for "), F.coalesce(hash_col, F.lit("a null hash"))))


def without_chunks(documents: DataFrame, chunks: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Documents that yielded no chunk."""
    return documents.join(chunks.select(id_col), id_col, "left_anti")


def provenance_mismatch(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks whose provenance differs from the manifest entry, or that have none. The URL is compared with the resolved one."""
    url = F.coalesce(F.nullif("m.resolved_url", F.lit("")), "m.source_url")
    same = F.col("c.source_url").eqNullSafe(url) & F.col("c.regulator").eqNullSafe(F.col("m.regulator")) & F.col("c.document_title").eqNullSafe(F.col("m.title")) & F.col("c.retrieved_at").eqNullSafe(F.col("m.retrieved_at"))
    return chunks.alias("c").join(manifest.alias("m"), "document_id", "left").where(~same | F.col("m.title").isNull()).select("document_id", "c.chunk_id")
