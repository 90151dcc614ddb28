"""The vector table: snapshots of chunks with vectors, whose identity is a property of each snapshot.

A build is one commit: the new documents take the place of the old, what a document
no longer has falls away, and documents outside the manifest go. Readers see the
snapshot before or the one after, and a build that fails leaves the one before.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.snapshots import Snapshot, SnapshotTable

IDENTITY = ("backend", "model", "dimension", "fingerprint")


class IdentityMismatch(ValueError):
    """The stored index was built with another embedding, or isn't whole."""


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, identity: dict, buckets: int = 64):
        self.spark, self.identity = spark, identity
        self.table = SnapshotTable(spark, path, "document_id", buckets)

    def initialize(self) -> None:
        """Creates the empty table with its identity, once; later calls only check it. Rows without an identity, or an identity without its rows, are an error."""
        now = self.table.snapshot()
        if now is None:
            if self.table.has_data():
                raise IdentityMismatch("the index has rows and no identity")
            self.table.create({"identity": json.dumps({k: self.identity[k] for k in IDENTITY}, sort_keys=True)})
        elif lost := self.table.missing(now):
            raise IdentityMismatch(f"the index has an identity and lacks {len(lost)} of its buckets")
        self.assert_identity()

    def assert_identity(self) -> Snapshot:
        now = self.table.snapshot()
        if now is None or "identity" not in now.properties:
            raise IdentityMismatch("the index has no identity")
        stored = json.loads(now.properties["identity"])
        if any(stored.get(k) != self.identity[k] for k in IDENTITY):
            raise IdentityMismatch(json.dumps({k: stored.get(k) for k in ("backend", "model", "dimension")}))
        return now

    def check_provider_model(self, model: str) -> None:
        """The first model reported is recorded, by compare and set; another one later is drift."""
        found = self.assert_identity().properties.get("provider_model")
        if found is None and not self.table.set_property("provider_model", model, None):
            found = self.assert_identity().properties.get("provider_model")
        if found is not None and found != model:
            raise IdentityMismatch(f"the index was embedded by {found}")

    def rows(self, version: int | None = None) -> DataFrame | None:
        return self.table.rows(version)

    def replace(self, chunks: DataFrame, manifest: DataFrame | None = None) -> None:
        """Each document in chunks becomes exactly those chunks; with a manifest, the documents outside it go, in the same commit."""
        self.assert_identity()
        self.table.change(chunks, manifest)

    def keep_only(self, manifest: DataFrame) -> None:
        """Documents that aren't in the manifest go; an empty manifest is refused."""
        self.assert_identity()
        self.table.change(manifest=manifest)

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()


def upserted(store: DataFrame, new: DataFrame, document_col: str = "document_id") -> DataFrame:
    """The table after a replace: the new chunks, and the old ones of documents that aren't among them."""
    return store.join(new.select(document_col).distinct(), document_col, "left_anti").unionByName(new)


def pruned(store: DataFrame, manifest: DataFrame, document_col: str = "document_id") -> DataFrame:
    return store.join(manifest.select(document_col), document_col, "left_semi")


def corpus_digest(store: DataFrame, id_col: str = "chunk_id", hash_col: str = "content_hash", buckets: int = 4096) -> DataFrame:
    """One row (rows, digest): equal for equal sets of (id, hash).

    Sorted digests of buckets are digested again, so no task holds the corpus: a bucket holds a 4096th of the rows.
    """
    line = F.concat_ws("\t", F.col(id_col).cast("string"), F.col(hash_col))
    by_bucket = store.groupBy(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 3).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return by_bucket.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))
