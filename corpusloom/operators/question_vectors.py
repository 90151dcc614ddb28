"""Stored vectors of questions: a snapshot table under a key of question, identity, provider's model and policy.

Only distinct questions that the table lacks are embedded. What is read is checked
anew: an entry of another model, of the wrong length, not finite or zero counts as
missing and is replaced. New entries are one commit on the table, so writers at the
same time settle one after the other and readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import models
from corpusloom.functions import redaction
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators.snapshots import SnapshotTable
from corpusloom.operators.store import IDENTITY
from corpusloom.shared import written

ENTRY = "vector_key string, model string, vector array<float>"


class QuestionVectors:
    """identity: backend, model, dimension and fingerprint of the index; policy: the name of the redaction that questions pass."""

    def __init__(self, spark: SparkSession, path: str, identity: dict, provider_model: str, policy: str = "query", buckets: int = 16):
        self.identity, self.provider_model, self.policy = identity, provider_model, policy
        self.table = SnapshotTable(spark, path, "vector_key", buckets)

    def key(self, question: Column) -> Column:
        fixed = {f"identity_{k}": F.lit(str(self.identity[k])) for k in IDENTITY}
        return T.fingerprint(question=question, provider_model=F.lit(self.provider_model), policy=F.lit(self.policy), **fixed)

    def usable(self) -> DataFrame | None:
        """vector_key, embedding of the entries that may be used."""
        rows = self.table.rows()
        if rows is None:
            return None
        good = (F.col("model") == self.provider_model) & V.valid(F.col("vector"), self.identity["dimension"])
        return rows.where(good).select("vector_key", F.col("vector").alias("embedding")).dropDuplicates(["vector_key"])

    def embedded(self, questions: DataFrame, make: Callable[[], models.Embedder], text_col: str = "question", refresh: bool = False) -> DataFrame:
        """questions with ``embedding`` and ``from_cache``; null questions have neither. refresh: embed all anew and replace what is stored.

        Written once to the shared folder, so no action on the result calls the model again.
        """
        keyed = written(questions.withColumn("vector_key", F.when(F.col(text_col).isNotNull(), self.key(F.col(text_col)))), "questions")
        stored = None if refresh else self.usable()
        wanted = keyed.where("vector_key IS NOT NULL").select("vector_key", text_col).dropDuplicates(["vector_key"])
        missing = wanted if stored is None else wanted.join(stored.select("vector_key"), "vector_key", "left_anti")
        fresh = written(models.embedded(missing, make, self.identity["dimension"], "vector_key", text_col, policy=redaction.query_policy), "vectors")
        found = fresh.withColumn("from_cache", F.lit(False))
        if stored is not None:
            found = found.unionByName(stored.join(wanted.select("vector_key"), "vector_key", "left_semi").withColumn("from_cache", F.lit(True)))
        out = written(keyed.join(found, "vector_key", "left").drop("vector_key"), "embedded")
        if not fresh.isEmpty():
            self.table.change(fresh.select("vector_key", F.lit(self.provider_model).alias("model"), F.col("embedding").alias("vector")))
        return out
