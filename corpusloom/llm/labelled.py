"""Which rows may teach: labels of documents outside the held-out fifth."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents (label int, text): of those not held out, the ones with the smallest hash of their id.

    Labels other than 0 and 1, null ids and repeated label rows are left out. The
    chosen ids and labels are at most ``rows`` rows, which bounds what is broadcast.
    """
    chosen = common.bounded_sample(labels.select(labels[id_col].cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL").where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label")), "id", rows)
    kept = common.text_of(docs, docs[id_col].cast("long").alias("id"), text_col=text_col)
    return kept.join(F.broadcast(chosen), "id").select("id", "label", "text")
