"""Raw documents, stage artifacts, caches and reports as files any Spark file system reaches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 20_000_000
_NAME = r"([^/]+)\.([A-Za-z0-9]+)$"


def raw_documents(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """document_id, format, content, sha256 of the files in a folder; of one over ``limit`` bytes, which isn't read, ``length`` alone."""
    named = [F.regexp_extract("path", _NAME, 1).alias("document_id"), F.lower(F.regexp_extract("path", _NAME, 2)).alias("format")]
    files = spark.read.format("binaryFile").load(folder)
    whole = files.where(F.col("length") <= limit).select(*named, "content", F.sha2("content", 256).alias("sha256"), "length")
    large = files.where(F.col("length") > limit).select(*named, F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"), "length")
    return whole.unionByName(large)


def verified(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with ``content`` and ``error``: null if the bytes are those of the manifest and the retrieval date is known."""
    got = raw.select("document_id", "format", "content", F.col("sha256").alias("__sha"), "length")
    error = F.when(F.col("content").isNull() & F.col("length").isNotNull(), "too large").when(F.col("content").isNull(), "missing").when(F.col("retrieved_at").isNull(), "no retrieval date").when(~F.col("__sha").eqNullSafe(F.col("sha256")), "hash mismatch")
    return sources.join(got, ["document_id", "format"], "left").withColumn("error", error).drop("__sha", "length")


def to_download(sources: DataFrame, raw: DataFrame, refresh: bool = False) -> DataFrame:
    """Sources without a verified file; a file whose hash differs from the manifest fails the job unless refreshing."""
    if refresh:
        return sources
    known = sources.where("sha256 IS NOT NULL AND retrieved_at IS NOT NULL")
    held = known.join(raw.select("document_id", F.col("sha256").alias("__sha")), "document_id").select("document_id", F.when(~F.col("__sha").eqNullSafe(F.col("sha256")), F.raise_error(F.lit("cached source hash mismatch")).cast("boolean")).otherwise(F.lit(True)).alias("__held"))
    return sources.join(held.where("__held"), "document_id", "left_anti")


def pdf_sections(documents: DataFrame, id_col: str = "document_id", content_col: str = "content") -> DataFrame:
    """One row per page with text: heading "Page N", page N from 1, blank pages dropped after numbering. A document without text, or one that can't be read, is an error row.

    Needs the optional package pypdf on the executors.
    """
    import io

    import pandas as pd

    def run(batches):
        from pypdf import PdfReader

        for b in batches:
            rows = []
            for i, content in zip(b[id_col], b[content_col], strict=True):
                try:
                    pages = [(n, p.extract_text() or "") for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
                except Exception as e:  # a broken file is that document's error, not the job's
                    rows.append((i, None, None, None, None, None, f"unreadable: {type(e).__name__}"))
                    continue
                full = [(n, t) for n, t in pages if t.strip()]
                rows += [(i, k, f"Page {n}", t, None, n, None) for k, (n, t) in enumerate(full)] or [(i, None, None, None, None, None, "no extractable text")]
            yield pd.DataFrame(rows, columns=[id_col, "section", "heading", "text", "anchor", "page", "error"])

    return documents.select(id_col, content_col).mapInPandas(run, f"{id_col} string, section int, heading string, text string, anchor string, page int, error string")


def write_artifact(df: DataFrame, bucket: str, run_id: str, stage: str) -> None:
    """JSON objects of one run and stage, one folder a document."""
    df.write.mode("overwrite").partitionBy("document_id").json(f"{bucket}/runs/{run_id}/{stage}")


def read_artifact(spark: SparkSession, bucket: str, run_id: str, stage: str, schema: str, limit: int = LIMIT) -> DataFrame:
    """The artifact of a run and stage; oversized objects are refused by their file length."""
    path = f"{bucket}/runs/{run_id}/{stage}"
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").where(F.col("length") > limit)
    if not sizes.isEmpty():
        raise ValueError("artifact is larger than the limit")
    return spark.read.schema(schema).json(path)


def tolerant_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with ``object``: the parsed JSON object, or null for anything else."""
    v = F.try_parse_json(column)
    return lines.withColumn("object", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def raw_key(sources: DataFrame) -> DataFrame:
    """The object key of each raw document."""
    return sources.withColumn("key", F.concat(F.lit("documents/"), "document_id", F.lit("/"), "sha256", F.lit("."), "format"))


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON line; Spark's commit protocol makes it appear whole or not at all."""
    import json

    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


@contextmanager
def reported(spark: SparkSession, path: str | None, **fixed: object) -> Iterator[dict]:
    """A dict of figures that is written to ``path``, with UTC times and how the body ended, on success and on failure; a failure is raised again."""
    figures: dict = {**fixed, "status": "failed", "error": None, "started_at": datetime.now(timezone.utc).isoformat()}
    try:
        yield figures
        figures["status"] = "completed"
    except Exception as e:
        figures["error"] = type(e).__name__  # the message may quote a document
        raise
    finally:
        figures["finished_at"] = datetime.now(timezone.utc).isoformat()
        if path:
            write_report(spark, figures, path)
