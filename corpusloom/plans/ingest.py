"""The batch build: documents to sections, chunks, prompts, vectors, and the table; one lazy plan a stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import models
from corpusloom.functions import text as T
from corpusloom.operators import chunking, ingest, sections
from corpusloom.operators.store import VectorStore
from corpusloom.shared import Settings, counted, written
from corpusloom.sources.files import write_report


@dataclass
class Report:
    """What a run did."""

    status: str
    documents: int = 0
    chunks: int = 0
    pending: int = 0
    reused: int = 0
    batches: int = 0
    started_at: str = ""
    finished_at: str = ""
    error: str | None = None


def chunk_documents(documents: DataFrame, settings: Settings, landmark: str = "main") -> DataFrame:
    """Prepared chunks of html documents: manifest columns and ``html``. A document that can't be parsed or has no chunk fails the job."""
    parsed = sections.with_sections(documents, "html", landmark)
    sound = parsed.withColumn("s", F.when(F.col("parsed.error").isNotNull(), F.raise_error(F.concat("document_id", F.lit(": "), "parsed.error")).cast("array<struct<heading:string,text:string,anchor:string,page:int>>")).otherwise(F.col("parsed.sections")))
    url = F.coalesce(F.nullif("resolved_url", F.lit("")), "source_url")
    rows = sound.select("document_id", "regulator", F.col("title").alias("document_title"), url.alias("source_url"), "retrieved_at", F.posexplode("s").alias("section", "s")).select("document_id", "regulator", "document_title", "source_url", "retrieved_at", "section", F.col("s.heading").alias("section_heading"), F.col("s.text").alias("text"), "s.anchor", "s.page")
    return chunking.prepared(chunking.chunks(rows, settings), settings)


def run(documents: DataFrame, store: VectorStore, embedder: Callable[[], models.Embedder], settings: Settings, provider_model: str = "local", landmark: str = "main", prepare_only: bool = False, prune: bool = True, report_path: str | None = None) -> Report:
    """One build; its report, with UTC times, is written to ``report_path`` whether it succeeds or fails. A failure is raised again."""
    started = _now()
    report = Report("failed")
    try:
        report = _build(documents, store, embedder, settings, provider_model, landmark, prepare_only, prune)
    except Exception as e:
        report.error = type(e).__name__  # the message may quote a document
        raise
    finally:
        report.started_at, report.finished_at = started, _now()
        if report_path:
            write_report(documents.sparkSession, asdict(report), report_path)
    return report


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _build(documents: DataFrame, store: VectorStore, embedder: Callable[[], models.Embedder], settings: Settings, provider_model: str, landmark: str, prepare_only: bool, prune: bool) -> Report:
    """Every embedding is made and kept before one commit replaces the documents and prunes the rest."""
    seen: dict = {}
    chunks = counted(chunk_documents(documents, settings, landmark), "chunks", seen, chunks=F.count("*"), over=F.count_if(~F.col("prompt_ok")))
    if seen["over"]:
        raise ValueError(f"{seen['over']} prompts are over the byte limit")
    empty = ingest.without_chunks(documents, chunks).count()
    if empty:
        raise ValueError(f"{empty} documents have no chunk")
    if prepare_only:
        return Report("prepared", documents.count(), seen["chunks"])
    store.initialize()
    rows = store.rows()
    stored = documents.sparkSession.createDataFrame([], "content_hash string, embedding array<float>") if rows is None else rows.select("content_hash", "embedding")
    b = ingest.budget(chunks, stored, settings).first()
    if not b["within_budget"]:
        raise ValueError(f"{b['batches']} batches are over the budget of {settings.max_batches}")
    wanted = chunks.select("content_hash", "prompt").dropDuplicates(["content_hash"])
    fresh = written(models.embedded(wanted.join(stored.select("content_hash"), "content_hash", "left_anti"), embedder, settings.dimension, batch=settings.batch_size), "vectors")
    if b["pending"]:
        store.check_provider_model(provider_model)
    known = ingest.cached(chunks.select("content_hash"), stored)
    final = written(ingest.with_vectors(chunks, known.unionByName(fresh)).drop("prompt", "prompt_ok", "redactions"), "indexed")
    store.replace(final, documents if prune else None)
    return Report("completed", documents.count(), b["total"], b["pending"], b["reused"], b["batches"])


def fingerprint_columns(backend: str, model: str, settings: Settings, policy: str) -> dict:
    """Constant columns of an embedding identity, and their digest."""
    fields = {"backend": backend, "model": model, "dimension": str(settings.dimension), "chunk_bytes": str(settings.chunk_bytes), "overlap_bytes": str(settings.overlap_bytes), "redaction": policy, "prompt": "title-heading-text", "distance": "cosine"}
    return {"fields": fields, "fingerprint": T.fingerprint(**{k: F.lit(v) for k, v in fields.items()})}
