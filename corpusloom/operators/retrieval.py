"""Exact cosine top-k for many questions at once, gates, variants and provenance.

Questions are searched in blocks of bounded size: each block's vectors are
broadcast and the corpus is scanned once, as matrix products over Arrow
batches. A task emits at most k rows a question, which a windowed top-k merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.shared import written

BLOCK = 4096


def _unit(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def top_k(questions: DataFrame, corpus: DataFrame, k: int, dimension: int, question_col: str = "question_id", id_col: str = "chunk_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """question id (long), chunk id (long or string), similarity, excerpt number from 1: nearest first, ties to the smaller chunk id. Invalid vectors take no part.

    Up to ``block`` questions make one lazy scan. More are worked off block by block,
    each one's result written before the next is gathered, so the driver and the
    executors hold the vectors of one block.
    """
    kind = "string" if corpus.schema[id_col].dataType.simpleString() == "string" else "long"
    asked = questions.where(V.valid(F.col(vector_col), dimension)).select(F.col(question_col).cast("long").alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    stored = corpus.where(V.valid(F.col(vector_col), dimension)).select(F.col(id_col).cast(kind).alias("c"), F.col(vector_col).cast("array<double>").alias("v"))
    parts = max(1, -(-asked.count() // block))
    best = Window.partitionBy(question_col).orderBy(F.desc("similarity"), id_col)
    first = lambda found: found.withColumn("number", F.row_number().over(best)).where(F.col("number") <= k)
    if parts == 1:
        return first(_scan(asked, stored, k, question_col, id_col, kind)[0])
    dealt = written(asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(parts))), "asked")
    done = []
    for b in range(parts):
        found, sent = _scan(dealt.where(F.col("block") == b).select("q", "v"), stored, k, question_col, id_col, kind)
        done.append(written(first(found), "ranked"))
        sent.unpersist()
    return reduce(DataFrame.unionByName, done)


def _nearest(near: np.ndarray, ids: np.ndarray, here: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's best so far (near, ids) and a batch's similarities (here) to rows ``own``, the k best, ties to the smaller id."""
    n, seen = near.shape
    values = np.concatenate((near, here), axis=1)
    width = min(k, values.shape[1])
    edge = np.partition(values, values.shape[1] - width, axis=1)[:, values.shape[1] - width]
    row, at = np.nonzero(values >= edge[:, None])  # k a row, and those that tie with the last
    names = np.where(at < seen, ids[row, np.minimum(at, seen - 1)], own[np.maximum(at - seen, 0)]) if seen else own[at]
    value = values[row, at]
    order = np.lexsort((names, -value, row))
    starts = np.searchsorted(row, np.arange(n))  # row is ascending, and stays so in order
    take = order[(starts[:, None] + np.arange(width)).ravel()]
    return value[take].reshape(n, width), names[take].reshape(n, width)


def _scan(block: DataFrame, stored: DataFrame, k: int, question_col: str, id_col: str, kind: str) -> tuple[DataFrame, Broadcast]:
    got = block.toArrow()  # about ``block`` rows by construction
    names = got.column("q").to_numpy()
    sent = stored.sparkSession.sparkContext.broadcast((names, _unit(got.column("v").combine_chunks()) if len(names) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        if q is None:
            return
        near, ids = np.full((len(names), 0), 0.0), None
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                own = part.column("c").to_numpy(zero_copy_only=False)
                ids = np.empty((len(names), 0), dtype=own.dtype) if ids is None else ids
                near, ids = _nearest(near, ids, q @ _unit(part.column("v")).T, own, k)
        n = near.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(ids.ravel(), pa.string() if kind == "string" else pa.int64()), pa.array(near.ravel())], [question_col, id_col, "similarity"])

    return stored.mapInArrow(run, f"{question_col} long, {id_col} {kind}, similarity double"), sent


def gated(ranked: DataFrame, minimum: float) -> DataFrame:
    """Similarity at least ``minimum``, after the top-k, so each vector's similarity is computed once."""
    return ranked.where(F.col("similarity") >= minimum)


def restricted(corpus: DataFrame, manifest: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Rows of the documents in the manifest."""
    return corpus.join(manifest.select(id_col).distinct(), id_col, "left_semi")


def by_variant(ranked: DataFrame, variants: dict[str, int], minimum: float) -> DataFrame:
    """One ranking serves every variant: its first k rows that pass the gate."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("k")) for n, k in variants.items()]))
    return gated(ranked.select("*", table.alias("__v")).where("number <= __v.k").withColumn("variant", F.col("__v.variant")).drop("__v"), minimum)


def provenance_errors(candidates: DataFrame, manifest: DataFrame, question_col: str = "question_id") -> DataFrame:
    """Questions with a candidate whose URL, regulator or title isn't the manifest's: the whole question is in error."""
    m = manifest.select("document_id", F.struct("source_url", "regulator", F.col("title").alias("document_title")).alias("expected"))
    same = F.struct("source_url", "regulator", "document_title").eqNullSafe(F.col("expected"))
    return candidates.join(m, "document_id", "left").groupBy(question_col).agg(F.bool_or(~same).alias("mismatch")).where("mismatch").select(question_col)


def hits(ranked: DataFrame, gold: DataFrame, question_col: str = "question_id", id_col: str = "chunk_id") -> DataFrame:
    """Per question whether any gold chunk was retrieved."""
    found = ranked.join(gold.select(question_col, id_col), [question_col, id_col], "left_semi").select(question_col).distinct().withColumn("hit", F.lit(True))
    return gold.select(question_col).distinct().join(found, question_col, "left").select(question_col, F.coalesce("hit", F.lit(False)).alias("retrieval_hit"))
