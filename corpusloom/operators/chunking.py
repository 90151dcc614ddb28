"""Byte-bounded chunks of sections, with overlap, never across a section's end.

Separators from coarse to fine: a text is cut at the coarsest one in it, each
separator staying at the head of the piece after it; pieces still too long are
cut at the next finer one. Pieces then fill chunks greedily; the next chunk
starts with as many of the last pieces as the overlap allows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.shared import Settings, lean

# Where texts are cut, from coarse to fine; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _size(text: str) -> int:
    return len(text.encode())


def _cut(text: str, separator: str) -> Iterator[str]:
    """Piece by piece: all single characters of a long text at once would take many times its size."""
    if not separator:
        yield from text
        return
    begin, at = 0, text.find(separator)
    while at >= 0:
        if at > begin:
            yield text[begin:at]
        begin, at = at, text.find(separator, at + len(separator))
    if begin < len(text):
        yield text[begin:]


def _fill(pieces: Iterable[str], limit: int, overlap: int) -> list[str]:
    """Greedy chunks of joined pieces, stripped; empty ones vanish."""
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    size = 0
    for piece in pieces:
        n = _size(piece)
        if held and size + n > limit:
            out.append("".join(p for p, _ in held).strip())
            while held and (size > overlap or size + n > limit):
                size -= held.popleft()[1]
        held.append((piece, n))
        size += n
    if held:
        out.append("".join(p for p, _ in held).strip())
    return [c for c in out if c]


def split(text: str, limit: int = 1500, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``limit`` UTF-8 bytes (a single character may be longer than a tiny limit)."""
    at = next(k for k, s in enumerate(separators) if s in text or not s)
    out = []
    for small, pieces in groupby(_cut(text, separators[at]), lambda p: at + 1 == len(separators) or _size(p) < limit):
        if small:
            out += _fill(pieces, limit, overlap)
            continue
        for piece in pieces:
            out += split(piece, limit, overlap, separators[at + 1 :])
    return out


def chunks(sections: DataFrame, settings: Settings = Settings(), id_col: str = "document_id") -> DataFrame:  # noqa: B008
    """sections (id, section number, text, ...) exploded to chunks: adds part, chunk_id, content_hash; text is the chunk's.

    A null or blank section has no chunks. The same input gives the same chunks.
    """
    limit, overlap = settings.chunk_bytes, settings.overlap_bytes
    lean(sections.sparkSession)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, limit, overlap) if t else [])

    # Short sections are their own only chunk and need no worker.
    short = F.octet_length("text") < limit
    only = sections.where(short).withColumn("parts", F.filter(F.array(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")), lambda t: t != ""))
    cut = only.unionByName(sections.where(~short).withColumn("parts", run("text")))
    rest = [c for c in sections.columns if c != "text"]
    # The plain posexplode would have the optimiser test the parts' size first, and so split every text twice, in two workers.
    placed = cut.select(*rest, F.posexplode_outer("parts").alias("part", "text")).where("part IS NOT NULL")
    return placed.select(*rest, "part", "text", T.chunk_id(F.col(id_col).cast("string"), F.col("section"), F.col("part")).alias("chunk_id"), T.sha256(F.col("text")).alias("content_hash"))


def prepared(chunked: DataFrame, settings: Settings = Settings(), title_col: str = "document_title", heading_col: str = "section_heading", how: Callable[[Column], Column] | None = None) -> DataFrame:  # noqa: B008
    """Chunks ready to embed: text redacted, the prompt built from it and redacted again, content_hash that of the prompt.

    Adds prompt, redactions (finds of both passes per entity) and prompt_ok (within the prompt's byte limit). ``how``: another policy than the steps, ``spans.policy`` say.
    """
    from corpusloom.functions import redaction as R

    first = R.redacted(chunked, "text", text="text", counts="__a", how=how).withColumn("prompt", T.prompt_text(F.col(title_col), F.col(heading_col), F.col("text")))
    second = R.redacted(first, "prompt", text="prompt", counts="__b", how=how)
    both = F.map_zip_with("__a", "__b", lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return second.withColumn("redactions", both).withColumn("content_hash", T.sha256(F.col("prompt"))).withColumn("prompt_ok", F.octet_length("prompt") <= settings.prompt_max_bytes).drop("__a", "__b")


def redaction_totals(prepared_chunks: DataFrame) -> DataFrame:
    """Finds per entity over all chunks."""
    return prepared_chunks.select(F.explode("redactions").alias("entity", "n")).groupBy("entity").agg(F.sum("n").alias("n"))


def per_document(prepared_chunks: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Sections, chunks and redactions of each document."""
    found = F.aggregate(F.map_values("redactions"), F.lit(0).cast("long"), lambda a, b: a + b)
    return prepared_chunks.groupBy(id_col).agg(F.count_distinct("section").alias("sections"), F.count("*").alias("chunks"), F.sum(found).alias("redactions"))


def unchanged(prepared_chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Re-prepared chunks against stored ones by chunk_id: those whose hash or text differs, or that stand on one side only."""
    a = prepared_chunks.select("chunk_id", F.struct("content_hash", "text").alias("now"))
    b = stored.select("chunk_id", F.struct("content_hash", "text").alias("then"))
    return a.join(b, "chunk_id", "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
