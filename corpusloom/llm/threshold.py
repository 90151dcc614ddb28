"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Components are turned into integers, floor(256 * x). Vectors are dealt into parts
of about ``PART`` rows by a hash, so parts are even whatever the ids. A part sorts
its rows by every dimension. A query reads those lists downwards where its own
component is positive, upwards where it is negative (not at all where it is 0),
all to the same depth; a row met in any list gets its full score. No row still
unseen can score more than the sum of the query's components times the values the
lists have come to. The query leaves the part when that bound is below the kth
score so far, or when no row is unseen. Depths double; what has been seen to a
depth is a bitmap a list, made once a part, and a query ORs those of its lists.

Every query first searches one part. The kth score there is a floor for all: a
part whose list heads can't reach it is left at once, others as soon as their bound
falls below it. Then blocks of about ``BLOCK`` queries meet the parts pairwise and
each leaves every part with its best there; a windowed top-k, pre-cut in every
task, merges them. How early lists can be left depends on the vectors: with 64
components that vary alike, most rows are met before the bound falls.

Of equal vectors only the k + 1 smallest ids can be among anyone's k best, so a
group of copies sends no more than that from each task; equal queries are worked
off once, and their answers handed to every one of them.

Vectors that are null or empty, or hold null or non-finite components, take no
part, nor do those of another length than the most frequent (ties: the shorter),
nor rows with a null id. Repeated rows count once; of an id with several different
vectors the least, component by component, takes part. Ties go to the smaller id. Fewer than k candidates: all of them. Components
and scores must fit 64 bits. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

SCALE, PART, BLOCK, FIRST = 256, 4096, 2048, 64
NONE = -(1 << 63)


def quantised(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id long and q array<long> of the rows that take part, each once."""
    v = F.col("v")
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    fit = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fit).select("vec_id", F.transform(v, lambda x: F.floor(x * SCALE)).alias("q"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, highest first, ties to the smaller id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Lists:
    """A part's rows and its lists, sorted by each dimension: first all downwards, then all upwards."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, largest: int):
        """largest: the greatest absolute component of any query; it decides which numbers hold every score exactly."""
        n, width = rows.shape
        most = width * int(np.abs(rows).max(initial=0)) * largest
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.rows, self.ids, self.width = np.ascontiguousarray(rows, dtype=self.kind), ids, width
        upwards = np.argsort(rows, axis=0, kind="stable").T
        lists = np.concatenate((upwards[:, ::-1], upwards))
        values = np.concatenate((rows.T, rows.T))
        self.depths = [min(n, FIRST << j) for j in range(max(1, (max(1, -(-n // FIRST)) - 1).bit_length() + 1))]
        self.heads = np.take_along_axis(values, lists[:, :1], 1)[:, 0]
        self.floors = [np.take_along_axis(values, lists[:, d - 1 : d], 1)[:, 0] for d in self.depths]
        seen, self.seen = np.zeros((2 * width, n), dtype=bool), []
        for d in self.depths:
            np.put_along_axis(seen, lists[:, :d], True, 1)
            self.seen.append(np.packbits(seen, axis=1))
        self.nothing = np.zeros(self.seen[0].shape[1], dtype=np.uint8)

    def bound(self, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The most that a row can score whose components lie beyond the values at which the lists stand."""
        return np.maximum(queries, 0) @ at[: self.width] + np.minimum(queries, 0) @ at[self.width :]

    def search(self, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and ids of each query's k best rows; rows that can't reach its floor may be left out."""
        heads, bounds = self.bound(queries, self.heads), [self.bound(queries, f) for f in self.floors]
        return [self._one(q, floor, k, head, [b[i] for b in bounds]) for i, (q, floor, head) in enumerate(zip(queries, floors.tolist(), heads.tolist(), strict=True))]

    def _one(self, q: np.ndarray, floor: int, k: int, head: int, bounds: list) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if head < floor:
            return scores, ids
        own = np.concatenate((np.flatnonzero(q > 0), self.width + np.flatnonzero(q < 0)))
        asked = q.astype(self.kind)
        before = self.nothing
        for bound, depth, seen in zip(bounds, self.depths, self.seen, strict=True):
            now = np.bitwise_or.reduce(seen[own], axis=0) if len(own) else self.seen[-1][0]  # a query of zeros reads no list
            new = np.flatnonzero(np.unpackbits(now & ~before, count=len(self.ids)))
            # one product over the part where a round meets much of it
            met = self.rows[new] @ asked if 4 * len(new) < len(self.ids) else (self.rows @ asked)[new]
            scores, ids = best(np.concatenate((scores, met.astype(np.int64))), np.concatenate((ids, self.ids[new])), k)
            floor = max(floor, int(scores[-1]) if len(scores) == k else NONE)
            if bound < floor or depth == len(self.ids):
                break
            before = now
        return scores, ids


def _found(queries: pa.Table, rows: pa.Table, width: int, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    q = _matrix(queries.column("q"), width)
    return Lists(_matrix(rows.column("q"), width), rows.column("vec_id").to_numpy(), int(np.abs(q).max())).search(q, floors, k)


def _every_pair(asked: DataFrame, stored: DataFrame, parts: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of queries and parts of rows, each with all of the other kind."""
    of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select("*", F.pmod(F.xxhash64("head"), F.lit(blocks)).cast("int").alias("block"), of(parts, "part"))
    return left, stored.select("*", of(blocks, "block"))


def search(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    all_rows = quantised(table, id_col, vector_col)
    widths = all_rows.groupBy(F.size("q").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, parts = widths["width"], max(1, -(-widths["count"] // part))
    rows = common.written(all_rows.where(F.size("q") == width).groupBy("vec_id").agg(F.min("q").alias("q")), "vectors")
    copy = F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))
    stored = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "q", F.pmod(F.xxhash64("vec_id", "q"), F.lit(parts)).cast("int").alias("part"))
    stored = common.written(stored, "parts")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    # equal queries are worked off once, under their smallest id, and for k + 1 rows, one of which each will leave out
    heads = common.written(asked.groupBy("q").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")), "queries")
    total, distinct = heads.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()

    def first(a: pa.Table, b: pa.Table) -> pa.Table:
        floors = np.full(a.num_rows, NONE)
        if a.num_rows and b.num_rows:
            for i, (scores, _) in enumerate(_found(a, b, width, k + 1, floors)):
                if len(scores) == k + 1:
                    floors[i] = scores[-1]
        return pa.table([a.column("head"), a.column("q"), pa.array(floors)], ["head", "q", "floor"])

    def then(a: pa.Table, b: pa.Table) -> pa.Table:
        got = _found(a, b, width, k + 1, a.column("floor").to_numpy()) if a.num_rows and b.num_rows else []
        cat = lambda x: pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]))
        names = np.repeat(a.column("head").to_numpy()[: len(got)], [len(s) for s, _ in got])
        return pa.table([pa.array(names, pa.int64()), cat(i for _, i in got), cat(s for s, _ in got)], ["head", "vec_id", "score"])

    own = heads.select("head", "q", F.pmod(F.xxhash64("head"), F.lit(parts)).cast("int").alias("part"))
    bounded = common.written(own.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(first, "head long, q array<long>, floor long"), "floors")
    left, right = _every_pair(bounded, stored, parts, max(1, -(-distinct // block)))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(then, "head long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("head").orderBy(F.desc("score"), "vec_id"))
    lists = met.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    answers = common.written(heads.join(lists, "head").select("q", "found"), "answers")
    pairs = common.spread_join(asked, answers, ["q"], common.hot_keys(heads, ["q"], "copies", total))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return pairs.select(F.col("vec_id").alias("query_id"), "found").select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
