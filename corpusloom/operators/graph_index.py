"""A graph index for cosine top-k: a navigable small-world graph a shard, searched together.

Rows are dealt to shards of about ``SHARD`` by a hash of their id, so a shard's size
doesn't grow with the table; the executors build each shard's graph and the index is
a table of one row a shard. In a graph a vector is linked to near ones on its own
level and those below, fewer vectors on each higher level; a search goes down from
the top greedily and keeps the ``width`` best on the ground. A question visits every
shard and the k best of all are merged, so its work grows with the number of shards,
as the exact scan's does with the rows, by some hundreds of comparisons a shard.

``calibrated`` finds the width at which questions drawn from the corpus get the
wanted share of their exact neighbours, by ``retrieval.top_k`` over all rows; where no
narrower width does, a width of a whole shard is exact.

Invalid vectors (null, of another dimension, zero, not finite) take no part, nor do
questions with one. Equal vectors are one node of a shard's graph, whatever their
number; ties go to the smaller id. Fewer rows than k: all. An empty corpus has an
empty index and result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import retrieval
from corpusloom.shared import written

SHARD, LINKS, BREADTH = 4096, 12, 64
RECALL, PROBES, WIDTHS = 0.97, 128, (16, 32, 64, 128, 256, 512)


class Graph:
    """A hierarchical navigable small-world graph over distinct unit vectors."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, breadth: int = BREADTH, seed: int = 7):
        self.unit, self.links = unit, links
        draw = np.random.default_rng(seed).random(len(unit))
        self.level = np.minimum((-np.log(1 - draw) / np.log(links)).astype(int), 12)
        self.near: list[list[list[int]]] = [[[] for _ in range(level + 1)] for level in self.level.tolist()]
        self.top = 0
        for node in range(1, len(unit)):
            self._insert(node, breadth)

    def _insert(self, node: int, breadth: int) -> None:
        q, level, top = self.unit[node], int(self.level[node]), int(self.level[self.top])
        start = self._down(q, top, level)
        for at in range(min(level, top), -1, -1):
            found = self._search(q, start, breadth, at)
            room = self.links * (1 if at else 2)
            self.near[node][at] = self._spread([n for _, n in found], [s for s, _ in found], self.links)
            for other in self.near[node][at]:
                mine = self.near[other][at]
                mine.append(node)
                if len(mine) > room:
                    like = self.unit[mine] @ self.unit[other]
                    order = np.argsort(-like, kind="stable")
                    self.near[other][at] = self._spread([mine[k] for k in order], like[order].tolist(), room)
            start = [n for _, n in found]
        if level > top:
            self.top = node

    def _spread(self, nodes: list[int], likeness: list[float], room: int) -> list[int]:
        """Of nodes, best first, those that are more like the centre than like one taken before; then the best of the rest."""
        if len(nodes) <= room:
            return list(nodes)
        v = self.unit[nodes]
        each, taken, rest = v @ v.T, [], []
        for k, like in enumerate(likeness):
            if len(taken) == room:
                break
            (taken if not taken or each[k, taken].max() < like else rest).append(k)
        return [nodes[k] for k in (taken + rest)[:room]]

    def _down(self, q: np.ndarray, top: int, level: int) -> list[int]:
        start = [self.top]
        for at in range(top, level, -1):
            start = [self._search(q, start, 1, at)[0][1]]
        return start

    def _search(self, q: np.ndarray, start: list[int], width: int, at: int) -> list[tuple[float, int]]:
        """The ``width`` best nodes met on a level, best first."""
        seen = set(start)
        held = sorted(zip((self.unit[start] @ q).tolist(), start, strict=True))[-width:]
        todo = [(-s, n) for s, n in held]
        heapq.heapify(todo), heapq.heapify(held)
        while todo:
            s, node = heapq.heappop(todo)
            if len(held) == width and -s < held[0][0]:
                break
            fresh = [n for n in self.near[node][at] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for like, n in zip((self.unit[fresh] @ q).tolist(), fresh, strict=True):
                if len(held) < width or like > held[0][0]:
                    heapq.heappush(todo, (-like, n))
                    heapq.heappush(held, (like, n)) if len(held) < width else heapq.heapreplace(held, (like, n))
        return sorted(held, key=lambda x: (-x[0], x[1]))

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        if width >= len(self.unit):
            like = self.unit @ q
            return [(float(like[n]), int(n)) for n in np.argsort(-like, kind="stable")]
        return self._search(q, self._down(q, int(self.level[self.top]), 0), width, 0)


def build(corpus: DataFrame, dimension: int, id_col: str = "chunk_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The index of a corpus: shard, rows, graph; written once."""
    kind = "string" if corpus.schema[id_col].dataType.simpleString() == "string" else "long"
    stored = corpus.where(V.valid(F.col(vector_col), dimension)).select(F.col(id_col).cast(kind).alias("c"), F.col(vector_col).cast("array<double>").alias("v"))
    shards = max(1, -(-stored.count() // shard))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("c")
        ids = t.column("c").to_numpy()
        unit, node = np.unique(retrieval._unit(t.column("v").combine_chunks()), axis=0, return_inverse=True)
        order = np.argsort(node, kind="stable")  # ids of a node stay in order
        made = pickle.dumps((Graph(unit), ids[order], np.append(0, np.cumsum(np.bincount(node)))))
        return pa.table([t.column("shard").slice(0, 1), pa.array([len(ids)], pa.int64()), pa.array([made], pa.binary())], ["shard", "rows", "graph"])

    dealt = stored.where(F.col("c").isNotNull()).withColumn("shard", F.pmod(F.xxhash64("c"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(fit, "shard int, rows long, graph binary"), "graphs")


def search(index: DataFrame, questions: DataFrame, k: int, dimension: int, width: int, question_col: str = "question_id", id_col: str = "chunk_id", vector_col: str = "embedding", kind: str = "long", block: int = retrieval.BLOCK) -> DataFrame:
    """As ``retrieval.top_k`` gives it, by the index: question, id, similarity, number. Questions are broadcast in blocks of about ``block``."""
    asked = written(questions.where(V.valid(F.col(vector_col), dimension)).select(F.col(question_col).cast("long").alias("q"), F.col(vector_col).cast("array<double>").alias("v")), "asked")
    parts = max(1, -(-asked.count() // block))
    best = Window.partitionBy(question_col).orderBy(F.desc("similarity"), id_col)

    def one(b: int) -> DataFrame:
        got = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == b).toArrow()  # about ``block`` rows
        names = got.column("q").to_numpy()
        sent = index.sparkSession.sparkContext.broadcast((names, retrieval._unit(got.column("v").combine_chunks()) if len(names) else ()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                for raw in batch.column("graph"):
                    graph, ids, ends = pickle.loads(raw.as_py())
                    out = []
                    for name, v in zip(names.tolist(), q, strict=True):
                        met = [(-s, i) for s, n in graph.search(v, max(width, k))[: 2 * k] for i in ids[ends[n] : min(ends[n + 1], ends[n] + k)].tolist()]
                        out += [(name, i, -s) for s, i in sorted(met)[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.string() if kind == "string" else pa.int64(), pa.float64()), strict=True)], [question_col, id_col, "similarity"])

        found = index.select("graph").mapInArrow(run, f"{question_col} long, {id_col} {kind}, similarity double")
        return found.withColumn("number", F.row_number().over(best)).where(F.col("number") <= k)

    return one(0) if parts == 1 else reduce(DataFrame.unionByName, [written(one(b), "ranked") for b in range(parts)])


def share_found(found: DataFrame, exact: DataFrame, question_col: str = "question_id", id_col: str = "chunk_id") -> float:
    """The share of exact neighbours that were found; 1 if there are none."""
    keys = [question_col, id_col]
    got = exact.join(found.select(*keys, F.lit(1).alias("hit")), keys, "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return got["hits"] / got["n"] if got["n"] else 1.0


def calibrated(index: DataFrame, corpus: DataFrame, k: int, dimension: int, recall: float = RECALL, probes: int = PROBES, id_col: str = "chunk_id", vector_col: str = "embedding") -> int:
    """The least width, of ``WIDTHS``, that finds the wanted share of the exact neighbours of ``probes`` corpus rows (those with the smallest hashes of their ids); else that of the largest shard."""
    kind = "string" if corpus.schema[id_col].dataType.simpleString() == "string" else "long"
    drawn = corpus.where(V.valid(F.col(vector_col), dimension) & F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), id_col).limit(probes)
    asked = written(drawn.select(F.monotonically_increasing_id().alias("question_id"), F.col(vector_col).alias("embedding")), "probes")
    exact = written(retrieval.top_k(asked, corpus, k, dimension, id_col=id_col, vector_col=vector_col), "exact")
    for width in WIDTHS:
        if share_found(search(index, asked, k, dimension, width, id_col=id_col, kind=kind), exact, id_col=id_col) >= recall:
            return width
    return index.agg(F.max("rows")).first()[0] or 1
