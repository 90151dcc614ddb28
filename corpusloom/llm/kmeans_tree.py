"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree has as many storeys as the table needs. The first is fitted on a bounded,
documented sample (``SAMPLE`` vectors, those with the smallest hash of their id) and
broadcast. Under each of its leaves a subtree is fitted on the executors, on about
``UNDER`` of the leaf's vectors; a cell of it that still holds more than ``UNDER``
vectors gets a subtree of its own, and so on, so cells stay small at any size of the
table. A cell that no subtree divides, or that is still large after ``STOREYS``
storeys, stays as it is and is searched in parts. Trees are stored by node; nothing
but sizes of the first storey's leaves ever reaches the driver. Every vector is
sent down to a cell.

A query walks the first tree with a priority queue of nodes by distance to their
centres and visits leaves in that order; in each it walks the subtree in the same
way, and so on down. How many are visited at each storey is calibrated: for
``PROBES`` rows outside the first sample (of the sample where it holds all) the exact
neighbours among all rows are found by a scan in blocks, and visits widen until the
mean share of them in visited cells reaches ``recall``. A query goes on past those
numbers until what it visits at a node holds k others, or is all of it.

Equal vectors meet once: of each distinct vector only its k + 1 smallest ids can
be among anyone's k nearest, so no group of copies travels, whatever its size.
Leaves are gathered into ``GROUPS`` bins, a large bin is split by cells, and a
query comes to a bin once a leaf, with the cells it visits there; it leaves with its
k nearest. A bin that is still large, by one vast cell, is dealt out in parts and a
bin's queries in blocks, each pair worked off by itself. A query's bins merge in a
windowed top-k, pre-cut in every task.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another than the most frequent dimension, nor rows with a null
id. Repeated rows count once; of an id with several vectors each takes part. Ties
go to the smaller id. Fewer than k candidates: all of them. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

SAMPLE, UNDER, PROBES, BRANCH, RECALL, STOREYS = 16_384, 4096, 256, 8, 0.97, 12
#: A leaf of the upper tree and of a subtree is fitted on this many vectors at least, at any size of the table.
LEAF, CELL = 64, 16
#: Bins of leaves, vectors in a part of a leaf or bin, and rows of queries in a block.
GROUPS, BLOCK, ASKED = 32, 4096, 1 << 15


class Tree:
    """Centres and children of each node; a node without children is a leaf."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 11):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        rng = np.random.default_rng(seed)
        self._grow(np.unique(vectors, axis=0) if len(vectors) else vectors, leaf, branch, rng)
        self.points = np.array(self.centres)
        self.leaves = {n: k for k, n in enumerate(n for n, c in enumerate(self.children) if not c)}

    def _grow(self, v: np.ndarray, leaf: int, branch: int, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(v.mean(axis=0))
        self.children.append([])
        if len(v) < 2 * leaf:
            return node
        centres = v[rng.choice(len(v), min(branch, len(v) // leaf), replace=False)]
        for _ in range(8):
            own = ((v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1)).argmin(axis=1)
            centres = np.array([v[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        parts = [v[own == k] for k in range(len(centres)) if (own == k).any()]
        if len(parts) > 1:
            for p in parts:
                self.children[node].append(self._grow(p, leaf, branch, rng))
        return node

    def place(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node on to the nearest centre."""
        at = np.zeros(len(v), dtype=np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node] or not len(rows):
                at[rows] = self.leaves.get(node, 0)
                continue
            centres = self.points[self.children[node]]
            own = ((centres * centres).sum(1) - 2 * v[rows] @ centres.T).argmin(axis=1)
            todo += [(c, rows[own == k]) for k, c in enumerate(self.children[node])]
        return at

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        distance = np.sqrt(((self.points - q) ** 2).sum(axis=1))
        queue = [(distance[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (distance[c], c))
            else:
                yield self.leaves[node]


def _subtree(vectors: np.ndarray) -> Tree:
    """With ``held``: how many of these vectors each cell holds."""
    made = Tree(vectors, CELL)
    made.held = np.bincount(made.place(vectors), minlength=len(made.leaves))
    return made


def _blocks(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Per key with more than ``size`` rows: how many blocks they make. There are fewer such keys than rows / size."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > size).select(*keys, F.ceil(F.col("n") / size).cast("int").alias(name))


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], per_left: int, per_right: int) -> tuple[DataFrame, DataFrame]:
    """left and right with ``block`` and ``part``: within a key, blocks of left and parts of right meet pairwise."""
    blocks, parts = _blocks(left, keys, per_left, "blocks"), _blocks(right, keys, per_right, "parts")
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    own = lambda c: F.pmod(F.xxhash64("vec_id"), one(F.col(c))).cast("int")
    both = lambda d: d.join(blocks, keys, "left").join(parts, keys, "left")
    return (
        both(left).withColumn("block", own("blocks")).withColumn("part", every("parts")).drop("blocks", "parts"),
        both(right).withColumn("part", own("parts")).withColumn("block", every("blocks")).drop("blocks", "parts"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _nearest_rows(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the k nearest rows other than ``own``, ties to the smaller id."""
    near = ((vectors * vectors).sum(axis=1) - 2 * (vectors @ q)) + q @ q
    if len(ids) > k + 1:
        edge = np.partition(near, k)[k]
        rows = np.flatnonzero(near <= edge + 1e-9 * (1 + abs(edge) + q @ q))
    else:
        rows = np.arange(len(ids))
    exact = np.sqrt(((vectors[rows] - q) ** 2).sum(axis=1))
    order = np.lexsort((ids[rows], exact))
    order = order[ids[rows][order] != own][:k]
    return rows[order], exact[order]


def nearest(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest rows other than ``own``, ties to the smaller id."""
    rows, exact = _nearest_rows(q, vectors, ids, own, k)
    return ids[rows], exact


def _children(node: int, tree: Tree) -> np.ndarray:
    """The codes of a tree's cells below a node."""
    return common.mixed(common.mixed(np.array([node], dtype=np.int64).view(np.uint64)) + np.arange(len(tree.leaves), dtype=np.uint64)).view(np.int64)


def at_nodes(function: Callable[[Tree, int, pa.Table], pa.Table], asks: DataFrame, trees: DataFrame, width: int, block: int, schema: str) -> DataFrame:
    """function(subtree, node, rows) on blocks of rows of the same node. asks: ``vec_id``, ``node`` and more; read twice."""
    parts = _blocks(asks, ["node"], block, "parts")
    many = F.coalesce("parts", F.lit(1))
    left = asks.join(parts, "node", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), many).cast("int")).drop("parts")
    right = trees.join(parts, "node", "left").select("node", "tree", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        made = pickle.loads(b.column("tree")[0].as_py()) if b.num_rows else _subtree(np.zeros((1, width)))
        return function(made, key[0].as_py(), a)

    return left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInArrow(run, schema)


def subtrees(rows: DataFrame, sizes: DataFrame, width: int, under: int, storey: int) -> DataFrame:
    """node, tree for the nodes of ``sizes`` (node, size), each fitted on about ``under`` of its rows; below the second storey only where it divides them."""
    # vectors with a hash below under / size: about ``under`` of them, a few more or less
    drawn = rows.join(sizes, "node").where((F.xxhash64("vec_id", F.lit(4 + storey)) / 2.0**64 + 0.5) * F.col("size") < under)

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        made = _subtree(_matrix(t.column("v").combine_chunks(), width))
        t = t.slice(0, 1 if storey == 1 or len(made.leaves) > 1 else 0)
        return pa.table([t.column("node"), pa.array([pickle.dumps(made)] * t.num_rows, pa.binary())], ["node", "tree"])

    return common.written(drawn.select("node", "vec_id", "v").groupBy("node").applyInArrow(fit, "node long, tree binary"), "subtrees")


def grown(rows: DataFrame, sizes: DataFrame, width: int, under: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """Sends rows (vec_id, v, leaf, path, node) down until no cell of over ``under`` rows can be divided; the trees of each storey."""

    def settle(made: Tree, node: int, t: pa.Table) -> pa.Table:
        cell = made.place(_matrix(t.column("v").combine_chunks(), width)) if t.num_rows else np.zeros(0, dtype=np.int64)
        return pa.table([t.column("vec_id"), t.column("v"), t.column("leaf"), t.column("path"), pa.array(_children(node, made)[cell])], ["vec_id", "v", "leaf", "path", "node"])

    schema, storeys = "vec_id long, v array<double>, leaf int, path array<long>, node long", []
    for storey in range(1, STOREYS + 1):
        if storey > 1:
            sizes = common.written(rows.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > under), "large")
            if sizes.isEmpty():
                break
        trees = subtrees(rows, sizes, width, under, storey)
        if trees.isEmpty():
            break
        storeys.append(trees)
        moved = at_nodes(settle, rows if storey == 1 else rows.join(trees.select("node"), "node", "left_semi").select(*rows.columns), trees, width, block, schema)
        moved = moved.withColumn("path", F.concat("path", F.array("node")))
        rows = common.written(moved if storey == 1 else moved.union(rows.join(trees.select("node"), "node", "left_anti").select("vec_id", "v", "leaf", F.concat("path", F.array("node")).alias("path"), "node")), "cells")
    return rows, storeys


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id long and v array<double> of the rows that take part, each once."""
    v = F.col("v")
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    return rows


def search(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, under: int = UNDER, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: query_id, rank, vec_id, score (Euclidean)."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sized = usable(table, id_col, vector_col)
    widths = sized.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return empty
    width = widths["width"]
    rows = sized.where(F.size("v") == width)
    fitted = common.bounded_sample(rows, "vec_id", sample + probes).toArrow()
    tree = Tree(_matrix(fitted.column("v").combine_chunks().slice(0, sample), width), LEAF)
    asked_rows = fitted.slice(max(0, min(sample, fitted.num_rows - probes)))
    shared = spark.sparkContext.broadcast(tree)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(shared.value.place(_matrix(b.column("v"), width)).astype(np.int32))], ["vec_id", "v", "leaf"])

    first = Window.partitionBy("v").orderBy("vec_id")
    placed = common.map_rows(rows, place, "vec_id long, v array<double>, leaf int")
    placed = placed.groupBy("v", "vec_id").agg(F.min("leaf").alias("leaf")).withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    node = F.col("leaf").cast("long")
    placed = common.written(placed.select("vec_id", "v", "leaf", F.array(node).alias("path"), node.alias("node")), "vectors")
    sizes = np.zeros(len(tree.leaves), dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf; the sample bounds the leaves
        sizes[r["leaf"]] = r["count"]
    counts = spark.createDataFrame([(n, int(s)) for n, s in enumerate(sizes)], "node long, size long")
    stored, storeys = grown(placed, F.broadcast(counts), width, under, block)
    visits = calibrate(stored, tree, storeys, asked_rows, width, k, recall, block)
    known = spark.sparkContext.broadcast(sizes)

    def walk(b: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(b.column("v"), width)
        who, leaf = [], []
        for i in range(len(q)):
            seen = held = 0
            for n in shared.value.order(q[i]):
                if not known.value[n]:
                    continue
                if seen >= visits[0] and held > k:
                    break
                seen, held = seen + 1, held + known.value[n]
                who.append(i), leaf.append(n)
        taken = pa.array(who, pa.int64())
        return pa.RecordBatch.from_arrays([b.column("vec_id").take(taken), b.column("v").take(taken), pa.array(leaf, pa.int32()), pa.array(leaf, pa.int64())], ["vec_id", "v", "leaf", "node"])

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    asks = common.written(common.map_rows(queries, walk, "vec_id long, v array<double>, leaf int, node long"), "asks")
    visited = _descended(asks, storeys, visits, width, k, block)
    held = np.bincount(np.arange(len(sizes)) % GROUPS, weights=sizes, minlength=GROUPS)
    bins = F.array(*[F.lit(int(max(1, -(-h // block)))) for h in held])
    group = F.pmod("leaf", F.lit(GROUPS))
    bin_of = lambda code: F.pmod(F.xxhash64(code), F.get(bins, group)) * GROUPS + group
    visited = visited.withColumn("bin", F.explode(F.array_distinct(F.transform("codes", bin_of))))
    visited = common.written(visited.select("vec_id", "v", "bin", F.filter("codes", lambda c: bin_of(c) == F.col("bin")).alias("codes")), "visits")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = _scanned(visited, stored.select("vec_id", "v", F.col("node").alias("code"), bin_of(F.col("node")).alias("bin")), width, k, 4 * block, asked)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _descended(asks: DataFrame, storeys: list[DataFrame], visits: list[int], width: int, k: int, block: int) -> DataFrame:
    """asks (vec_id, v, leaf, node) sent down all storeys: vec_id, v, leaf and the codes of the cells to scan."""

    def descend(storey: int) -> Callable[[Tree, int, pa.Table], pa.Table]:
        def run(made: Tree, node: int, t: pa.Table) -> pa.Table:
            codes, children = [], _children(node, made)
            for q in _matrix(t.column("v").combine_chunks(), width) if t.num_rows else ():
                chosen, held = [], 0
                for c in made.order(q):
                    if len(chosen) >= visits[storey] and held > k:
                        break
                    held += made.held[c]
                    chosen.append(c)
                codes.append(children[chosen])
            ends = np.cumsum([0, *map(len, codes)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)))
            return pa.table([t.column("vec_id"), t.column("v"), t.column("leaf"), listed], ["vec_id", "v", "leaf", "codes"])

        return run

    done = None
    for storey, trees in enumerate(storeys, 1):
        if storey > 1:
            asks = common.written(done.select("vec_id", "v", "leaf", F.explode("codes").alias("node")), "asks")
        here = asks if storey == 1 else asks.join(trees.select("node"), "node", "left_semi").select("vec_id", "v", "leaf", "node")
        done = at_nodes(descend(storey), here, trees, width, block, "vec_id long, v array<double>, leaf int, codes array<long>")
        if storey > 1:
            done = done.union(asks.join(trees.select("node"), "node", "left_anti").select("vec_id", "v", "leaf", F.array("node").alias("codes")))
    return done


def _scanned(visited: DataFrame, stored: DataFrame, width: int, k: int, block: int, asked: int) -> DataFrame:
    """The k nearest of each query within its cells of each bin, or part of it: query_id, vec_id, score."""
    left, right = _dealt(visited, stored, ["bin"], asked, block)

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        query, ids, score = [], [], []
        if a.num_rows and b.num_rows:
            v, own, code = _matrix(b.column("v").combine_chunks(), width), b.column("vec_id").to_numpy(), b.column("code").to_numpy()
            cells, place = np.unique(code, return_inverse=True)
            q, names, first = _matrix(a.column("v").combine_chunks(), width), a.column("vec_id").to_numpy(), {}
            wanted: dict[int, list[np.ndarray]] = {}
            for i, (name, codes) in enumerate(zip(names.tolist(), a.column("codes"), strict=True)):
                first.setdefault(name, i)
                wanted.setdefault(name, []).append(codes.values.to_numpy())
            for name, lists in wanted.items():
                rows = np.flatnonzero(np.isin(cells, np.concatenate(lists))[place])
                if len(rows):
                    got, distance = nearest(q[first[name]], v[rows], own[rows], name, k)
                    query.append(np.full(len(got), name)), ids.append(got), score.append(distance)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=t))
        return pa.table([cat(query, np.int64), cat(ids, np.int64), cat(score, np.float64)], ["query_id", "vec_id", "score"])

    keys = ["bin", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")


def calibrate(stored: DataFrame, tree: Tree, storeys: list[DataFrame], asked: pa.Table, width: int, k: int, recall: float, block: int) -> list[int]:
    """The visits at each storey at which the probes' exact neighbours among all rows are found at the wanted mean rate.

    Of n storeys the first is visited up to the rank that holds the n-th root of that rate, the second up to the rank that keeps two n-ths of it, and so on.
    """
    spark = stored.sparkSession
    q, names = _matrix(asked.column("v").combine_chunks(), width), asked.column("vec_id").to_numpy()
    sent = spark.sparkContext.broadcast((q, names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        best: list[list[tuple]] = [[] for _ in names]
        for b in batches:
            v, ids = _matrix(b.column("v"), width), b.column("vec_id").to_numpy()
            for i in range(len(q)):
                rows, distance = _nearest_rows(q[i], v, ids, names[i], k)
                paths = b.column("path").take(pa.array(rows)).to_pylist()
                best[i] = sorted([*best[i], *zip(distance.tolist(), ids[rows].tolist(), paths, strict=True)])[:k]
        rows = [(i, g, d, p) for i, x in enumerate(best) for d, g, p in x]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["probe", "vec_id", "score", "path"])

    top = Window.partitionBy("probe").orderBy("score", "vec_id")
    near = stored.mapInArrow(scan, "probe long, vec_id long, score double, path array<long>").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
    truth = near.select("probe", "path").toArrow()  # probes * k rows
    if not truth.num_rows:
        return [len(tree.leaves)] + [1 << 30] * len(storeys)
    probes, paths = truth.column("probe").to_pylist(), truth.column("path").to_pylist()
    order = {i: {n: p for p, n in enumerate(tree.order(q[i]), 1)} for i in set(probes)}
    ranks = [np.array([order[i][p[0]] for i, p in zip(probes, paths, strict=True)])]

    def rank(made: Tree, node: int, t: pa.Table) -> pa.Table:
        q, children, places = sent.value[0], _children(node, made), []
        for probe, child in zip(t.column("probe").to_pylist(), t.column("child").to_pylist(), strict=True):
            places.append(next((p for p, c in enumerate(made.order(q[probe]), 1) if children[c] == child), len(children)))
        return pa.table([t.column("vec_id"), pa.array(places, pa.int64())], ["row", "place"])

    for storey, trees in enumerate(storeys, 1):
        asks = [(row, i, p[storey - 1], p[storey]) for row, (i, p) in enumerate(zip(probes, paths, strict=True)) if p[storey] != p[storey - 1]]
        asks = spark.createDataFrame(asks, "vec_id long, probe long, node long, child long")
        got = at_nodes(rank, asks, trees.join(F.broadcast(asks.select("node").distinct()), "node", "left_semi"), width, block, "row long, place long").toArrow()
        ranks.append(np.zeros(len(probes), dtype=np.int64))  # a row that stays at its node is found for sure
        ranks[-1][got.column("row").to_numpy()] = got.column("place").to_numpy()
    visits, alive = [], np.ones(len(probes), dtype=bool)
    for n, place in enumerate(ranks, 1):
        share = min(recall ** (n / len(ranks)), alive.mean())
        reach = np.sort(np.where(alive, place, 1 << 30))
        visits.append(int(reach[max(0, int(np.ceil(share * len(reach))) - 1)]))
        alive &= place <= visits[-1]
    return visits
