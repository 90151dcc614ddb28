"""The graph index against exact cosine neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph_index as G
from corpusloom.operators import retrieval

SCHEMA = "chunk_id {}, embedding array<double>"


def corpus(spark, vectors, kind="long", ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in zip(ids, vectors, strict=True)], SCHEMA.format(kind))


def asked(frame, every):
    return frame.where(F.pmod("chunk_id", F.lit(every)) == 0).withColumnRenamed("chunk_id", "question_id")


def listed(frame):
    return [tuple(r) for r in frame.orderBy("question_id", "number").select("question_id", "chunk_id", "number").collect()]


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_calibrated_recall(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    c = corpus(spark, centres[rng.integers(0, 25, 1500)] + spread * rng.normal(size=(1500, 16)))
    index = G.build(c, 16, shard=400)
    width = G.calibrated(index, c, 8, 16)
    found = G.search(index, asked(c, 30), 8, 16, width, block=20)
    exact = retrieval.top_k(asked(c, 30), c, 8, 16)
    assert index.count() == 4 and index.agg(F.sum("rows")).first()[0] == 1500 and found.count() == 400
    assert G.share_found(found, exact) >= 0.95
    both = found.join(exact.withColumnRenamed("similarity", "s"), ["question_id", "chunk_id"])
    assert both.where(F.abs(F.col("similarity") - F.col("s")) > 1e-12).isEmpty()


def test_whole_width_is_exact(spark):
    rng = np.random.default_rng(4)
    c = corpus(spark, rng.normal(size=(300, 6)))
    assert listed(G.search(G.build(c, 6, shard=100), asked(c, 20), 5, 6, 300)) == listed(retrieval.top_k(asked(c, 20), c, 5, 6))


def test_every_node_is_reached():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8))
    graph = G.Graph(v / np.linalg.norm(v, axis=1)[:, None])
    assert sum(graph.search(q, 24)[0][1] == n for n, q in enumerate(graph.unit)) >= 597
    assert all(len(x) <= G.LINKS * (1 if at else 2) for near in graph.near for at, x in enumerate(near))


def test_copies_ties_and_odd_vectors(spark):
    """A third of the rows is one vector: its smallest ids win, in every shard."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 6))
    v[:200] = v[0]
    c = corpus(spark, v)
    got = listed(G.search(G.build(c, 6, shard=150), asked(c, 100), 4, 6, 64))
    assert [r for r in got if r[0] in (0, 100)] == [(q, i, i + 1) for q in (0, 100) for i in range(4)]
    odd = corpus(spark, [None, [0.0] * 3, [1.0, float("nan"), 0.0], [1.0, 2.0], [1.0, 0, 0], [2.0, 0, 0], [0, 1.0, 0]], "string", list("abcdefg"))
    odd = odd.union(odd.where("chunk_id = 'g'")).selectExpr("*", "1 AS shard", "2 AS v", "3 AS c")
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0]), (2, None)], "question_id long, embedding array<double>")
    index = G.build(odd, 3)
    assert listed(G.search(index, q, 9, 3, 16, kind="string")) == [(1, "e", 1), (1, "f", 2), (1, "g", 3), (1, "g", 4)]
    none = odd.where("false")
    assert G.build(none, 3).count() == 0 and G.search(G.build(none, 3), q, 2, 3, 16, kind="string").count() == 0 and G.calibrated(G.build(none, 3), none, 2, 3) == 16
