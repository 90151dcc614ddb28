import numpy as np

from corpusloom.llm import kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    rows = [(int(i), [None if x is None else float(x) for x in v] if v is not None else None, 0) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, ids, k):
    v = np.array(vectors, dtype=np.float32).astype(np.float64)
    out = {}
    for q, i in zip(v, ids, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((v - q) ** 2).sum(axis=1))
            out[i] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def results(frame):
    out: dict = {}
    for r in frame.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    got, want = results(kmeans_tree.search(table(spark, vectors), sample=1024, block=64)), plain(vectors, np.arange(3000), 10)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    exact = vectors.astype(np.float64)
    for q, rows in got.items():
        assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (r[1], r[0]))
        for i, s in rows:
            assert abs(s - np.sqrt(((exact[q] - exact[i]) ** 2).sum())) < 1e-12


def test_copies_and_ties(spark):
    """A third of all rows is one vector; the smallest ids of it win."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[:200] = vectors[0]
    got, want = results(kmeans_tree.search(table(spark, vectors), block=32)), plain(vectors, np.arange(600), 10)
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[100]] == list(range(10))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_odd_vectors(spark):
    bad = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1.0, 2.0]]
    good = [[1.0, 0, 0, 0], [0.9, 0.1, 0, 0], [0, 1.0, 0, 0], [0, 1.0, 0, 0]]
    frame = table(spark, bad + good, [100 * k for k in range(7)] + [700, 701, 702, 800]).selectExpr("*", "'c' AS v", "1 AS leaf", "2 AS part", "3 AS score")
    frame = frame.union(frame)  # repeated rows count once
    got = results(kmeans_tree.search(frame))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {700: [701, 702, 800], 800: [702, 701, 700]}
    assert kmeans_tree.search(frame.where("false")).count() == 0
    assert kmeans_tree.search(table(spark, [[1.0, 2.0]], [100])).count() == 0
    assert kmeans_tree.search(table(spark, bad)).where("query_id <> 600").count() == 0


def test_more_rows_than_are_fitted(spark):
    """Leaves and cells far above their bounds are dealt out; every query has k others however few cells it visits."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(4000, 6)).astype(np.float32)
    got = results(kmeans_tree.search(table(spark, vectors), sample=256, under=64, probes=20, recall=0.9, block=50, asked=3, every=40))
    want = {int(q): set(np.lexsort((np.arange(4000), np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))))[1:11].tolist()) for q in range(0, 4000, 40)}
    assert set(got) == set(want) and all(len(r) == 10 for r in got.values())
    assert sum(len({i for i, _ in got[q]} & want[q]) for q in want) >= 0.8 * 10 * len(want)
    few = results(kmeans_tree.search(table(spark, vectors[:400]), recall=0.0, every=7))
    assert all(len(r) == 10 for r in few.values())


def test_cells_stay_small_at_any_size(spark):
    """Storeys are added until no cell holds more than it may; a tenth of the rows in one dense spot are divided as well."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(6000, 4))
    vectors[:600] = 5 + 1e-3 * rng.normal(size=(600, 4))
    rows = spark.createDataFrame([(i, v.tolist(), 0, [0], 0) for i, v in enumerate(vectors)], "vec_id long, v array<double>, leaf int, path array<long>, node long")
    sizes = spark.createDataFrame([(0, 6000)], "node long, size long")
    stored, storeys = kmeans_tree.grown(rows, sizes, 4, 80, 500)
    got = stored.toPandas()
    assert len(storeys) > 3 and sorted(got.vec_id) == list(range(6000)) and got.groupby("node").size().max() <= 80
    assert all(len(p) == len(storeys) + 1 and p[-1] == n for p, n in zip(got.path, got.node, strict=True))
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0], 0, [0], 0) for i in range(300)], rows.schema)  # nothing to divide
    stored, storeys = kmeans_tree.grown(same, sizes, 4, 80, 500)
    assert len(storeys) == 1 and stored.count() == 300 and stored.select("node").distinct().count() == 1


def test_walk_order_is_best_bin_first():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2000, 4))
    tree = kmeans_tree.Tree(v)
    order = list(tree.order(v[0]))
    assert sorted(order) == list(range(len(tree.leaves))) and len(order) > 20
    assert tree.place(v[:1])[0] in order[:3]
