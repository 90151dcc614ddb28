import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import models
from corpusloom.operators import retrieval
from corpusloom.operators.question_vectors import QuestionVectors
from corpusloom.operators.snapshots import SnapshotTable

IDENTITY = {"backend": "local", "model": "hash", "dimension": 4, "fingerprint": "f"}
ROWS = [(1, "one"), (2, "two"), (3, "one"), (4, None), (5, ""), (6, "mail bob@example.com"), (7, "mail eve@example.org")]


def asked(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, question string, model string, vector string")


def cached(frame):
    return {r["id"]: r["from_cache"] for r in frame.collect()}


def test_stored_vectors(spark, tmp_path):
    known = QuestionVectors(spark, str(tmp_path / "v"), IDENTITY, "m1", buckets=2)
    first = known.embedded(asked(spark), models.hashed_embedder(4))
    assert cached(first) == {1: False, 2: False, 3: False, 4: None, 5: False, 6: False, 7: False}
    got = {r["id"]: r["embedding"] for r in first.collect()}
    assert got[1] == got[3] and got[4] is None and got[6] == got[7]  # the model saw no address
    assert known.table.rows().count() == 5
    assert set(cached(known.embedded(asked(spark), models.hashed_embedder(4))).values()) == {True, None}
    assert known.table.versions() == [0, 1]  # nothing new, no commit
    assert cached(known.embedded(asked(spark, [(1, "one"), (9, "nine")]), models.hashed_embedder(4))) == {1: True, 9: False}
    assert set(cached(known.embedded(asked(spark, ROWS[:2]), models.hashed_embedder(4), refresh=True)).values()) == {False}
    assert known.embedded(asked(spark).where("false"), models.hashed_embedder(4)).count() == 0


@pytest.mark.parametrize("change", [{"fingerprint": "g"}, {"backend": "other"}, {"model": "x"}, {"provider": "m2"}, {"policy": "none"}])
def test_another_identity_is_another_key(spark, tmp_path, change):
    keys = []
    for c in ({}, change):
        q = QuestionVectors(spark, str(tmp_path), {**IDENTITY, **{k: v for k, v in c.items() if k in IDENTITY}}, c.get("provider", "m1"), c.get("policy", "query"))
        keys.append(spark.range(1).select(q.key(F.lit("one"))).first()[0])
    assert keys[0] != keys[1]


def test_bad_entries_are_replaced(spark, tmp_path):
    known = QuestionVectors(spark, str(tmp_path / "v"), IDENTITY, "m1", buckets=2)
    bad = {"zero": ("m1", [0.0] * 4), "short": ("m1", [1.0]), "nan": ("m1", [float("nan")] * 4), "model": ("m0", [1.0] * 4), "null": ("m1", None), "good": ("m1", [0.5] * 4)}
    rows = spark.createDataFrame([(q, *v) for q, v in bad.items()], "question string, model string, vector array<float>")
    known.table.change(rows.select(known.key(F.col("question")).alias("vector_key"), "model", "vector"))
    questions = asked(spark, list(enumerate(bad)))
    assert cached(known.embedded(questions, models.hashed_embedder(4))) == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}
    assert set(cached(known.embedded(questions, models.hashed_embedder(4))).values()) == {True}


def test_two_writers_settle(spark, tmp_path, monkeypatch):
    one, two = (QuestionVectors(spark, str(tmp_path / "v"), IDENTITY, "m1", buckets=2) for _ in range(2))
    step, met = SnapshotTable._next, []

    def late(self, now, new, keep):
        made = step(self, now, new, keep)
        if self is one.table and not met:
            met.append(1)
            two.embedded(asked(spark, [(8, "eight"), (1, "one")]), models.hashed_embedder(4))
        return made

    monkeypatch.setattr(SnapshotTable, "_next", late)
    one.embedded(asked(spark, [(1, "one"), (2, "two")]), models.hashed_embedder(4))
    assert met and one.table.rows().count() == 3
    assert set(cached(two.embedded(asked(spark, [(1, "one"), (2, "two"), (8, "eight")]), models.hashed_embedder(4))).values()) == {True}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_top_k_in_blocks_and_with_any_ids(spark, kind):
    """Ties go to the smaller id, as numbers or as texts, in one scan and in blocks."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, size=(300, 3)).astype(float)  # many equal directions
    names = [k * 7 % 300 for k in range(300)] if kind == "long" else [f"c{k * 7 % 300}" for k in range(300)]
    random.Random(1).shuffle(names)
    corpus = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vectors, strict=True)], f"chunk_id {kind}, embedding array<double>").repartition(3)
    questions = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors[:40])], "question_id long, embedding array<double>")
    valid = [(n, v / np.linalg.norm(v)) for n, v in zip(names, vectors, strict=True) if v.any()]
    want = set()
    for k, v in enumerate(vectors[:40]):
        if v.any():
            u = v / np.linalg.norm(v)
            ranked = sorted((-round(float(u @ w), 9), n) for n, w in valid)[:7]
            want |= {(k, n, r) for r, (_, n) in enumerate(ranked, 1)}
    for block in (4096, 9):
        got = {(r["question_id"], r["chunk_id"], r["number"]) for r in retrieval.top_k(questions, corpus, 7, 3, block=block).collect()}
        assert len(got) == len(want)
        close = lambda rows: sorted((q, n) for q, _, n in rows)
        assert close(got) == close(want)
        assert len(got & want) >= 0.9 * len(want)  # equal directions of other lengths may differ in the last bit
    few = retrieval.top_k(questions, corpus.limit(4), 7, 3)
    assert few.groupBy("question_id").count().agg(F.max("count")).first()[0] <= 4
    assert retrieval.top_k(questions.where("false"), corpus, 7, 3).count() == 0
