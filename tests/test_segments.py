import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import merkle, patterns
from corpusloom.shared import ordinals


def test_ordinals_without_a_task_per_key(spark):
    """One key holds half the rows, another is null; no window in the plan."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, "", "z"]), k, k % 7) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_id long, section int").repartition(6)
    out = ordinals(df, ["source"], ["doc_id"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    seen, want = {}, {}
    for source, doc_id, _ in sorted(rows, key=lambda r: r[1]):
        want[doc_id] = seen[source] = seen.get(source, -1) + 1
    assert {r["doc_id"]: r["ordinal"] for r in out.collect()} == want and out.columns == ["source", "doc_id", "section", "ordinal"]
    hot = df.withColumn("part", F.lit(1)).repartitionByRange(4, F.struct("source"), "doc_id").where("source = 'hot'").groupBy(F.spark_partition_id()).count()
    assert hot.count() > 1  # the large key does lie in several tasks
    assert ordinals(df.where("false"), ["source"], ["doc_id"]).count() == 0
    two = ordinals(df, ["source", "section"], ["doc_id"], "n").where("source IS NULL AND section = 3").orderBy("doc_id").collect()
    assert [r["n"] for r in two] == list(range(len(two))) and two


def test_many_strings_one_pass(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 4)))
    strings = [(k, word()) for k in range(60)] + [(60, "abab"), (61, "ba"), (62, "abab"), (63, None), (64, ""), (65, "🙂a")]
    texts = [(k, "".join(rng.choices("abé ", k=rng.randint(0, 30)))) for k in range(80)] + [(80, None), (81, ""), (81, ""), (82, "x🙂ab"), (83, "ab" * 200_000)]
    t = spark.createDataFrame([(*r, "c") for r in texts], "doc_id long, text string, item_id string")
    s = spark.createDataFrame([(*r, "c") for r in strings], "item_id int, text string, doc_id string")
    want = sorted((i, k) for i, x in texts if x is not None for k, y in strings if y is not None and y in x)
    for block in (40, 1 << 21):
        got = patterns.occurrences(t, s, block=block)
        assert sorted(map(tuple, got.collect())) == want and got.dtypes == [("doc_id", "bigint"), ("item_id", "int")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert patterns.occurrences(t, s.where("false")).count() == patterns.occurrences(t.where("false"), s).count() == 0
    with pytest.raises(ValueError, match="too large"):
        patterns.automaton([(k, str(k) * 3) for k in range(100)], most=10)


ROWS = [(f"c{k}", f"h{k % 50}") for k in range(400)] + [("c1", "h1")] * 3 + [("c2", "other"), (None, "h"), ("n", None), ("n", None)]
KIND = "chunk_id string, content_hash string"


def test_merkle_root_knows_no_order(spark):
    a = spark.createDataFrame(ROWS, KIND)
    roots = {tuple(merkle.root(t, leaf=leaf).first()) for leaf in (8,) for t in (a, a.repartition(7), a.orderBy(F.desc("chunk_id")).coalesce(1), a.where("chunk_id < 'c3'").union(a.where("chunk_id >= 'c3' OR chunk_id IS NULL")))}
    assert len(roots) == 1 and next(iter(roots))[0] == len(ROWS)
    for other in (ROWS[1:], [*ROWS, ("c1", "h1")], [("c0", "h1"), *ROWS[1:]], [(None, "g") if r[0] is None else r for r in ROWS], [("n", "null") if r[0] == "n" else r for r in ROWS]):
        assert tuple(merkle.root(spark.createDataFrame(other, KIND), leaf=8).first()) not in roots
    empty = merkle.root(a.where("false")).first()
    assert empty["rows"] == 0 and len(empty["digest"]) == 64
    assert (merkle.depth_for(0), merkle.depth_for(1024), merkle.depth_for(1025), merkle.depth_for(16 * 1024 + 1)) == (0, 0, 1, 2)


def test_merkle_descent_equals_the_full_join(spark):
    new = [("c5", "new") if r[0] == "c5" else r for r in ROWS if r[0] not in ("c7", None)] + [("d1", "x"), ("c1", "h1"), ("n", "set")]
    a, b = spark.createDataFrame(ROWS, KIND).repartition(3), spark.createDataFrame(new, KIND).repartition(5)
    want = {"c5": "changed", "c7": "removed", None: "removed", "d1": "added", "c1": "changed", "n": "added"}
    for leaf in (4, 1024):
        assert {r["id"]: r["change"] for r in merkle.changes(a, b, leaf=leaf).collect()} == want
    assert merkle.changes(a, a.repartition(2), leaf=4).count() == 0
    assert merkle.changes(a, a.where("false"), leaf=4).count() == len({r[0] for r in ROWS})


def test_merkle_reads_only_what_differs(spark):
    rows = [(k, f"h{k}") for k in range(4000)]
    a = spark.createDataFrame(rows, "chunk_id long, content_hash string")
    b = a.withColumn("content_hash", F.when(F.col("chunk_id") == 1234, "other").otherwise(F.col("content_hash")))
    trees = [merkle.tree(merkle.lines(t, "chunk_id", "content_hash"), 2) for t in (a, b)]
    assert 1 <= merkle.differing_leaves(*trees).count() <= 2
    assert merkle.differing_leaves(trees[0], trees[0]).count() == 0
    with pytest.raises(ValueError, match="depths"):
        merkle.differing_leaves(trees[0], merkle.tree(merkle.lines(a, "chunk_id", "content_hash"), 1))
