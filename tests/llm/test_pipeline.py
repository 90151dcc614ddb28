import numpy as np
import pytest

import __spark_entry__

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(2000)]
    passage = " ".join(rng.choice(words, 70))
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, rng.integers(60, 120)))
        bad, rude = i % 9 == 4, i % 7 == 3
        if bad:
            w = [x + "###" for x in w]
        if rude:
            w[3:3] = ["idiot", "moron", "scum"]
        if i % 20 == 1 and not bad and not rude:
            w[10:10] = passage.split()
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not bad), int(rude)))
    clean = [r for r in rows if r[0] % 9 != 4 and r[0] % 7 != 3]
    rows += [(1000 + k, clean[k][1], "en", "s", 0) for k in range(10)] + [(2000, None, None, None, None)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "quality", "simhash", "substrings", "packing"]
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    rude, bad = {i for i in range(400) if i % 7 == 3}, {i for i in range(400) if i % 9 == 4}
    assert not rude & set(kept["toxicity"]) and set(range(400)) - rude <= set(kept["toxicity"])
    assert not (bad - rude) & set(kept["quality"]) and set(range(400)) - rude - bad <= set(kept["quality"])
    assert not [i for i in kept["simhash"] if 1000 <= i < 2000] and set(range(400)) - rude - bad <= set(kept["simhash"])
    shared = [i for i in kept["substrings"] if i % 20 == 1 and i < 400]
    lengths = [len(kept["substrings"][i].split()) < len(kept["simhash"][i].split()) for i in sorted(shared)]
    assert not lengths[0] and all(lengths[1:])
    pieces = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["substrings"])


def test_every_stage_is_the_plain_one(spark, folder):
    """Each stage's rows, from its own input, by loops over texts."""
    from corpusloom.llm import quality, substrings, toxicity

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}
    grammar = toxicity.fit(docs, labels)
    want = {i: t for i, t in texts(docs).items() if grammar.score(t) < 0.5}
    docs = pipeline.without_toxic(spark, docs, folder)
    assert texts(docs) == want
    model = quality.fit(docs, labels)
    want = {i: t for i, t in want.items() if model.score(t) >= 0.3}
    docs = pipeline.without_low_quality(spark, docs, folder)
    assert texts(docs) == want

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, group = {i: shingles(t) for i, t in want.items()}, {i: i for i in want}
    for a in sorted(want):
        for b in sorted(want):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    want = {i: t for i, t in want.items() if group[i] == i}
    docs = pipeline.without_near_copies(spark, docs, folder)
    assert texts(docs) == want
    words, least = {i: (t or "").encode().split() for i, t in want.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            least.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        words[i] = [x.decode() for k, x in enumerate(w) if k not in gone]
    docs = pipeline.without_repeated_passages(spark, docs, folder)
    got = docs.collect()
    assert {r["doc_id"]: (r["text"] or "").split() for r in got} == words
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    pieces = pipeline.packed(spark, docs, folder).collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(total) == set(words)
    for i, n in total.items():
        at = 0
        for start, length in sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == i):
            assert start == at
            at += length
        assert at == n


def test_odd_tables_through_every_stage(spark, odd, none, nothing, folder, tmp_path):
    clash = odd
    for name in ("__score", "__id", "__text", "__body", "__spans", "__place", "row", "slot"):
        clash = clash.selectExpr("*", f"'clash' AS {name}")
    for case, (docs, alive) in enumerate(((none, 0), (nothing, 1), (odd, 1), (clash, 1))):
        where = f"{tmp_path}/{case}"
        docs.write.parquet(f"{where}/documents.parquet")
        spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{where}/labels.parquet")
        now = docs
        for _, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, where)
            assert now.columns == docs.columns
            rows = now.collect()
            assert all(r[n] == "clash" for r in rows for n in docs.columns if n.startswith("__") or n in ("row", "slot", "score"))
        assert len(rows) <= docs.count()
        pieces = pipeline.run(spark, where).collect()
        assert (len(pieces) > 0) == bool(alive)
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}


def test_registered_once():
    assert __spark_entry__.queries()["pipeline"] and "pipeline" not in __spark_entry__.oracle_sql()
    numbers = [int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14))


def test_substring_sql_is_the_query(spark, folder):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = sorted(map(repr, c.sql(__spark_entry__.oracle_sql()["op9_substring_dedup"]).fetchall()))
    got = __spark_entry__.queries()["op9_substring_dedup"](spark, folder).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
