import numpy as np
import pytest
import xxhash

from corpusloom.llm import components, simhash


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    bits = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) > len(shingles):
            bits |= 1 << b
    return bits


def plain_groups(prints, budget):
    """id -> smallest id reachable over links."""
    group = {i: i for i in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def flipped(value, rng, most):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        value ^= 1 << int(b)
    return value


def test_fingerprints(odd, none, nothing):
    got = simhash.fingerprints(odd, 3)
    texts = {r["doc_id"]: r["text"] for r in odd.select("doc_id", "text").collect()}
    seen = {r["doc_id"]: r["fp"] % (1 << 64) for r in got.collect()}
    for i, t in texts.items():
        assert seen[i] == plain_fingerprint(t, 3)
    assert got.count() == odd.count() and simhash.fingerprints(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(nothing).first()["fp"] == 0


@pytest.mark.parametrize("block", [8, 4096])
@pytest.mark.parametrize(("budget", "segments"), [(3, 4), (5, 6)])
def test_links_keep_every_component(spark, block, budget, segments):
    rng = np.random.default_rng(budget)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    prints = [flipped(b, rng, 4) for b in base for _ in range(6)] + [flipped(base[0], rng, 2) for _ in range(80)]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").selectExpr("fp AS node", "fp")
    roots = {r["node"] % (1 << 64): r["root"] for r in components.components(simhash.linked(frame, budget, segments, block=block)).collect()}
    got: dict = {}
    for p in prints:
        got.setdefault(roots.get(p, ("alone", p)), set()).add(p)
    want: dict = {}
    for p, g in plain_groups({p: p for p in prints}, budget).items():
        want.setdefault(g, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_odd_texts(odd):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == got[5] == 3
    assert simhash.near_duplicates(odd).count() == odd.count()


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {roots[k] for k in range(201)} == {0} and roots[1001] == 1000
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_each_group_stays(spark, odd):
    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in range(3000)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(20)]
    near = [b.replace(b.split()[150], "other", 1) for b in base]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate([*base, *near, *base])], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.keep_one(docs, simhash.near_duplicate_groups(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    left = simhash.keep_one(odd, simhash.near_duplicate_groups(odd)).select("doc_id").collect()
    assert sorted(str(r[0]) for r in left) == ["1", "3", "6", "8", "9", "None"]


def plain_alike(texts, size=5):
    """id -> smallest id reachable over texts of a Jaccard similarity of 0.8 or more, and that similarity of each pair."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b}
    group = {i: i for i in texts}
    for _ in texts:
        for (a, b), s in similar.items():
            if s >= 0.8:
                group[a] = group[b] = min(group[a], group[b])
    return group, similar


def groups_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}


def test_links_are_exactly_alike(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(20):  # some words replaced: similarities around 0.8
        w = [f"word{x}" for x in rng.integers(0, 5000, 300)]
        texts[2 * k], n = " ".join(w), 3 + k % 12
        for at in np.arange(n) * 20 + 10:
            w[at] = "other"
        texts[2 * k + 1] = " ".join(w)
    want, similar = plain_alike(texts)
    near = [similar[2 * k, 2 * k + 1] for k in range(20)]
    assert sum(0.6 < s < 0.8 for s in near) >= 5 and sum(s >= 0.8 for s in near) >= 5
    got = groups_of(spark, texts)
    assert all(got[i] in (i, want[i]) for i in texts)
    # one word that repeats outweighs all else in a fingerprint
    lines = {k: " ".join(["same"] * 400 + [f"own{k}x{x}" for x in range(150)]) for k in range(4)}
    assert groups_of(spark, lines) == {k: k for k in range(4)}


@pytest.mark.parametrize("together", [4, 512])
def test_blocks_change_no_group(spark, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(4)
    base = [f"word{x}" for x in rng.integers(0, 5000, 200)]
    texts = {}
    for k in range(30):
        w = list(base)
        for at in rng.choice(200, 3 if k % 3 else 6, replace=False):
            w[at] = f"new{k}"
        texts[k] = " ".join(w)
    members = simhash._sketches(docs := spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, "doc_id", "text")
    classes = members.selectExpr("node", "doc_id AS least", "body", "size").cache()
    roots = components.components(simhash.confirmed(docs, classes, classes.selectExpr("7L AS key", "node"), 5))
    placed = {r["least"]: r["root"] for r in classes.join(roots, "node", "left").collect()}
    want, _ = plain_alike(texts)
    assert {frozenset(b for b in texts if placed[b] == placed[a] and (placed[a] is not None or a == b)) for a in texts} == {frozenset(b for b in texts if want[b] == want[a]) for a in texts}


def test_cut_and_added_blocks_are_found(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(30):
        w = [f"word{x}" for x in rng.integers(0, 5000, 80 + 15 * k)]
        cut = int(len(w) * (0.83 + 0.03 * (k % 4)))
        texts[3 * k], texts[3 * k + 1] = " ".join(w), " ".join(w[:cut])
        texts[3 * k + 2] = " ".join(w + [f"new{x}" for x in rng.integers(0, 5000, len(w) // 8)])
    want, similar = plain_alike(texts)
    assert sum(s >= 0.8 for s in similar.values()) >= 60
    assert groups_of(spark, texts) == want


def test_null_ids_are_deduplicated(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = ([f"word{x}" for x in rng.integers(0, 5000, 100)] for _ in range(4))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(None, " ".join(a)), (None, " ".join(a)), (None, near(a)), (None, " ".join(b)), (7, near(b)), (8, " ".join(c)), (8, " ".join(d)), (5, near(d)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs, simhash.near_duplicate_groups(docs)).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [5, 7, 8] and (8, " ".join(c)) in kept
    alone = [t for i, t in kept if i is None]
    assert len(alone) == 2 and len([t for t in alone if t in (" ".join(a), near(a))]) == 1


def test_hot_classes_and_clashing_names(spark, monkeypatch):
    """A third of all rows is one text; rows of hot classes are placed from a broadcast. keep_one keeps columns of any name."""
    from corpusloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 4)
    one, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(i, one if i % 3 == 0 else other if i % 3 == 1 else f"own {i} " * 9) for i in range(90)] + [(5, "own 5 " * 9)] * 3
    names = ["__text", "__place", "id", "body", "row", "slot", "doubtful", "tie", "place", "rows", "a.b"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i] == i % 3 for i in range(90) if i % 3 < 2)
    kept = simhash.keep_one(docs, simhash.near_duplicate_groups(docs))
    assert kept.columns == docs.columns
    left = [tuple(r) for r in kept.collect()]
    assert all(r[2:] == tuple(names) for r in left)
    assert {r[0] for r in left if r[1] in (one, other)} == {0, 1} and len(left) == len({r[0] for r in left})


def test_settled_steps_are_deleted(spark):
    import os

    from corpusloom.llm import common

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)], "u long, v long")
    assert components.components(edges).count() == 101
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("edges")]) == 1
