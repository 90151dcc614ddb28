import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import common, substrings


def plain(rows, length):
    """(id, text) -> list of (id, n words, n removed, kept words)."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def corpus(seed, documents=40, vocabulary=6):
    """Texts made of shared passages with edits, over few words, so that seeds recur in many contexts."""
    rng = np.random.default_rng(seed)
    passages = [list(rng.integers(0, 400, rng.integers(20, 160))) for _ in range(8)]
    rows = []
    for i in range(documents):
        w: list = []
        for _ in range(rng.integers(0, 6)):
            p = list(passages[rng.integers(0, len(passages))])
            if rng.random() < 0.5 and p:
                p[rng.integers(0, len(p))] = 999
            w += p[rng.integers(0, 5) :] if rng.random() < 0.5 else p
            w += list(rng.integers(0, vocabulary, rng.integers(0, 40)))
        rows.append((i, " ".join(f"v{x}" for x in w)))
    return [*rows, (documents, "z " * 300), (documents + 1, "z " * 200), (3, rows[3][1]), (documents + 2, None), (documents + 3, "")]


def test_equal_to_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(tuple(r) for r in substrings.removed_digests(docs).collect())
        assert got == plain(rows, 50)
        got = sorted(tuple(r) for r in substrings.removed_digests(docs, length=12, seed=5).collect())
        assert got == plain(rows, 12)


def test_hot_keys_bundles_and_batches(spark, monkeypatch):
    """One line in every document and one passage in changing surroundings: hot keys, many bundles and batches, the same result."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT", 1000)
    monkeypatch.setattr(substrings, "BUNDLE", 4)
    monkeypatch.setattr(substrings, "WINDOWS", 150)
    line, passage = " ".join(f"l{k}" for k in range(70)), " ".join(f"p{k}" for k in range(50))
    rows = [(i, f"a{i} {line} b{i} c{i} {passage} d{i} " + "e " * (i % 90)) for i in range(600)] + [(i, line) for i in range(600, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = []
    kept = common.spread_join
    monkeypatch.setattr(common, "spread_join", lambda *a: asked.append(a[3] is not None) or kept(*a))
    assert sorted(tuple(r) for r in substrings.removed_digests(docs).collect()) == plain(rows, 50)
    assert asked == [True, True]


def test_long_words_do_not_collide():
    """Words that a polynomial hash modulo 2 ** 64 can't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(1 << 12)]
    one, other = bytes(97 + b for b in bits), bytes(98 - b for b in bits)
    a, b = common.word_hashes(one + b" " + other).tolist()
    assert a != b


def test_odd_rows(spark, odd, none, nothing):
    assert substrings.removed_digests(odd).count() == odd.count()
    assert substrings.removed_digests(none).count() == 0
    assert tuple(substrings.removed_digests(nothing).first()) == (None, 0, 0, hashlib.sha256(b"").hexdigest())
    cut = substrings.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    passage = " ".join(f"p{k}" for k in range(60))
    names = ["__id", "__text", "__body", "__spans", "row", "rest", "id", "body", "spans", "maybe", "changed", "none", "a.b"]
    docs = spark.createDataFrame([(1, passage, *names), (2, f"x {passage} y", *names), (3, None, *names), (2, f"x {passage} y", *names)], ["doc_id", "text", *names])
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, passage, *names), (2, "x y", *names), (3, None, *names), (2, "x y", *names)], key=str)
    assert substrings.without_repeats(none).count() == 0


def test_texts_are_cut_in_place(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"first\t{passage} end"), (2, f"second,\n\n{passage}  and the rest\n")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}
    assert got == {1: f"first\t{passage} end", 2: "second,\n\nand the rest\n"}
    assert [(r["start"], r["end"]) for r in substrings.repeats(docs).first()["spans"]] == [(1, 61)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_words_are_hashed_apart(data):
    assert len(common.word_hashes(data)) == len(data.split())
    by_word = dict(zip(data.split(), common.word_hashes(data).tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 20))
def test_window_minima(values, width):
    v = np.array(values, dtype=np.uint64)
    if len(v) >= width:
        want = [k + int(np.argmin(v[k : k + width])) for k in range(len(v) - width + 1)]
        assert substrings._leftmost_least(v, width).tolist() == want
