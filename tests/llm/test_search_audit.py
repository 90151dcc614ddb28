"""Lexical search, the filter audit and exact top-k against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from corpusloom.llm import filter_audit, lexical, threshold

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id long, text string, extra string, doc_id string, n string"


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def ranked(docs, items, k):
    """docs: (doc_id, text) rows."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, text in dict.fromkeys(items):
        if i is not None:
            asked[i].update(terms(text))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, c in held:
            n, score = sum(c.values()), 0
            for t, times in wanted.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // length)))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def collected(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÉTÉ", "日本", "a_b", "x-y"]
    docs = [(k * 7 - 60, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for k in range(150)]
    return docs + [(5, docs[3][1])] * 40 + [(None, "w1 w2"), (900, None), (901, ""), (902, "... --"), (903, "w1 " * 5000), ((1 << 62) + 3, "W1 w2 W3")]


@pytest.mark.parametrize(("window", "most"), [(8, 3), (16, 1 << 15), (8192, 10)])
def test_lexical_search(spark, corpus, window, most):
    items = [(1, "w1 W2 w2 straße"), (2, "w5 日本 été"), (2, "w6"), (3, None), (4, "--"), (None, "w1"), (1, "w1 W2 w2 straße"), (9, "unknown"), (7, " ".join(f"w{k}" for k in range(60)))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus], "doc_id long, text string, item_id string, n int").repartition(7)
    asked = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], ITEMS)
    got = collected(lexical.search(docs, asked, k=4, window=window, terms=most))
    assert got == ranked(corpus, items, 4)


def test_lexical_search_long_text_and_pieces(spark):
    text = "é" * 10 + " " + "Ab " * 800_000 + "z" * 3_000_000
    pieces = list(lexical.words(text.encode()))
    assert len(pieces) > 2 and sum(pieces, []) == [w.encode() for w in terms(text)]
    docs = spark.createDataFrame([(1, text), (2, "ab")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab")], "item_id long, text string")
    assert collected(lexical.search(docs, items)) == ranked([(1, text), (2, "ab")], [(1, "ab")], 10)


def test_lexical_search_empty(spark, odd, none, nothing):
    item = spark.createDataFrame([(1, "same words", None, None, None)], ITEMS)
    no_item = spark.createDataFrame([], ITEMS)
    for docs in (none, nothing):
        assert lexical.search(docs, item).count() == 0
    assert lexical.search(odd, no_item).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert collected(lexical.search(odd, item)) == ranked(rows, [(1, "same words")], 10)
    with pytest.raises(ValueError, match="multiple of 8"):
        lexical.search(odd, item, window=12)


def test_skipped_windows_change_nothing():
    """A window that can't pass the heap's least is left out; the heap stays what it was."""
    block = lexical.Block([(1, Counter({b"a": 1}))])
    scorer = lexical.Scorer(block, np.array([100]), 4, 40, 1, 8)
    one = np.array([1])
    scorer.add(np.array([10]), np.array([10]), np.array([0]), np.array([0]), one * 5)
    before = list(scorer.heaps[0])
    scorer.add(np.array([20]), np.array([10]), np.array([0]), np.array([0]), one)
    assert scorer.heaps[0] == before and not scorer.sums.any()


def audited(docs, labels):
    """docs: (doc_id, text, lang) rows; labels: (doc_id, quality, toxic)."""
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d}
        rows.append((lang or "", frozenset(k for k, v in fails.items() if v), d in good, d in bad))
    out, shares = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + hit
                shares[part, f] += len(hit)
                out.append([part, "".join(order), step, len(left), len(hit), redundant, sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in hit), sum(r[3] for r in hit)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark, odd):
    rng = random.Random(3)
    kinds = ["short", "many words " * 150, " ".join(f"w{k}" for k in range(300)), "LOUD " * 5, "a # b", " ".join(f"W{k}" for k in range(250)) + " | "]
    docs = [(k, rng.choice(kinds) + rng.choice(["", "", f" {k}"]), rng.choice(["en", "fr", None, ""])) for k in range(200)]
    docs += [(3, docs[3][1], "fr")] * 2 + [(None, "short", "en"), (None, None, None), (500, None, "en"), (501, None, "de"), (502, "é  x", "de"), (503, "🙂A" * 10, "de")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "x", 7, True) for d in docs], "doc_id long, text string, lang string, part string, n int, good boolean").repartition(5)
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, lang string")
    assert collected(filter_audit.audit(table, marks)) == audited(docs, labels)
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert collected(filter_audit.audit(odd, marks)) == audited(rows, labels)


def test_filter_audit_empty(spark, none, nothing):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, no_labels).count() == 0
    assert collected(filter_audit.audit(nothing, no_labels)) == audited([(None, None, None)], [])


def test_transform_is_its_own_inverse(spark):
    rows = spark.createDataFrame([("p", True, False, m, (m * m) % 11 + 1) for m in range(32)], "part string, good boolean, bad boolean, mask int, n long")
    sums = filter_audit.transformed(rows)
    assert sums.first()["sums"][0] == sum((m * m) % 11 + 1 for m in range(32))
    assert filter_audit.inverted(sums).first()["cells"] == [(m * m) % 11 + 1 for m in range(32)]


def tops(rows, every, k):
    """rows: id -> integer vector."""
    out = []
    for q, v in rows.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def whole(v):
    return tuple(math.floor(256 * x) for x in v)


@pytest.mark.parametrize(("part", "block"), [(16, 7), (4096, 2048)])
@pytest.mark.parametrize("skew", [0, 1])
def test_threshold_search(spark, part, block, skew):
    rng = np.random.default_rng(2 + skew)
    base = rng.normal(size=(400, 6)) if not skew else rng.exponential(size=(400, 6)) * np.array([50, 1, 1, 0.1, 0, 0])
    vectors = {int(k) - 30: v.astype(np.float32).astype(float).tolist() for k, v in enumerate(base)}
    vectors |= {1000 + k: vectors[0] for k in range(150)}  # a large group of copies, queries among them
    vectors |= {2000: [0.0] * 6, 2010: [-0.0] * 6, 2011: [-1.0] * 6}
    rows = [(i, v, "x", 1) for i, v in vectors.items()] + [(1000, vectors[0], "x", 1)] * 3
    rows += [(None, [1.0] * 6, "x", 1), (3000, None, "x", 1), (3010, [], "x", 1), (3020, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", 1), (3030, [float("nan")] * 6, "x", 1), (3040, [float("inf")] * 6, "x", 1), (3050, [9.0] * 5, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, part int").repartition(5)
    want = tops({i: whole(v) for i, v in vectors.items()}, 10, 5)
    assert collected(threshold.search(table, every=10, part=part, block=block)) == want


def test_threshold_stops_early():
    """Where one component rules, the lists are left long before their ends."""
    rng = np.random.default_rng(1)
    rows = np.floor(rng.exponential(size=(4096, 4)) ** 4 * [1000, 1, 1, 1]).astype(np.int64)
    lists = threshold.Lists(rows, np.arange(4096), 1000)
    read = []
    whole_best = threshold.best
    threshold.best = lambda s, i, k: (read.append(len(s)), whole_best(s, i, k))[1]
    try:
        [(scores, ids)] = lists.search(np.array([[100, 1, 1, 1]]), np.array([threshold.NONE]), 5)
    finally:
        threshold.best = whole_best
    exact = rows @ np.array([100, 1, 1, 1])
    assert sorted(exact)[-5:][::-1] == scores.tolist() and sum(read) < 1000
    assert lists.search(np.array([[100, 1, 1, 1]]), np.array([int(exact.max()) * 9]), 5)[0][0].size == 0


def test_threshold_exact_numbers():
    """Scores beyond what float and double hold stay exact."""
    for size, kind in ((1 << 8, np.float32), (1 << 20, np.float64), (1 << 29, np.int64)):
        rows = np.array([[size, size - 1], [size - 1, size], [-size, 3], [size, size]])
        lists = threshold.Lists(rows, np.arange(4), size)
        [(scores, ids)] = lists.search(np.array([[size, size - 1]]), np.array([threshold.NONE]), 4)
        want = sorted(((-int(r @ np.array([size, size - 1])), i) for i, r in enumerate(rows)))
        assert lists.kind is kind and list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_threshold_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert threshold.search(spark.createDataFrame([], kind)).count() == 0
    assert threshold.search(spark.createDataFrame([(None, None)], kind)).count() == 0
    assert collected(threshold.search(spark.createDataFrame([(50, [1.0])], kind))) == []
    two = spark.createDataFrame([(50, [1.0]), (7, [-1.0]), (7, [2.0])], kind)
    assert collected(threshold.search(two)) == [(50, 1, 7, -65536)]
    assert collected(threshold.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind))) == []
