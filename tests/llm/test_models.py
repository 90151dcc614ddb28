import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import common, labelled, quality, toxicity, url_rules


def labelled_corpus(spark, n=600):
    rng = np.random.default_rng(2)
    words = ["stone", "river", "cloud", "garden", "window", "paper", "music", "winter"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, 40))
        bad, rude = i % 4 == 0, i % 3 == 0
        if bad:
            w = [x + "$$$" for x in w]
        if rude:
            w[5:5] = ["zorble" + str(rng.integers(0, 50)), "and", "zorble" + str(rng.integers(0, 50)), "zorbleish"]
        rows.append((i, " ".join(w) + ".", "en", "s", 1))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    return np.mean([r["predicted"] == r[column] for r in rows])


def test_quality_learns_and_holds_out(spark):
    docs, labels = labelled_corpus(spark)
    model = quality.fit(docs, labels)
    assert accuracy(quality.scored(docs, model), labels, "quality") > 0.97
    # labels of held-out rows change nothing
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = quality.fit(docs, other)
    assert np.array_equal(model.amounts, again.amounts) and model.bias == again.bias


def test_toxicity_learns_stems(spark):
    docs, labels = labelled_corpus(spark)
    grammar = toxicity.fit(docs, labels)
    assert any(t.startswith("zorb") for t in grammar.learned)
    assert accuracy(toxicity.scored(docs, grammar), labels, "toxic") > 0.97


def test_odd_rows(spark, odd, none, nothing):
    _, labels = labelled_corpus(spark, 20)
    blank = labels.where("false")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        for known in (labels, blank, labels.selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS INT) AS quality", "CAST(NULL AS INT) AS toxic")):
            model = module.fit(odd, known, column)
            got = module.scored(odd, model).collect()
            assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
            assert module.scored(none, model).count() == 0
            r = module.scored(nothing, model).first()
            assert r["doc_id"] is None and r["held_out"] is False and 0 <= r["score"] <= 1
        by_text: dict = {}
        for r, t in zip(module.scored(odd, model).collect(), odd.collect(), strict=True):
            assert by_text.setdefault(t["text"] or "", r["score"]) == r["score"]
    assert quality.fit(none, labels).score("x") == quality.fit(none, blank).score(None)


def test_held_out_is_a_crc(spark):
    got = spark.range(100).withColumn("h", labelled.held_out("id")).collect()
    assert all(r["h"] == labelled.is_held_out(r["id"]) for r in got)


def mixed(h):
    """A bijection of 64-bit integers, in plain Python."""
    m = (1 << 64) - 1
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & m
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & m
    return h ^ h >> 31


def plain_features(text):
    """Bucket counts, n-gram by n-gram; words are hashed as the module hashes a text of that word alone."""
    words = "".join(" " if ord(c) <= 32 or c == "\xa0" else c for c in text).split(" ")
    words = [w for w in words if w]
    out = []
    for w in words:
        letters = np.array([32, *map(ord, w), 32], dtype=np.uint64)
        out.append(mixed(int(common.Rolling(letters).slices(np.array([1]), np.array([len(w) + 1]))[0])) >> 48)
        marked = " " + w + " "
        for n in (2, 3, 4):
            for k in range(len(marked) - n + 1):
                h = n
                for c in marked[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) & ((1 << 64) - 1)
                out.append(mixed(h) >> 48)
    for a, b in zip(words, words[1:], strict=False):
        out += [mixed(0xA9A1) >> 48] * (quality.REPEATED if a == b else 0)
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é\xa0\t\n日x", max_size=60))
def test_features_are_all_ngrams(text):
    assert sorted(quality.features(text).tolist()) == plain_features(text)


def test_features_do_not_depend_on_pieces(monkeypatch):
    texts = [" ".join(f"word{k % 91}" for k in range(4000)), "same " * 900, "x" * 3000 + " y", " \n " * 500, "a\xa0b " * 400, ""]
    whole = [np.sort(quality.features(t)) for t in texts]
    for piece in (1, 7, 500):
        monkeypatch.setattr(quality, "_PIECE", piece)
        for t, w in zip(texts, whole, strict=True):
            assert np.array_equal(np.sort(quality.features(t)), w)


def test_sgd_is_the_plain_one():
    """The same steps with loops, from the gradient of the log loss."""
    rng = np.random.default_rng(1)
    documents, labels = [], np.array([0, 1, 1, 0, 1, 0])
    for k in range(6):
        ids = np.unique(rng.integers(0, 40, 5)).astype(np.uint16)
        documents.append((ids, np.full(len(ids), 1 / len(ids), dtype=np.float32)) if k < 5 else (ids[:0], np.zeros(0, dtype=np.float32)))
    got = quality.sgd(documents, labels, epochs=2, rate=0.1, dim=3, seed=5)
    r = np.random.default_rng(5)
    vectors = r.uniform(-1 / 3, 1 / 3, (quality.BUCKETS, 3)).astype(np.float32).astype(float)
    out = r.uniform(-1, 1, (2, 3)).astype(np.float32).astype(float)
    bias, seen_v, seen_o = np.log([0.5, 0.5]), dict.fromkeys(range(40), 1e-8), [1e-8, 1e-8]

    def loss(vecs, o, b, ids, weight, y):
        hidden = sum(w * vecs[i] for i, w in zip(ids, weight, strict=True))
        z = o @ hidden + b
        return np.log(np.exp(z).sum()) - z[y]

    for epoch in range(2):
        step = 0.1 * (1 - epoch / 2)
        for d in r.permutation(6):
            ids, weight = documents[d]
            if not len(ids):
                continue
            gradient = lambda a: _numeric(lambda: loss(vectors, out, bias, ids.tolist(), weight.astype(float), labels[d]), a)  # noqa: B023, E731
            of_out, of_bias = gradient(out), gradient(bias)
            of_vectors = {int(i): gradient(vectors[i]) for i in ids}
            for i, g in of_vectors.items():
                seen_v[i] += g @ g
                vectors[i] -= step * g / np.sqrt(seen_v[i])
            for c in range(2):
                seen_o[c] += of_out[c] @ of_out[c]
                out[c] -= step * of_out[c] / np.sqrt(seen_o[c])
            bias -= 0.1 * step * of_bias
    assert np.allclose(got.amounts[:40], (vectors[:40] @ (out[1] - out[0])), atol=2e-3)
    assert abs(got.bias - (bias[1] - bias[0])) < 2e-3


def _numeric(loss, a):
    g = np.zeros_like(a)
    for k in np.ndindex(a.shape):
        was = a[k]
        a[k] = was + 1e-5
        high = loss()
        a[k] = was - 1e-5
        g[k] = (high - loss()) / 2e-5
        a[k] = was
    return g


def test_grammar_scores_clauses():
    g = toxicity.Grammar({})
    plain = g.score("You are an idiot.")
    assert plain > 0.5 and g.score("What a fine day.") < 0.2
    assert g.score("You are not an idiot.") < plain
    assert g.score('He said "idiot" once.') < plain
    assert g.score("I will kill you.") > 0.5 and g.score("They kill time.") <= g.score("I will kill you.")
    assert g.score("Kill the process.") < 0.5
    assert g.score("") == g.score(None) < 0.2
    assert g.score("idiotic scummy words") < 0.5


def test_clauses_are_walked_once():
    """Megabytes of matching clauses, of one clause without an end, and of separators, in linear time."""
    g = toxicity.Grammar({})
    for text, n in (("you are an idiot. " * 150_000, 150_000), ("you idiot " * 250_000, 1), ("?! idiot ;\n" * 900_000, 900_000)):
        began = time.process_time()
        assert len(g.clauses(text)) == n
        assert time.process_time() - began < 20
    short = "Fine. You idiot!? no; not an idiot\nx | idiot idiot |"
    assert [c for c, _ in g.clauses(short)] == [" you idiot", " not an idiot", " idiot idiot "]


def test_url_rules_are_the_plain_rules(spark):
    rules = [(r.action, r.text) for r in url_rules.RULES]

    def plain(url):
        host, path = url_rules.parts(url)
        best = None
        for action, text in rules:
            h, slash, p = text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(text) > len(best[1])):
                best = (action, text)
        return host, path, best

    rng = np.random.default_rng(0)
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "example.org.com", "com", "x.com", "casino.net", "my-casino-x.net", "casinox.net", "EXAMPLE.Org", "", "exämple.org", "a.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/17/x", "/fr/a", "/de/", "/DE/", "//es/", "/es/é"]
    urls = [f"https://{h}{p}{e}" for h in hosts for p in paths for e in ("", "?x=/de/", "#/fr/")] + [None, "", "no scheme", "://", "a://b://c/d", "http://x.com\n/de/", "http://a\nb.example.org/es/x", "http://a\nb.org/", "http://a\n\ncasino.net/casino", "http://b.net/casino", "http://" + "a." * 100_000 + "example.org/es/"]
    urls += urls[:5]
    rng.shuffle(urls)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'c' AS host", "'c' AS token", "'c' AS rule")
    for r, u in zip(sorted(url_rules.judged(pages).collect()), urls, strict=True):
        host, path, best = plain(u)
        assert (r["host"], r["path"]) == (host, path), u
        if best:
            assert (r["verdict"], r["rule"]) == best, u
        else:
            assert r["rule"] is None
    got = {r["host"]: r["verdict"] for r in url_rules.judged(pages).collect() if r["host"].endswith(".net")}
    assert got == {"casino.net": "block", "my-casino-x.net": "block", "casinox.net": "allow", "a\n\ncasino.net": "block", "b.net": "allow"}
    nulls = spark.createDataFrame([(1, None), (1, None)], "page_id long, url string")
    assert list(map(tuple, url_rules.judged(nulls).collect())) == [(1, "", "", None, "allow")] * 2
    assert url_rules.judged(pages.where("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    index = url_rules.Index([url_rules.host_rule("block", "example.org/es/")], {"example": 90, "org": 50, "es": 3})
    assert list(index.filed) == ["es"]
    assert index.candidates("x.example.org", "/en/") == [] and index.judge("x.example.org", "/es/1") == ("example.org/es/", "block")


def test_one_negated_or_reported_clause_is_clean():
    g = toxicity.Grammar({"zorble": toxicity.INSULT})
    for text in ("He is not an idiot.", "You are not an idiot.", 'He said "idiot" once.', "She called him a moron.", "You are no zorbles.", "I will not kill you.", "I would never hurt him in the house.", 'It reads "I will kill you" there.', "Ich töte dich nicht."):
        assert g.score(text) < 0.5, text
    for text in ("He is an idiot.", "I will kill you.", "I will kill you, not her.", "I will not hurt her, I will kill you.", "He said idiot. You moron."):
        assert g.score(text) > 0.5, text


def test_only_terms_bounds_the_learned_stems(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TAKE", 1)
    rng = np.random.default_rng(9)
    stems = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(27)]
    words = ["stone", "river", "cloud", "garden", "window", "paper", "music", "winter"]
    toxic = [f"{s} {' '.join(rng.choice(words, 12))} {s} x{''.join(rng.choice(list('aeiou'), 8))}" for s in stems for _ in range(26)]
    clean = [" ".join([*rng.choice(words, 14), "".join(rng.choice(list("aeiou"), 8))]) for _ in range(3 * len(toxic))]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert all(any(s.startswith(t.rstrip("$")) for t in grammar.learned) for s in stems)
    monkeypatch.setattr(toxicity, "TERMS", 3)
    assert len(toxicity.fit(docs, labels).learned) == 3


def plain_weights(symbols, quoted):
    """What a clause's insults or threat weigh, by rules over positions."""
    T = toxicity
    kinds = [k for k, _ in symbols]
    negated = [any(x == T.NEGATION for x in kinds[max(0, k - 3) : k]) for k in range(len(kinds))]
    last_negated = bool(kinds) and kinds[-1] == T.NEGATION
    found = []
    for k, (kind, weight) in enumerate(symbols):
        if kind == T.INSULTS:
            reported = T.REPORT in kinds[:k]
            found.append(weight * (T.NEGATED if negated[k] else 1) * T.REPORTED ** (quoted + reported))
    target, threats = T.TARGET in kinds, [negated[k] for k, x in enumerate(kinds) if x == T.THREAT]
    reported = T.REPORTED if quoted or T.REPORT in kinds else 1
    if found:
        found[0] += T.TARGETED * reported if target else 0
    elif threats and target:
        found = [T.THREATENED * (T.NEGATED if all(threats) or last_negated else 1) * reported]
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.booleans())
def test_composed_automaton_is_the_plain_grammar(kinds, quoted):
    symbols = [(k, 2.5 if k == toxicity.INSULTS else 0.0) for k in kinds]
    assert np.allclose(toxicity.Machine().weigh(symbols, quoted), plain_weights(symbols, quoted))


def test_composition_is_associative():
    parts = (toxicity.NEGATION_T, toxicity.INSULT_T, toxicity.THREAT_T)
    left = toxicity.compose(toxicity.compose(parts[0], parts[1]), parts[2])
    right = toxicity.compose(parts[0], toxicity.compose(parts[1], parts[2]))
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = left.start, right.start
        for symbol in [*rng.integers(0, 7, 9).tolist(), toxicity.END]:
            (a, x, f, u), (b, y, g, v) = left.step(a, symbol), right.step(b, symbol)
            assert (x, f, u) == (y, g, v)


def test_terms_are_counted_and_weighed_plainly(spark):
    """The best stem of a round, by loops over texts."""
    docs, labels = labelled_corpus(spark)
    got = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"].lower() for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if not labelled.is_held_out(r["doc_id"])}
    by_label = [{texts[i] for i, t in known.items() if t == y} for y in (0, 1)]
    has = lambda text, term: any(w == term[:-1] if term.endswith("$") else w.startswith(term) and len(w) > len(term) for w in toxicity._WORD.findall(text))
    terms = {t for text in by_label[1] for t in toxicity.terms_of(text)[0]}
    share = len(by_label[1]) / (len(by_label[0]) + len(by_label[1]))

    def gain(term):
        a, b = (sum(has(x, term) for x in by_label[y]) for y in (1, 0))
        p = a / (a + b)
        return (a + b) * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0)) if a > 2 and p > share else 0

    best = max(terms, key=lambda t: (round(gain(t), 9), len(t)))
    assert best in got.learned and got.learned[best] == toxicity.INSULT


def test_light_stems_count_against_length():
    g = toxicity.Grammar({"zorb": 3.0}, rates={"zorb": 0.02})
    words = " ".join(f"plain{k}" for k in range(60))
    assert g.score("a zorbling day") < 0.5  # one light word
    assert g.score("zorbling " * 30) < 0.5  # and one word again and again
    assert g.score(f"a zorbling {words}. More zorblers come.") > 0.5
    assert g.score(f"a zorbling {' '.join(f'w{k}' for k in range(900))}. More zorblers come.") < 0.5
