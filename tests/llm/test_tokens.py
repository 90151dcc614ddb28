import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, common, token_counts, tokenizer

TEXTS = ["", "a", "Don't we'LL 'sx", "  a\x1c b \r\n\r\n c   ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "日本語 テスト 123½²", "é" * 300, "a" * 3000, " " * 2000 + "x", "🙂🙂 ok", "ǅ Ⅷ ٣ ́"]


def reference(text):
    return tokenizer.library().encode(text, add_special_tokens=False).ids


def test_ranked_and_tree_ids_are_the_librarys():
    tree = bpe.Encoder().encode_batch(TEXTS)
    for text, ids in zip(TEXTS, tree, strict=True):
        want = reference(text)
        assert tokenizer.encode(text) == want
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert bpe.encoder().decode(ids) == tokenizer.library().decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    want = reference(text)
    assert tokenizer.encode(text) == want
    assert np.frombuffer(bpe.encoder().encode_batch([text])[0], "<u4").tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'ll", "'", "’", "a", "É", "3", "½", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\u2003", ".", "_", "日", "\u0301", "<|never|>", "<|endoftext|>"]), max_size=24))
def test_arrays_hold_the_librarys_ids(parts):
    text = "".join(parts)
    ids = tokenizer.encode_array(text)
    assert ids.dtype == np.uint32
    assert ids.tolist() == reference(text)


def test_pattern_of_the_ranked_encoder_looks_nowhere_ahead():
    """Runs of spaces are cut before it, so that no word needs a look at what follows."""
    assert "(?" not in tokenizer._ranked(tokenizer.DEFAULT)._pat_str
    for text in (" " * 300_000 + "x", "a\n\n b  \n" * 20_000, "\t\t", " \x1c x \x1c  \x1d", "x \n\n"):
        assert tokenizer.encode(text) == reference(text)


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_one_tree_equals_naive_merging(word):
    e = bpe.encoder()
    ids = [e.vocabulary.byte_ids[b] for b in word]
    while True:
        ranked = [(e.vocabulary.merges[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in e.vocabulary.merges]
        if not ranked:
            break
        (_, merged), k = min(ranked, key=lambda x: (x[0][0], x[1]))
        ids[k : k + 2] = [merged]
    assert e.encode_word(word) == ids
    assert np.frombuffer(e.encode_words([word])[0], "<u4").tolist() == ids


def test_other_files_are_refused(tmp_path):
    with open(tokenizer.path_of()) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not a plain byte-level BPE file"):
            tokenizer.Vocabulary(str(path))


def test_hot_digests(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = ["one text again"] * 40 + [None, ""] * 4 + [f"text {k}" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' AS digest", "1 AS rows", "2 AS n_tokens")
    for _ in range(2):  # the second time from the cache
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, f"{tmp_path}/cache").collect()}
        assert got == {i: len(reference(t or "")) for i, t in enumerate(texts)}


def test_malformed_ids_decode_with_replacement():
    e = bpe.encoder()
    half = [i for i, b in e.vocabulary.token_bytes.items() if b == b"\xc3"]
    assert e.decode(np.array(half)) == tokenizer.library().decode(half, skip_special_tokens=False)


def test_digests_per_row(odd, none, nothing):
    rows = odd.select("doc_id", "text").collect()
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.bpe_digests(odd).collect()}
    for r in rows:
        ids = reference(r["text"] or "")
        key = (r["doc_id"], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.bpe_digests(odd).count() == len(rows)
    assert bpe.bpe_digests(none).count() == 0
    assert bpe.bpe_digests(nothing).first()["n_tokens"] == 0
    assert {r["doc_id"]: len(r["ids"]) for r in bpe.bpe_ids(odd).collect()}[8] == len(reference(rows[8]["text"]))


def test_counts_and_cache(spark, odd, none, nothing):
    path = common.scratch(spark, "cache")
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(reference(r["text"] or ""))) for r in rows)
    for _ in range(2):
        got = token_counts.token_counts(odd, path).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    stored = token_counts.open_cache(spark, path)
    assert stored.count() == len({r["text"] or "" for r in rows})  # distinct texts, once
    assert token_counts.misses(odd, stored).count() == 0
    assert token_counts.token_counts(none, common.scratch(spark, "cache")).count() == 0
    assert token_counts.token_counts(nothing, path).first()["n_tokens"] == 0


def test_cache_of_another_tokenizer_is_not_used(spark, odd):
    path = common.scratch(spark, "cache")
    token_counts.open_cache(spark, path)
    spark.sql("SELECT 'other' AS tokenizer, unhex(sha2('a', 256)) AS digest, 99L AS n_tokens").write.mode("append").parquet(path)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert token_counts.token_counts(docs, path).first()["n_tokens"] == 1
