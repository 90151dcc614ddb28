"""What Python workers hold must not grow with the table: one worker a task, small batches."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import redaction
from corpusloom.plans import registry
from corpusloom.shared import BATCHES, lean

TEXTS = [None, "", " \n ", "short", "a long one. " * 300, "été &amp; " * 400, " " * 2000]


@pytest.fixture
def data(spark, tmp_path):
    for key in BATCHES:
        spark.conf.unset(key)
    rows = [(k, text, "en", "s", 0) for k, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    yield str(tmp_path)
    for key in BATCHES:
        spark.conf.unset(key)


def largest_batch(spark):
    @F.pandas_udf("long")
    def size(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    return spark.range(0, 3000, 1, 1).agg(F.max(size("id"))).first()[0]


def evaluations(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_batches_are_small_unless_set(spark, data):
    lean()
    assert largest_batch(spark) <= 512
    key = next(iter(BATCHES))
    spark.conf.set(key, "700")
    lean()
    assert spark.conf.get(key) == "700"


def test_empty_documents_splits_once_in_small_batches(spark, data):
    df = registry.queries()["empty_documents"](spark, data)
    assert evaluations(df) == 1 and largest_batch(spark) <= 512
    assert sorted(r["doc_id"] for r in df.collect()) == [0, 1, 2, 6]


def test_html_sections_parses_once_in_small_batches(spark, data):
    pages = [(1, "u", "<article><h2>A</h2><p>b</p></article>"), (2, "u", "<p>no landmark</p>"), (3, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{data}/pages.parquet")
    df = registry.queries()["html_sections"](spark, data)
    assert evaluations(df) == 1 and largest_batch(spark) <= 512
    assert [(r["page_id"], r["section"], r["heading"], r["text"]) for r in df.collect()] == [(1, 0, "A", "b")]


def test_json_redaction_visits_python_once_in_small_batches(spark, data):
    turns = [(1, 0, "user", 'mail a@b.co, "ﬁ" &amp; x'), (1, 1, None, None), (2, 0, "user", "été​ K1A 0B1")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{data}/conversations.parquet")
    df = registry.queries()["json_redaction"](spark, data)
    assert evaluations(df) == 1 and largest_batch(spark) <= 512
    got = {(r["conv_id"], r["turn"]): r["json"] for r in df.collect()}
    assert '"mail <EMAIL_ADDRESS>, \\"fi\\" & x"' in got[1, 0] and '"été <CA_POSTAL_CODE>"' in got[2, 0] and "null" in got[1, 1]
    plain = spark.createDataFrame([("ﬁ a@b.co {", "{}")], "x string, y string").select(redaction.redacted_json(F.col("x")), redaction.redacted_json(F.col("y")), redaction.redacted_json(F.lit(None).cast("string")))
    assert tuple(plain.first()) == ("fi <EMAIL_ADDRESS> {", "{}", None)


@pytest.mark.parametrize("name", ["injection_flags", "span_redaction", "chunk_documents", "per_document_counts"])
def test_texts_travel_in_small_batches(spark, data, name):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{data}/conversations.parquet")
    df = registry.queries()[name](spark, data)
    assert largest_batch(spark) <= 512
    if name != "injection_flags":  # a branch a table there
        assert evaluations(df) == 1


def test_chunks_are_the_same_rows(spark, data):
    from corpusloom.operators.chunking import split

    want = sorted((k, 0, part, text) for k, whole in enumerate(TEXTS) for part, text in enumerate(split(whole or "")))
    got = sorted((r["document_id"], r["section"], r["part"], r["text"]) for r in registry.queries()["chunk_documents"](spark, data).collect())
    assert got == want and len({r[0] for r in got}) == 3


def test_chunks_travel_in_small_batches_in_a_session_of_their_own(spark, data):
    own = spark.newSession()
    df = registry.queries()["chunk_documents"](own, data)
    assert df.sparkSession is own and largest_batch(own) <= 512 < largest_batch(spark)


def test_per_document_counts_count_every_chunk(spark, data):
    from corpusloom.operators.chunking import split

    df = registry.queries()["per_document_counts"](spark, data)
    assert evaluations(df) == 1
    assert {r["document_id"]: (r["sections"], r["chunks"]) for r in df.collect()} == {k: (1, len(split(t))) for k, t in enumerate(TEXTS) if t and t.strip()}


def test_per_document_counts_cut_in_small_batches_in_a_session_of_their_own(spark, data):
    from corpusloom.operators.chunking import split

    own = spark.newSession()
    df = registry.queries()["per_document_counts"](own, data)
    assert evaluations(df) == 1 and largest_batch(own) <= 512 < largest_batch(spark)
    assert sum(r["chunks"] for r in df.collect()) == sum(len(split(t)) for t in TEXTS if t)


def test_a_long_text_is_cut_without_holding_all_its_pieces():
    """A worker's memory for one text: its size a few times over, not an object for each character or word."""
    import tracemalloc

    from corpusloom.operators.chunking import split

    for text in ("語" * 120_000, "語 " * 60_000, "a\n" * 60_000):
        tracemalloc.start()
        try:
            parts = split(text)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 8 * len(text) and all(0 < len(p.encode()) <= 1500 for p in parts)
        assert sum(map(len, parts)) >= len(text) - 2 * len(parts)
