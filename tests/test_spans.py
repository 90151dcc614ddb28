"""Personal data as scored spans: places, scores, conflicts and exemptions against plain versions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import spans
from corpusloom.operators import chunking


def plainly(found):
    """The best of all that is left, again and again."""
    kept, rest = set(), set(range(len(found)))
    while rest:
        best = min(rest, key=lambda k: (-found[k][3], -(found[k][2] - found[k][1]), found[k][1], found[k][0]))
        kept.add(best)
        rest = {k for k in rest - {best} if found[k][2] <= found[best][1] or found[k][1] >= found[best][2]}
    return [k in kept for k in range(len(found))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 30), st.integers(1, 9), st.sampled_from([0.5, 0.7, 1.0])), max_size=25, unique=True))
def test_conflicts_are_settled_as_one_by_one(drawn):
    found = sorted({(e, a, a + n, s) for e, a, n, s in drawn})
    assert spans.settle(found) == plainly(found)


def rows(spark, texts, **options):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").repartition(3)
    return {r["id"]: r["r"] for r in df.select("id", spans.found(F.col("text"), **options).alias("r")).collect()}


def test_higher_score_then_longer_and_no_tag_is_read_again(spark):
    texts = [
        "call 416-555-0123@h.example.org now",  # the phone lies inside an address
        "me@10.2.3.4.example.org or 10.2.3.4",
        "card 4111 1111 1111 1111, id 123-456-789",
        "section 1.2.3.4 and 1.2.3.4, Paragraphs: 10.0.0.1",
        "\U0001f600 é 416-555-0123\n\n416.555.0199",
        "a@b.ca416-555-0123",
    ]
    got = rows(spark, texts)
    assert [got[k]["text"] for k in range(5)] == [
        "call <EMAIL_ADDRESS> now",
        "<EMAIL_ADDRESS> or <IP_ADDRESS>",
        "card <CREDIT_CARD>, id <CA_SIN>",
        "section 1.2.3.4 and <IP_ADDRESS>, Paragraphs: 10.0.0.1",
        "\U0001f600 é <PHONE_NUMBER>\n\n<PHONE_NUMBER>",
    ]
    assert [(s["entity"], s["kept"]) for s in got[0]["spans"]] == [("PHONE_NUMBER", False), ("EMAIL_ADDRESS", True)]
    for k, text in enumerate(texts):
        for s in got[k]["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(text)
    assert texts[4][got[4]["spans"][0]["start"] : got[4]["spans"][0]["end"]] == "416-555-0123"


def test_odd_texts_and_thresholds(spark):
    many = " ".join(f"user{k}@example.org 10.0.{k % 250}.7" for k in range(20_000))  # a long text with 40,000 finds
    got = rows(spark, [None, "", "\n", "plain", many, "10.1.2.3", "10.1.2.3"])
    assert got[0]["text"] is None and not got[0]["spans"]
    assert [got[k]["text"] for k in (1, 2, 3, 5, 6)] == ["", "\n", "plain", "<IP_ADDRESS>", "<IP_ADDRESS>"]
    assert got[4]["text"] == re.sub(r"user\d+@example.org", "<EMAIL_ADDRESS>", re.sub(r"10\.0\.\d+\.7", "<IP_ADDRESS>", many)) and len(got[4]["spans"]) == 40_000
    assert rows(spark, ["10.1.2.3 a@b.ca"], threshold=0.65)[0]["text"] == "10.1.2.3 <EMAIL_ADDRESS>"
    empty = spark.createDataFrame([], "id int, text string, spans int, start int")
    assert spans.span_rows(empty, "text", "id").count() == 0


def test_policy_has_the_shape_of_the_steps(spark):
    df = spark.createDataFrame([("DOB: 1990-01-02, account: 123 456 789, K1A 0B1, a@b.ca",), (None,), ("nothing",)], "text string")
    got = df.select(spans.policy(F.col("text"), spans.QUERY).alias("r")).collect()
    assert got[0]["r"]["text"] == "DOB: <DATE_OF_BIRTH>, account: <BANK_ACCOUNT>, <CA_POSTAL_CODE>, <EMAIL_ADDRESS>"
    assert got[0]["r"]["counts"] == {"DATE_OF_BIRTH": 1, "BANK_ACCOUNT": 1, "CA_POSTAL_CODE": 1, "EMAIL_ADDRESS": 1}
    assert got[1]["r"]["text"] is None and got[1]["r"]["counts"] == {} and got[2]["r"]["counts"] == {}


def test_chunks_redacted_by_spans(spark):
    chunks = spark.createDataFrame([("T", "S", "mail 416-555-0123@h.example.org")], "document_title string, section_heading string, text string")
    r = chunking.prepared(chunks, how=spans.policy).first()
    assert r["text"] == "mail <EMAIL_ADDRESS>" and "<EMAIL_ADDRESS>" in r["prompt"] and r["redactions"] == {"EMAIL_ADDRESS": 1}
