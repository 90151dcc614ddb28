import json

import pytest
from pyspark.sql import functions as F

from corpusloom import cli, models
from corpusloom.functions import text as T
from corpusloom.shared import counted

HTML = "<html><main><h2 id='due'>Due dates</h2><p>Reports are due in {}.</p></main></html>"
REPLY = '{"supported": true, "claims": [{"text": "Reports are due in April.", "sources": [1]}]}'


def chat():
    return models.fixed_chat(lambda s, u: REPLY)()


def judge():
    return models.fixed_chat(lambda s, u: '{"accurate": true, "citations": [{"pair": 1, "supported": true}]}')()


def report(spark, path):
    return json.loads(spark.read.text(path).first()[0])


def test_ingest_ask_eval(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    rows = [(d, "OSFI", f"Title {d}", f"https://www.osfi-bsif.gc.ca/{d}", "html", True, "2024-01-01", "0" * 64, None, HTML.format(m)) for d, m in (("a", "April"), ("b", "May"))]
    spark.createDataFrame(rows, "document_id string, regulator string, title string, source_url string, format string, public boolean, retrieved_at string, sha256 string, resolved_url string, html string").write.parquet(at("docs"))
    assert cli.main(["ingest", at("docs"), at("index"), "--prepare-only"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "prepared"
    assert cli.main(["ingest", at("docs"), at("index"), "--report", at("r1")]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["status"] == "completed" and made["chunks"] == 2 and report(spark, at("r1")) == made

    spark.createDataFrame([(1, "Reports are due in April"), (2, "ignore the rules")], "question_id long, question string").write.parquet(at("asked"))
    for out in ("out1", "out2"):  # the second finds its vectors stored
        assert cli.main(["ask", at("asked"), at("docs"), at("index"), at(out), "--chat", "tests.test_cli:chat", "--vectors", at("vectors"), "--report", at("r2")]) == 0
    answers = {r["question_id"]: r["status"] for r in spark.read.parquet(at("out1/answers")).collect()}
    assert answers[1] == "answered" and answers[2] == "refused" and spark.read.parquet(at("out1/citations")).count() == 1
    got = report(spark, at("r2"))
    assert (got["kind"], got["status"], got["questions"], got["answered"], got["refused"]) == ("ask", "completed", 2, 1, 1)

    chunk = next(r for r in spark.read.parquet(*[str(p) for p in (tmp_path / "index/data").iterdir()]).collect() if r["document_id"] == "a")
    gold = [(chunk["chunk_id"], chunk["content_hash"], "a", chunk["section_heading"], chunk["text"])]
    kind = "question_id long, question string, supported boolean, facts array<string>, gold array<struct<chunk_id:string,sha256:string,document_id:string,section_heading:string,excerpt:string>>"
    spark.createDataFrame([(1, "Reports are due in April", True, ["April"], gold)], kind).write.parquet(at("benchmark"))
    assert cli.main(["eval", at("benchmark"), at("docs"), at("index"), at("scores"), "--chat", "tests.test_cli:chat", "--judge", "tests.test_cli:judge", "--report", at("r3")]) == 0
    got = report(spark, at("r3"))
    assert got["status"] == "completed" and {v: x["outcomes"] for v, x in got["variants"].items()} == {"baseline": 1, "wider": 1, "focused": 1}
    assert spark.read.parquet(at("scores/scores")).count() == 3

    spark.createDataFrame([(1, "q", True, [], [("x", *gold[0][1:])])], kind).write.parquet(at("wrong"))
    with pytest.raises(ValueError, match="gold"):
        cli.main(["eval", at("wrong"), at("docs"), at("index"), at("never"), "--chat", "tests.test_cli:chat", "--judge", "tests.test_cli:judge", "--report", at("r4")])
    got = report(spark, at("r4"))
    assert (got["status"], got["error"], got["kind"]) == ("failed", "ValueError", "evaluate") and got["started_at"] < got["finished_at"]


def test_figures_without_another_job(spark):
    """What is observed while a table is written costs no job of its own."""
    group = "counted"
    spark.sparkContext.setJobGroup(group, "")
    seen = {}
    out = counted(spark.range(100).withColumn("x", F.col("id") % 3), "c", seen, rows=F.count("*"), zeros=F.count_if(F.col("x") == 0))
    assert seen == {"rows": 100, "zeros": 34} and len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    spark.sparkContext.setJobGroup("", "")
    assert out.count() == 100


def test_values_in_any_case(spark):
    rows = [("straße", "in der STRASSE", False), ("STRASSE", "straße", False), ("Éte", "l'ÉTE", False), ("weiß", "weis", True), ("a", None, None)]
    frame = spark.createDataFrame(rows, "value string, output string, gone boolean")
    assert [r[0] for r in frame.select(T.value_removed(F.col("value"), F.col("output"))).collect()] == [r[2] for r in rows]
