import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunking, sections
from corpusloom.shared import Settings, numbered, table_name
from corpusloom.sources import fetch, files, logs, manifest

PAGE = """<html><nav>Skip</nav><main><header>no</header><h1 id="top">Rules</h1><h2 id="gov">Governance</h2><p>First&nbsp;part.</p>
<ul><li>Item <p>inner</p></li></ul><div id="box"><h2>Review</h2></div><table><tr><td>a</td><td>b</td></tr></table><script>x</script><p class="toc">no</p><footer>no</footer></main></html>"""


def test_sections_of_a_page():
    assert sections.parse(PAGE) == [
        {"heading": "Governance", "text": "First part.\n\nItem inner", "anchor": "gov", "page": None},
        {"heading": "Review", "text": "a b", "anchor": "box", "page": None},
    ]
    assert sections.parse("<main><p>x</p></main>")[0]["heading"] == "Overview"
    assert [s["text"] for s in sections.parse('<main><p>out</p><div class="field--name-body x"><p>in</p></div></main>')] == ["in"]
    for bad in ("", "<p>no landmark</p>", "<main><h1>only</h1></main>"):
        with pytest.raises(ValueError):
            sections.parse(bad)


def test_sections_frame(spark):
    frame = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x")], "id long, html string")
    assert [(r["id"], r["section"], r["heading"]) for r in sections.sections(frame, "id").collect()] == [(1, 0, "Governance"), (1, 1, "Review")]
    assert {r["id"]: r["parsed"]["error"] is None for r in sections.with_sections(frame).collect()} == {1: True, 2: False, 3: False}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aé. \n", max_size=900), st.integers(16, 80))
def test_chunks_are_bounded_and_whole(text, limit):
    got = chunking.split(text, limit, limit // 5)
    assert all(len(c.encode()) <= limit and c == c.strip() and c for c in got)
    assert got == chunking.split(text, limit, limit // 5)
    assert set("".join(got)) >= set(text.replace(".", "").split(" ")[0].strip()[:1]) or not text.strip()
    kept = "".join(c for c in text if not c.isspace())
    if limit // 5 == 0 or len(got) == 1:
        assert "".join("".join(got).split()) == kept


def test_chunks_overlap():
    words = " ".join(f"word{k}" for k in range(200))
    got = chunking.split(words, 120, 40)
    assert len(got) > 5
    for a, b in zip(got, got[1:], strict=False):
        assert a.split()[-1] in b.split()[:8] or b.split()[0] in a.split()
    assert {w for c in got for w in c.split()} == set(words.split())


def test_chunk_frame(spark):
    text = "été " * 700
    rows = spark.createDataFrame([("d", 0, "t", "h", text), ("d", 1, "t", "h", "short  "), ("e", 0, "t", "h", None), ("f", 0, "t", "h", "  ")], "document_id string, section int, document_title string, section_heading string, text string")
    got = chunking.chunks(rows, Settings(chunk_bytes=256, overlap_bytes=32)).collect()
    assert {r["document_id"] for r in got} == {"d"} and max(len(r["text"].encode()) for r in got) <= 256
    assert len({r["chunk_id"] for r in got}) == len(got)
    p = chunking.prepared(chunking.chunks(spark.createDataFrame([("d", 0, "mail a@b.co", "h", "a@b.co and c@d.co")], rows.schema)))
    r = p.first()
    assert r["text"] == "<EMAIL_ADDRESS> and <EMAIL_ADDRESS>" and r["redactions"] == {"EMAIL_ADDRESS": 3} and r["prompt_ok"]
    assert r["document_title"] == "mail a@b.co" and "a@b.co" not in r["prompt"]
    assert chunking.unchanged(p, p).count() == 0 and chunking.unchanged(p, p.where("false")).count() == 1
    assert [tuple(x) for x in chunking.redaction_totals(p).collect()] == [("EMAIL_ADDRESS", 3)]


def test_positions(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = numbered(frame, "k").collect()
    assert all(r["k"] == r["position"] for r in got) and len(got) == 1000
    assert numbered(frame.where("false"), "k").count() == 0


def test_settings_and_names():
    for bad in ({"dimension": 0}, {"overlap_bytes": 1500}, {"top_k": 21}, {"min_similarity": 1.5}, {"chunk_bytes": 100}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings().variants == {"baseline": 6, "wider": 10, "focused": 3}
    assert table_name("chunks_1") == "chunks_1"
    for bad in ("", "a;b", "x" * 41):
        with pytest.raises(ValueError):
            table_name(bad)


def test_manifest(spark, tmp_path):
    import json

    good = {"document_id": "a", "regulator": "OPC", "title": "T", "source_url": "https://priv.gc.ca/x", "format": "html", "public": True}
    path = tmp_path / "m.json"

    def load(*docs):
        path.write_text(json.dumps({"schema_version": 1, "purpose": "p", "terms": {"k": "v"}, "documents": docs}, indent=1))
        return manifest.load(spark, str(path))

    assert load(good).first()["resolved_url"] is None
    for bad in ([], [good, good], [{**good, "source_url": "http://priv.gc.ca/x"}], [{**good, "public": False}]):
        with pytest.raises(ValueError):
            load(*bad)
    urls = ["http://localhost:4566", "http://[::1]:80/", "https://localhost", "http://localhost/x", "http://me@localhost", "http://example.com"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(manifest.local_endpoint(F.col("u"))).collect()
    assert [r[0] for r in rows] == [True, True, False, False, False, False]


def test_raw_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.html").write_bytes(b"one")
    (tmp_path / "b.html").write_bytes(b"other")
    raw = files.raw_documents(spark, str(tmp_path))
    sha = hashlib.sha256(b"one").hexdigest()
    rows = [("a", "html", sha, "now"), ("b", "html", sha, "now"), ("c", "html", sha, "now"), ("a", "pdf", sha, "now"), ("d", "html", None, None)]
    sources = spark.createDataFrame(rows, "document_id string, format string, sha256 string, retrieved_at string")
    assert {(r["document_id"], r["format"]): r["error"] for r in files.verified(raw, sources).collect()} == {("a", "html"): None, ("b", "html"): "hash mismatch", ("c", "html"): "missing", ("a", "pdf"): "missing", ("d", "html"): "missing"}
    assert {r["document_id"] for r in files.to_download(sources.where("document_id IN ('a', 'd') AND format = 'html'"), raw).collect()} == {"d"}
    with pytest.raises(Exception, match="hash mismatch"):
        files.to_download(sources, raw).collect()
    few = files.raw_documents(spark, str(tmp_path), limit=3)
    assert few.where("content IS NOT NULL").count() == 1
    assert {(r["document_id"], r["format"]): r["error"] for r in files.verified(few, sources).collect()}["b", "html"] == "too large"
    with pytest.raises(Exception, match="hash mismatch"):
        files.to_download(sources.where("document_id = 'b'"), few).collect()
    chunk = spark.createDataFrame([("a", "x")], "document_id string, text string")
    files.write_artifact(chunk, str(tmp_path / "out"), "r1", "chunks")
    assert files.read_artifact(spark, str(tmp_path / "out"), "r1", "chunks", "document_id string, text string").count() == 1
    with pytest.raises(ValueError):
        files.read_artifact(spark, str(tmp_path / "out"), "r1", "chunks", "text string", limit=1)
    lines = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("x",), (None,)], "value string")
    assert [r[0] is not None for r in files.tolerant_json(lines).select(F.to_json("object")).collect()] == [True, False, False, False]


def test_log_lines(spark):
    import json

    event = {"telemetry_event": "invocation", "stage": "query", "environment": "dev", "status": "odd", "reason": "secret text", **dict.fromkeys(logs.METRICS, 1.0)}
    lines = [json.dumps(event), "telemetry_event but no JSON", json.dumps({"telemetry_event": "delivery_failed"}), "START", json.dumps({**event, "status": "refused", "reason": "weak_evidence"})]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((r["status"], r["reason"] or "") for r in logs.invocations(frame, "query", "dev").collect()) == [("refused", "weak_evidence"), ("unknown", "")]
    assert logs.delivery_failures(frame).first()[0] == 1
    for bad in ({**event, "stage": "parse"}, {**event, "latency_ms": -1.0}):
        with pytest.raises(Exception, match="stage or environment|out of range"):
            logs.invocations(spark.createDataFrame([(json.dumps(bad),)], "value string"), "query", "dev").collect()


def test_polite_download():
    seen, waits = [], []
    site = {
        "https://priv.gc.ca/robots.txt": (200, {}, b"User-agent: *\nDisallow: /private\nCrawl-delay: 3"),
        "https://priv.gc.ca/a": (302, {"location": "/b"}, b""),
        "https://priv.gc.ca/b": (200, {}, b"%PDF-1"),
        "https://priv.gc.ca/loop": (302, {"location": "/loop"}, b""),
        "https://priv.gc.ca/away": (302, {"location": "https://example.com/"}, b""),
        "https://priv.gc.ca/hidden": (302, {"location": "/private/x"}, b""),
    }

    def get(url):
        seen.append(url)
        return site.get(url, (404, {}, b""))

    row = {"source_url": "https://priv.gc.ca/a", "regulator": "OPC", "format": "pdf"}
    robots = fetch.Robots(get)
    assert fetch.download(row, robots, get, waits.append) == (b"%PDF-1", "https://priv.gc.ca/b") and waits == [3.0]
    for path in ("loop", "away", "hidden", "private/x", "missing"):
        with pytest.raises(ValueError):
            fetch.download({**row, "source_url": f"https://priv.gc.ca/{path}"}, robots, get, waits.append)
    with pytest.raises(ValueError):
        fetch.fetch("https://priv.gc.ca/b", "OPC", get=get, limit=3)
    assert seen.count("https://priv.gc.ca/robots.txt") == 1
