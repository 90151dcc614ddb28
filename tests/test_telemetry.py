import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import telemetry as t
from corpusloom.plans import fixtures
from corpusloom.streaming import telemetry as live

CALL = "ts timestamp, stage string, environment string, status_code int, body string, failed boolean, latency_ms double, invocation_id string"
ID = "0" * 31 + "1"


def call(body=None, code=200, failed=False, stage="query", latency=5.0, at=0):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), stage, "dev", code, body if body is None or isinstance(body, str) else json.dumps(body), failed, latency, ID)


@pytest.mark.parametrize(
    ("row", "status", "reason", "blocks"),
    [
        (call({"status": "answered", "retrieved": [1, 2]}), "answered", None, 0),
        (call({"status": "refused", "reason": "input_injection"}), "refused", "input_injection", 1),
        (call({"status": "refused", "reason": "weak_evidence"}), "refused", "weak_evidence", 0),
        (call({"status": "refused", "reason": "my secret"}), "refused", None, 0),
        (call({"error": "index_identity_mismatch"}, 409), "error", "index_identity_mismatch", 0),
        (call({"error": "invalid_request"}, 400), "rejected", "invalid_request", 0),
        (call({"status": "refused"}, 502), "error", None, 0),
        (call({"status": "answered"}, failed=True), "error", "handler_exception", 0),
        (call(None), "completed", None, 0),
        (call("[1]"), "completed", None, 0),
        (call("{"), "completed", None, 0),
        (call(stage="parse"), "completed", None, 0),
        (call({"status": True}, 99), "completed", None, 0),
    ],
)
def test_invocation_events(spark, row, status, reason, blocks):
    r = t.invocation_events(spark.createDataFrame([row], CALL)).first()
    assert (r["status"], r["reason"], r["guardrail_blocks"]) == (status, reason, blocks)
    assert r["errors"] == (status == "error") and r["rejected_requests"] == (status == "rejected") and r["refusals"] == (status == "refused")
    assert r["http_status"] == (None if row[3] == 99 else row[3])


def test_events_are_closed(spark):
    r = t.invocation_events(spark.createDataFrame([call({"status": "answered", "retrieved": list(range(50)), "run_id": ID, "answer": "text"})], CALL)).first()
    assert r["retrieved_chunks"] == 20 and r["run_id"] == ID and "answer" not in r.asDict() and "body" not in r.asDict()
    for bad in (call(stage="other"), call(latency=-1.0), call(latency=float("nan"))):
        with pytest.raises(Exception, match="unregistered"):
            t.invocation_events(spark.createDataFrame([bad], CALL)).collect()


def test_alarms(spark):
    calls = [call(code=500, at=s) for s in (0, 61, 70, 200)] + [call(latency=90_000.0, at=30), call(at=130), call(latency=30_000.0, at=400)]
    states = t.alarm_states(t.statistics(t.metric_values(t.invocation_events(spark.createDataFrame(calls, CALL)))), t.alarm_table(spark))
    got = {(r["metric"], r["period_start"].minute): r["state"] for r in states.collect()}
    assert got["errors", 0] == got["errors", 1] == got["errors", 3] == "ALARM" and got["errors", 2] == "OK"
    assert got["latency_ms", 0] == "ALARM" and got["latency_ms", 6] == "OK"  # strictly greater
    moves = [(r["metric"], r["at"].minute, r["to_state"]) for r in t.alarm_transitions(states).orderBy("metric", "at").collect()]
    assert moves == [("errors", 0, "ALARM"), ("errors", 2, "OK"), ("errors", 3, "ALARM"), ("errors", 4, "OK"), ("latency_ms", 0, "ALARM"), ("latency_ms", 1, "OK")]


def test_reconciliation_and_leaks(spark):
    schema = "environment string, stage string, metric string, total double"
    a = spark.createDataFrame([("dev", "query", "errors", 2.0), ("dev", "query", "requests", 5.0), ("dev", "parse", "errors", 0.0)], schema)
    b = spark.createDataFrame([("dev", "query", "errors", 2.05), ("dev", "query", "requests", 7.0)], schema)
    assert {(r["stage"], r["metric"]): r["verdict"] for r in t.reconciled(a, b).collect()} == {("query", "errors"): "agree", ("query", "requests"): "differ", ("parse", "errors"): "missing"}
    m = spark.createDataFrame([("a secret",), ("fine",), (None,)], "message string")
    assert t.leaks(m, ["secret"]).count() == 1 and t.leaks(m, []).count() == 0


def test_request_gate(spark):
    got = {r["name"]: r["http_status"] for r in t.request_status(fixtures.requests(spark)).collect()}
    assert got.pop("fine") == got.pop("base64") == 200 and got.pop("method") == 405 and got.pop("media") == got.pop("no media") == 415
    assert set(got.values()) == {400}


def test_streams_agree_with_batch(spark, tmp_path):
    calls = [call(code=500, at=s) for s in (0, 61, 200, 260)] + [call(at=s) for s in (5, 70, 130, 190, 900, 1500)]
    events = t.invocation_events(spark.createDataFrame(calls, CALL))
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def drain(frame, name):
        out = str(tmp_path / name)
        with live.stored_state(spark):
            frame.writeStream.outputMode("append").option("checkpointLocation", out + "-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return spark.read.schema(frame.schema).parquet(out)

    key = ["period_start", "environment", "stage", "metric"]
    batch = t.statistics(t.metric_values(events))
    streamed = drain(live.statistics(stream), "stats")
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0
    late = batch.join(streamed, key, "left_anti").agg(F.min("period_start")).first()[0]
    assert late >= dt.datetime(2024, 1, 1, 0, 22)  # only what the watermark leaves open

    states = str(tmp_path / "states")
    t.alarm_states(batch, t.alarm_table(spark)).where("metric = 'errors'").repartition(1).sortWithinPartitions("period_start").write.parquet(states)
    moves = drain(live.transitions(spark.readStream.schema(spark.read.parquet(states).schema).parquet(states)), "moves")
    want = t.alarm_transitions(spark.read.parquet(states)).where("metric = 'errors'")
    cols = ["environment", "stage", "metric", "at", "to_state"]
    assert {tuple(r) for r in moves.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


def test_transitions_survive_a_restart(spark, tmp_path):
    """Files arrive one after another and the query is started anew for each: an alarm open at a stop is ended after it, once."""
    parts = [[call(code=500, at=s) for s in (0, 61)] + [call(at=5)], [call(code=500, at=130), call(at=400)], [call(code=500, at=460)], [call(at=2000), call(code=500, at=2100)], [call(at=4000)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = [t.invocation_events(spark.createDataFrame(p, CALL)) for p in parts]
    alarms = t.alarm_table(spark)
    for some in events:
        some.coalesce(1).write.mode("append").parquet(source)
        moves = live.transitions(live.alarm_states(spark.readStream.schema(some.schema).parquet(source), alarms))
        with live.stored_state(spark):
            moves.writeStream.outputMode("append").option("checkpointLocation", out + "-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    cols = ["environment", "stage", "metric", "at", "to_state"]
    got = sorted(map(tuple, spark.read.schema(moves.schema).parquet(out).select(cols).collect()))
    every = t.alarm_transitions(t.alarm_states(t.statistics(t.metric_values(t.invocation_events(spark.createDataFrame(sum(parts, []), CALL)))), alarms))
    assert got == sorted(map(tuple, every.select(cols).collect())) and len(got) == 6


def test_observer_never_alters_a_call(spark):
    from corpusloom.streaming import observe

    lines = []

    @observe.observed("query", "dev", lines.append)
    def handler(x):
        if x == "fail":
            raise KeyError(x)
        return {"statusCode": 200, "body": json.dumps({"status": "refused", "reason": "input_injection", "answer": "secret"})}

    assert handler("ok")["statusCode"] == 200
    with pytest.raises(KeyError):
        handler("fail")

    def broken(line):
        raise OSError

    assert observe.observed("query", "dev", broken)(lambda: 7)() == 7
    frame = spark.createDataFrame([(x,) for x in [*lines, "noise", "{}"]], "value string")
    got = {r["status"]: (r["reason"], r["guardrail_blocks"]) for r in t.invocation_events(observe.calls(frame)).collect()}
    assert got == {"refused": ("input_injection", 1), "error": ("handler_exception", 0)}
    watched, seen = observe.counted(spark.range(10), "rows", n=F.count("*"))
    watched.collect()
    assert seen.get == {"n": 10}


def test_checks_hold_whatever_columns_are_read(spark):
    """No plan leaves a check out because the columns it hangs on aren't asked for."""
    from corpusloom import models
    from corpusloom.operators import ingest
    from corpusloom.sources import logs

    event = {"telemetry_event": "invocation", "stage": "query", "environment": "dev", "status": "answered", **dict.fromkeys(t.METRICS, 1)}
    for change in ({"stage": "embed"}, {"environment": "prod"}, {"latency_ms": -5}, {"errors": None}):
        lines = spark.createDataFrame([(json.dumps(event),), (json.dumps(event | change),)], "value string")
        with pytest.raises(Exception, match="another stage|out of range"):
            logs.invocations(lines, "query", "dev").groupBy("status").count().collect()
    fine = spark.createDataFrame([(json.dumps(event),)], "value string")
    assert logs.invocations(fine, "query", "dev").groupBy("status").count().collect()[0]["count"] == 1
    chunks = spark.createDataFrame([("a",), ("b",)], "content_hash string")
    vectors = spark.createDataFrame([("a", [1.0])], "content_hash string, embedding array<float>")
    with pytest.raises(Exception, match="no vector for b"):
        ingest.with_vectors(chunks, vectors).select("content_hash").count()
    with pytest.raises(Exception, match="invalid embedding"):
        models.embedded(chunks.withColumn("prompt", F.lit("x")), lambda: lambda texts: [[0.0]] * len(texts), 1).select("content_hash").count()


def test_the_first_truthy_reason_counts(spark):
    """A reason that is there but no known text gives none; only an absent or empty one lets the error speak."""
    bodies = [('{"reason": "weak_evidence", "error": "query_failed"}', "weak_evidence"), ('{"reason": 7, "error": "query_failed"}', None), ('{"reason": ["x"], "error": "query_failed"}', None), ('{"reason": {"a": 1}, "error": "query_failed"}', None), ('{"reason": true, "error": "query_failed"}', None)]
    bodies += [('{"reason": %s, "error": "query_failed"}' % v, "query_failed") for v in ('""', "null", "0", "0.0", "false", "[]", "{}")] + [('{"error": "query_failed"}', "query_failed"), ('{"reason": "free text", "error": "query_failed"}', None)]
    calls = spark.createDataFrame([("query", "dev", 200, b, False, 1.0, None, w) for b, w in bodies], "stage string, environment string, status_code int, body string, failed boolean, latency_ms double, invocation_id string, want string")
    got = [(r["reason"]) for r in t.invocation_events(calls.coalesce(1)).collect()]
    assert got == [w for _, w in bodies]
