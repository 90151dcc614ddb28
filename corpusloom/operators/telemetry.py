"""Invocation events, metrics, statistics and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.shared import require

# Metric names and units.
METRICS = {
    "requests": ("Requests", "Count"),
    "latency_ms": ("LatencyMs", "Milliseconds"),
    "retrieved_chunks": ("RetrievedChunks", "Count"),
    "refusals": ("Refusals", "Count"),
    "guardrail_blocks": ("GuardrailBlocks", "Count"),
    "errors": ("Errors", "Count"),
    "rejected_requests": ("RejectedRequests", "Count"),
}
# Reasons that are reported, in the order checks run; the guards among them; stages and environments.
REASONS = ("input_injection", "context_injection", "weak_evidence", "unsupported_by_context", "incomplete_or_filtered_output", "invalid_output", "invalid_citations", "output_pii", "unsafe_output_markup", "output_injection", "invalid_request", "method_not_allowed", "unsupported_media_type", "index_identity_mismatch", "query_failed")
GUARDS = ("input_injection", "context_injection", "incomplete_or_filtered_output", "invalid_output", "invalid_citations", "output_pii", "unsafe_output_markup", "output_injection")
STAGES = ("parse", "chunk", "embed", "query")
ENVIRONMENTS = ("dev", "prod")
STATUSES = ("error", "rejected", "refused", "answered", "completed")
# Alarms per stage: metric, statistic, threshold that must be exceeded, period in seconds.
ALARMS = (("errors", "sum", 0.0, 60), ("latency_ms", "average", 30000.0, 60))
BODY_LIMIT, MOST_RETRIEVED = 128_000, 20


def _truthy(v: Column) -> Column:
    """Whether a variant is there and neither null, false, zero nor empty."""
    kind = F.schema_of_variant(v)
    empty = kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>") & (F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0)) == 0)
    blank = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == "")
    zero = F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False)) & ~kind.isin("STRING")
    return v.isNotNull() & ~F.coalesce(empty, F.lit(False)) & ~F.coalesce(blank, F.lit(False)) & ~zero


def invocation_events(calls: DataFrame) -> DataFrame:
    """The closed event schema from calls: stage, environment, status_code, body (JSON text), failed, latency_ms, invocation_id.

    Precedence: error, rejected, refused, answered, completed. An error is a failed call or a status of 409 or from 500;
    400, 405 and 415 are rejections. Free text never gets through: unknown reasons become null. A dimension outside its
    enum or a latency that isn't finite and at least 0 fails the job.
    """
    code = F.when(F.col("status_code").between(100, 599), F.col("status_code"))
    body = F.when(F.length("body") <= BODY_LIMIT, F.try_parse_json("body"))
    get = lambda path, kind: F.try_variant_get(body, path, kind)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(body, path, "variant")) == "STRING", get(path, "string"))
    failed = F.coalesce("failed", F.lit(False))
    error = failed | F.coalesce((code == 409) | (code >= 500), F.lit(False))
    rejected = F.coalesce(code.isin(400, 405, 415), F.lit(False))
    refused = ~error & ~rejected & F.coalesce(text("$.status") == "refused", F.lit(False))
    given = F.when(_truthy(get("$.reason", "variant")), text("$.reason")).otherwise(text("$.error"))
    reason = F.when(failed, "handler_exception").when(given.isin(*REASONS), given)
    count = F.least(F.coalesce(F.size(get("$.retrieved", "array<variant>")), F.lit(0)), F.lit(MOST_RETRIEVED))
    status = F.when(error, "error").when(rejected, "rejected").when(refused, "refused").when(text("$.status") == "answered", "answered").otherwise("completed")
    latency = F.col("latency_ms")
    fit = F.col("stage").isin(*STAGES) & F.col("environment").isin(*ENVIRONMENTS) & ~F.isnan(latency) & (latency >= 0) & (latency < float("inf"))
    return require(calls, fit, F.lit("unregistered dimension or bad latency")).select(
        F.lit("invocation").alias("telemetry_event"),
        T.run_id(F.col("invocation_id")).alias("invocation_id"),
        "stage",
        "environment",
        status.alias("status"),
        reason.alias("reason"),
        T.run_id(text("$.run_id")).alias("run_id"),
        code.alias("http_status"),
        F.lit(1).alias("requests"),
        F.round(latency, 3).alias("latency_ms"),
        F.when(count < 0, 0).otherwise(count).alias("retrieved_chunks"),
        refused.cast("int").alias("refusals"),
        (refused & F.coalesce(reason.isin(*GUARDS), F.lit(False))).cast("int").alias("guardrail_blocks"),
        error.cast("int").alias("errors"),
        rejected.cast("int").alias("rejected_requests"),
        *([F.col("ts")] if "ts" in calls.columns else []),
    )


def metric_values(events: DataFrame) -> DataFrame:
    """One row per event and metric: ts, environment, stage, metric, value; only invocation events."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return events.where("telemetry_event = 'invocation'").select("ts", "environment", "stage", F.explode(pairs).alias("m")).select("ts", "environment", "stage", "m.metric", "m.value")


def statistics(values: DataFrame, period: int = 60, ts_col: str = "ts", timed: bool = False) -> DataFrame:
    """Sum, average, sample count, minimum and maximum per tumbling window, environment, stage and metric; timed: with the window's event time as period_time."""
    ts = F.col(ts_col) if values.schema[ts_col].dataType.simpleString() == "timestamp" else F.col(ts_col).cast("timestamp")  # a cast would drop a watermark
    w = F.window(ts, f"{period} seconds")
    grouped = values.groupBy(w.alias("w"), "environment", "stage", "metric").agg(
        F.sum("value").alias("sum"), F.avg("value").alias("average"), F.count("value").alias("sample_count"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )
    return grouped.select(F.col("w.start").alias("period_start"), "environment", "stage", "metric", "sum", "average", "sample_count", "minimum", "maximum", *([F.window_time("w").alias("period_time")] if timed else []))


def alarm_table(spark, environments=ENVIRONMENTS, stages=STAGES) -> DataFrame:
    rows = [(e, s, m, stat, threshold, period) for e in environments for s in stages for m, stat, threshold, period in ALARMS]
    return spark.createDataFrame(rows, "environment string, stage string, metric string, statistic string, threshold double, period int")


def alarm_states(stats: DataFrame, alarms: DataFrame) -> DataFrame:
    """State of each alarm in every period that has data: ALARM above the threshold, else OK."""
    value = F.when(F.col("statistic") == "sum", F.col("sum")).when(F.col("statistic") == "average", F.col("average")).when(F.col("statistic") == "maximum", F.col("maximum")).when(F.col("statistic") == "minimum", F.col("minimum")).otherwise(F.col("sample_count"))
    breach = F.coalesce(value > F.col("threshold"), F.lit(False))
    return stats.join(F.broadcast(alarms), ["environment", "stage", "metric"]).select("period_start", "environment", "stage", "metric", "statistic", value.alias("value"), F.when(breach, "ALARM").otherwise("OK").alias("state"), *(["period_time"] if "period_time" in stats.columns else []))


def alarm_transitions(states: DataFrame, period: int = 60) -> DataFrame:
    """Where an alarm's state changes. A period without data is OK, so an alarm followed by a gap goes OK after its period."""
    key = ["environment", "stage", "metric", "statistic"]
    # Only breaching periods matter: everything between them is OK.
    alarm = states.where("state = 'ALARM'")
    order = Window.partitionBy(*key).orderBy("period_start")
    step = F.expr(f"INTERVAL {period} SECONDS")
    edges = alarm.withColumn("before", F.lag("period_start").over(order)).withColumn("after", F.lead("period_start").over(order))
    starts = edges.where(F.col("before").isNull() | (F.col("before") + step < F.col("period_start"))).select(*key, F.col("period_start").alias("at"), F.lit("OK").alias("from_state"), F.lit("ALARM").alias("to_state"))
    ends = edges.where(F.col("after").isNull() | (F.col("period_start") + step < F.col("after"))).select(*key, (F.col("period_start") + step).alias("at"), F.lit("ALARM").alias("from_state"), F.lit("OK").alias("to_state"))
    return starts.unionByName(ends)


def reconciled(metric_totals: DataFrame, log_totals: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Totals of both sides by (environment, stage, metric): agree, differ, or missing on one side."""
    key = ["environment", "stage", "metric"]
    both = metric_totals.select(*key, F.col("total").alias("metric_total")).join(log_totals.select(*key, F.col("total").alias("log_total")), key, "full_outer")
    verdict = F.when(F.col("metric_total").isNull() | F.col("log_total").isNull(), "missing").when(F.abs(F.col("metric_total") - F.col("log_total")) <= tolerance, "agree").otherwise("differ")
    return both.withColumn("verdict", verdict)


def leaks(messages: DataFrame, forbidden: list[str], text_col: str = "message") -> DataFrame:
    """Messages that hold any forbidden text."""
    return messages.where(F.exists(F.array(*map(F.lit, forbidden)), lambda x: F.contains(F.col(text_col), x))) if forbidden else messages.where("false")


def request_status(requests: DataFrame, max_bytes: int = 2000) -> DataFrame:
    """The HTTP gate: adds http_status and question (null unless 200).

    requests: method, headers map<string,string>, body, is_base64. 405 for another method than POST; 415 unless the
    media type, without parameters and in any case, is application/json; 400 for a body that is missing, over 16,000
    bytes, not base64 where it says so, not JSON, not exactly {"question": text}, blank or over max_bytes.
    """
    named = F.filter(F.map_entries("headers"), lambda h: F.lower(h["key"]) == "content-type")
    media = F.lower(F.trim(F.substring_index(F.get(named, F.lit(0))["value"], ";", 1)))
    raw = F.when(F.coalesce("is_base64", F.lit(False)), F.decode(F.try_to_binary("body", F.lit("base64")), "UTF-8")).otherwise(F.col("body"))
    doc = F.when(F.octet_length(raw) <= 16_000, F.try_parse_json(raw))
    question = F.when(F.schema_of_variant(doc) == "OBJECT<question: STRING>", F.try_variant_get(doc, "$.question", "string"))
    fine = T.within_bytes(question, max_bytes)
    status = F.when(F.upper("method") != "POST", 405).when(F.coalesce(media, F.lit("")) != "application/json", 415).when(~fine, 400).otherwise(200)
    return requests.withColumn("http_status", F.coalesce(status, F.lit(405))).withColumn("question", F.when(F.col("http_status") == 200, question))
