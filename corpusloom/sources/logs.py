"""Invocation events out of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.telemetry import METRICS, REASONS, STATUSES
from corpusloom.shared import require

EVENT = "telemetry_event string, stage string, environment string, status string, reason string, delivery_failed boolean, " + ", ".join(f"{m} double" for m in METRICS)


def invocations(lines: DataFrame, stage: str, environment: str, column: str = "value") -> DataFrame:
    """Events of one log group. Lines that aren't JSON objects with telemetry_event = invocation are skipped.

    A foreign stage or environment and a metric that isn't finite and at least 0 fail the job; an unknown status becomes
    ``unknown``, an unknown reason null.
    """
    e = lines.where(F.contains(column, F.lit("telemetry_event"))).withColumn("e", F.from_json(column, EVENT, {"mode": "PERMISSIVE"})).select("e.*").where("telemetry_event = 'invocation'")
    own = (F.col("stage") == stage) & (F.col("environment") == environment)
    sound = F.lit(True)
    for m in METRICS:
        sound = sound & F.coalesce((F.col(m) >= 0) & (F.col(m) < float("inf")), F.lit(False))
    other = F.coalesce(F.col("telemetry_event") != "invocation", F.lit(True))  # filters may be evaluated in any order
    checked = require(require(e, other | own, F.lit("event of another stage or environment")), other | sound, F.lit("metric out of range"))
    known = (*REASONS, "handler_exception")
    return checked.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("unknown")).withColumn("reason", F.when(F.col("reason").isin(*known), F.col("reason"))).drop("delivery_failed")


def delivery_failures(lines: DataFrame, column: str = "value") -> DataFrame:
    """How many lines report that an event could not be delivered."""
    v = F.try_parse_json(column)
    return lines.agg(F.count_if(F.coalesce(F.try_variant_get(v, "$.telemetry_event", "string") == "delivery_failed", F.lit(False))).alias("delivery_failures"))
