"""Watching calls: one event a call, and nothing that goes wrong in watching changes the call."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Sink = Callable[[str], None]


def observed(stage: str, environment: str, sink: Sink = print, clock: Callable[[], float] = time.perf_counter):
    """Decorates a call that returns an envelope (a dict with statusCode and body, or a result): emits one JSON line with its raw call record.

    The record is what ``operators.telemetry.invocation_events`` takes: the closed event is made there, in batch or
    stream, so free text in a body never reaches a metric. An error of the call goes on to the caller; an error of the
    sink doesn't, and leaves a line that says so where that works.
    """

    def wrap(call: Callable[..., Any]) -> Callable[..., Any]:
        @wraps(call)
        def run(*args: Any, **kwargs: Any) -> Any:
            began, failed, result = clock(), True, None
            try:
                result = call(*args, **kwargs)
                failed = False
                return result
            finally:
                try:
                    known = result if isinstance(result, dict) else {}
                    body = known.get("body") if "statusCode" in known else known
                    record = {"stage": stage, "environment": environment, "status_code": known.get("statusCode"), "body": body if isinstance(body, str) or body is None else json.dumps(body, default=str), "failed": failed, "latency_ms": round(1000 * (clock() - began), 3), "invocation_id": uuid.uuid4().hex}
                    sink(json.dumps(record))
                except Exception:  # the observer must not fail the call
                    try:
                        sink(json.dumps({"telemetry_event": "delivery_failed", "stage": stage}))
                    except Exception:
                        pass

        return run

    return wrap


CALL = "stage string, environment string, status_code int, body string, failed boolean, latency_ms double, invocation_id string"


def calls(lines: DataFrame, column: str = "value") -> DataFrame:
    """Call records out of lines, whatever else stands among them."""
    parsed = lines.select(F.from_json(column, CALL, {"mode": "PERMISSIVE"}).alias("c"))
    return parsed.select("c.*").where("invocation_id IS NOT NULL AND stage IS NOT NULL")


def counted(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """df and an observation of its metrics, filled when df is first written or collected; no second pass over the data."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen
