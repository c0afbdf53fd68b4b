"""The ordered folds on streams: the audit chain, the breaker and rate limits, with rows of many micro-batches in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.audit import GENESIS, link
from assayer.operators.limits import LIMITS, SCHEMA, WINDOW, window_step
from assayer.operators.recognition import breaker_step
from assayer.streaming.ordered import ordered_stream


def append(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Rows (tenant_id, id, at, payload) of a stream, chained per tenant in the order of ``at`` and id."""

    def step(state: dict, row: dict) -> dict:
        got = link(state, row)
        return {c: got[c] for c in ("tenant_id", "id", "payload", "prev_hash", "row_hash")}

    own = rows.select("tenant_id", "id", "at", "payload")
    return ordered_stream(own, ["tenant_id"], "at", ["id"], lambda: {"hash": GENESIS}, step, "tenant_id string, id long, payload string, prev_hash string, row_hash string", lateness)


def circuit_breaker(calls: DataFrame, threshold: int = 5, reset: float = 30.0, lateness: str = "10 minutes") -> DataFrame:
    """Calls (provider, seq, at in seconds, failed) of a stream against one breaker for each provider."""
    own = calls.select("provider", "seq", "at", "failed").withColumn("time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    return ordered_stream(own, ["provider"], "time", ["seq"], lambda: {"failures": 0, "opened": None}, breaker_step(threshold, reset), "provider long, seq long, blocked boolean, failures long, open boolean", lateness)


def rate_limit(requests: DataFrame, limits: dict[str, int] = LIMITS, window: float = WINDOW, lateness: str = "10 minutes") -> DataFrame:
    """``operators.limits.rate_limit`` of requests (caller, kind, seq, at in seconds) of a stream."""
    own = requests.select("caller", "kind", "seq", F.col("at").cast("double").alias("at")).filter(F.col("kind").isin(*limits))
    timed = own.withColumn("time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    return ordered_stream(timed, ["caller", "kind"], "time", ["at", "seq"], lambda: {"passed": []}, window_step(limits, window), SCHEMA, lateness)
