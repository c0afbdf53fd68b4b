"""Rate limits by sliding window: a request is refused if as many as the limit were let through in the time before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.folds import ordered_fold

#: Requests a minute, and whose they are: an address or a user.
LIMITS = {"auth": 5, "upload": 60, "read": 300}
WINDOW = 60.0
SCHEMA = "caller long, kind string, seq long, at double, allowed boolean, used long, retry_after double"


def window_step(limits: dict[str, int], window: float) -> Callable[[dict, dict], dict]:
    """The times of the requests let through in the last ``window`` seconds are kept, ``limit`` at most; refused ones don't count."""

    def step(state: dict, row: dict) -> dict:
        limit, now = limits[row["kind"]], row["at"]
        state["passed"] = passed = [t for t in state["passed"] if t > now - window]
        allowed = len(passed) < limit
        if allowed:
            passed.append(now)
        retry = None if allowed else passed[0] + window - now
        return {"caller": row["caller"], "kind": row["kind"], "seq": row["seq"], "at": now, "allowed": allowed, "used": len(passed), "retry_after": retry}

    return step


def rate_limit(requests: DataFrame, limits: dict[str, int] = LIMITS, window: float = WINDOW) -> DataFrame:
    """SCHEMA of requests (caller, kind, seq, at in seconds), each caller's kinds apart, in the order of ``at`` and ``seq``.

    Since refusals feed back into what follows, this is no count over a window. Kinds without a limit are left out.
    """
    own = requests.select("caller", "kind", "seq", F.col("at").cast("double").alias("at")).filter(F.col("kind").isin(*limits))
    return ordered_fold(own, ["caller", "kind"], ["at", "seq"], lambda: {"passed": []}, window_step(limits, window), SCHEMA)


def tenant_ceiling(requests: DataFrame, ceiling: int, window: float = WINDOW) -> DataFrame:
    """SCHEMA of requests (tenant, seq, at): one ceiling for all of a tenant's requests; ``caller`` is the tenant."""
    return rate_limit(requests.select(F.col("tenant").alias("caller"), F.lit("all").alias("kind"), "seq", "at"), {"all": ceiling}, window)
