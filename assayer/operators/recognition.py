"""Recognition calls: content keys, cache, budget and breaker as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators.folds import ordered_fold

#: Line sources, flags, and answer types that are marked by machine.
SOURCES = ("TIER1", "AGREED", "ARBITRATED", "HUMAN", "UNRESOLVED")
FLAGS = ("STRUCK_THROUGH", "TIER2_DISAGREEMENT", "NEEDS_HUMAN_TRANSCRIPTION", "CONTAINS_NUMERALS", "NEAR_RUBRIC_KEYWORD", "HIGH_CONFIDENCE_VARIANCE", "INJECTION_PATTERN")
AUTO_MARKABLE = ("PROSE", "SHORT")
STRUCK, NEEDS_HUMAN, UNRESOLVED = FLAGS[0], FLAGS[2], SOURCES[4]


def cache_key(image: Column, version: Column, language: Column, lexicon: Column) -> Column:
    """Digest of the image and what changes its reading; the lexicon's order doesn't."""
    words = F.array_join(F.array_sort(lexicon), "\x1e")
    cut = F.lit(b"\x1f")
    return F.sha2(F.concat(image, cut, F.encode(version, "UTF-8"), cut, F.encode(language, "UTF-8"), cut, F.encode(words, "UTF-8")), 256)


def read_through(calls: DataFrame, key: str, order: str, price: str, ok: Column | None = None) -> DataFrame:
    """``cost`` and ``from_cache`` of every call: the first that succeeds for a key pays, later ones are free.

    Calls before the first success pay nothing and come from nowhere. The first success is an aggregate, so a
    key with a third of all calls meets in one row before it is joined back.
    """
    good = F.lit(True) if ok is None else ok
    first = calls.filter(good).groupBy(key).agg(F.min(order).alias("__first"))
    joined = calls.join(first, key, "left")
    pays = F.col(order) == F.col("__first")
    return joined.withColumn("cost", F.when(pays, F.col(price)).otherwise(0.0)).withColumn("from_cache", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__first")


def _charge(state: dict, row: dict) -> dict:
    admitted = state["spent"] + row["price"] <= row["cap"]
    if admitted:
        state["spent"] += row["price"]
    return {"tenant": row["tenant"], "seq": row["seq"], "price": row["price"], "admitted": admitted, "spent": state["spent"], "remaining": max(0.0, row["cap"] - state["spent"])}


def cost_meter(calls: DataFrame) -> DataFrame:
    """(tenant, seq, price, admitted, spent, remaining) of calls (tenant, seq, price, cap).

    A call that would pass the cap is refused before it is made and spends nothing, so this is no running sum.
    """
    return ordered_fold(calls.select("tenant", "seq", "price", "cap"), ["tenant"], ["seq"], lambda: {"spent": 0.0}, _charge, "tenant long, seq long, price double, admitted boolean, spent double, remaining double")


def breaker_step(threshold: int, reset: float):
    def step(state: dict, row: dict) -> dict:
        opened, now = state["opened"], row["at"]
        blocked = opened is not None and now - opened < reset
        if not blocked:
            state["opened"] = None  # half-open: the count stays, so one failure opens it again
            if row["failed"]:
                state["failures"] += 1
                if state["failures"] >= threshold:
                    state["opened"] = now
            else:
                state["failures"] = 0
        return {"provider": row["provider"], "seq": row["seq"], "blocked": blocked, "failures": state["failures"], "open": state["opened"] is not None}

    return step


def circuit_breaker(calls: DataFrame, threshold: int = 5, reset: float = 30.0) -> DataFrame:
    """(provider, seq, blocked, failures, open) of calls (provider, seq, at in seconds, failed)."""
    return ordered_fold(calls.select("provider", "seq", "at", "failed"), ["provider"], ["seq"], lambda: {"failures": 0, "opened": None}, breaker_step(threshold, reset), "provider long, seq long, blocked boolean, failures long, open boolean")


def readable(flags: Column, source: Column) -> Column:
    return ~F.array_contains(flags, STRUCK) & (source != UNRESOLVED)


def needs_human(flags: Column) -> Column:
    return F.array_contains(flags, NEEDS_HUMAN)


def domain_violations(lines: DataFrame) -> DataFrame:
    """``why`` of lines (source, flags, confidence) with an unknown source or flag, or a confidence beyond 0 to 1."""
    why = F.array_compact(F.array(F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "SOURCE"), F.when(F.size(F.array_except("flags", F.array(*map(F.lit, FLAGS)))) > 0, "FLAG"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "CONFIDENCE")))
    return lines.withColumn("why", why).filter(F.size("why") > 0)


def auto_markable(answer_type: Column) -> Column:
    return F.coalesce(answer_type.isin(*AUTO_MARKABLE), F.lit(False))


def call_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(call, made, failures, outcome) of attempts (call, attempt from 1, result: OK, ERROR or REFUSED).

    A call ends with its first success or refusal, or after ``most`` attempts; a refusal is not tried again but counts as a failure.
    What was recorded after the end is not part of the call.
    """
    ends = F.min(F.when(F.col("result") != "ERROR", F.col("attempt")))
    last = attempts.groupBy("call").agg(F.least(F.coalesce(ends, F.lit(most)), F.lit(most)).alias("last"))
    made = attempts.join(last, "call").filter(F.col("attempt") <= F.col("last"))
    return made.groupBy("call").agg(F.count("*").alias("made"), F.count_if(F.col("result") != "OK").alias("failures"), F.max_by("result", "attempt").alias("outcome"))


def box_valid(box: Column) -> Column:
    return (box.getField("w") > 0) & (box.getField("h") > 0)


def centre_y(box: Column) -> Column:
    return box.getField("y") + box.getField("h") / 2
