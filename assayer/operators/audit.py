"""Hash-chained audit log: canonical text, verification in parallel, appending in order."""

from __future__ import annotations

import hashlib
import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assayer.operators.folds import ordered_fold

GENESIS = "0" * 64
UNIT = "\x1f"
#: The hashed fields in alphabetical order, and the actions that need an actor.
HASHED = ("action", "actor_id", "after", "at", "before", "entity_id", "entity_type", "reason", "tenant_id")
HUMAN_ACTIONS = ("marks.confirm", "marks.adjust", "marks.finalise", "rubric.freeze", "transcript.correct", "identity.reveal", "results.export")


def canonical(df_columns: list[str], include_at: bool = False) -> Column:
    """Compact JSON of the hashed fields, keys sorted, nulls kept; before and after must hold canonical JSON.

    ``at`` counts as null unless ``include_at``, as stored times were never part of the hash.
    """
    parts = []
    for name in HASHED:
        given = F.col(name) if name in df_columns and (name != "at" or include_at) else F.lit(None)
        value = given.cast("string") if name in ("before", "after") else F.regexp_replace(F.to_json(F.struct(given.cast("string").alias("v"))), r'^\{"v":|\}$', "")
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(F.when(given.isNotNull(), value), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def row_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit(UNIT), payload), 256)


def verify(log: DataFrame, payload: Column, tenant: str = "tenant_id", order: str = "id", chunk: int = 100_000) -> DataFrame:
    """(tenant, rows, first_break): the first 0-based position whose link or hash is wrong, null if all hold.

    Both checks look at a row and the hash before it only, so rows are checked side by side: a chain is cut into ranges of
    ``chunk`` ids, and one row for each range carries its count and last hash to the next, so that a long chain is no single task.
    """
    rows = log.select(tenant, F.col(order).alias("at"), F.floor(F.col(order) / chunk).alias("range"), "prev_hash", "row_hash", payload.alias("payload"))
    along = W.partitionBy(tenant).orderBy("range")
    ends = rows.groupBy(tenant, "range").agg(F.count("*").alias("n"), F.max_by("row_hash", "at").alias("last"))
    ends = ends.select(tenant, "range", F.lag("last", 1, GENESIS).over(along).alias("hash_before"), F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    by = W.partitionBy(tenant, "range").orderBy("at")
    checked = rows.withColumns({"nth": F.row_number().over(by), "before": F.lag("row_hash").over(by)}).join(ends, [tenant, "range"])
    first = F.when(F.col("nth") == 1, F.col("hash_before")).otherwise(F.col("before"))
    bad = (F.col("prev_hash") != first) | (F.col("row_hash") != row_hash(F.col("prev_hash"), F.col("payload")))
    return checked.groupBy(tenant).agg(F.count("*").alias("n_rows"), F.min(F.when(F.coalesce(bad, F.lit(True)), F.col("rows_before") + F.col("nth") - 1)).alias("first_break"))


def link(state: dict, row: dict) -> dict:
    prev = state["hash"]
    state["hash"] = hashlib.sha256(f"{prev}{UNIT}{row['payload']}".encode()).hexdigest()
    return {**row, "prev_hash": prev, "row_hash": state["hash"]}


def append(rows: DataFrame, tenant: str = "tenant_id", order: str = "id") -> DataFrame:
    """(tenant, order, payload, prev_hash, row_hash): rows with a payload, chained in order from the genesis hash."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = rows.select(tenant, order, "payload")
    return ordered_fold(own, [tenant], [order], lambda: {"hash": GENESIS}, link, f"`{tenant}` {kinds[tenant]}, `{order}` {kinds[order]}, payload string, prev_hash string, row_hash string")


def last_hash(log: DataFrame, tenant: str = "tenant_id", order: str = "id") -> DataFrame:
    return log.groupBy(tenant).agg(F.coalesce(F.max_by("row_hash", order), F.lit(GENESIS)).alias("last_hash"))


def read_chain(log: DataFrame, tenant: str) -> DataFrame:
    names = ["id", *(n for n in HASHED if n != "at"), "prev_hash", "row_hash"]
    return log.filter(F.col("tenant_id") == tenant).select(*names, F.lit(None).cast("timestamp").alias("at")).orderBy("id")


def actor_violations(log: DataFrame) -> DataFrame:
    """Human actions that no one is named for."""
    return log.filter(F.col("action").isin(*HUMAN_ACTIONS) & F.col("actor_id").isNull())


@F.pandas_udf(StringType())
def safe_ip(value: pd.Series) -> pd.Series:
    """The address if it is one, else null; the row stays."""

    def parsed(x: str | None) -> str | None:
        try:
            return None if x is None else str(ipaddress.ip_address(x.strip()))
        except ValueError:
            return None

    return value.map(parsed)


def lockouts(events: DataFrame, user: str, order: str, failed: Column, limit: int = 5) -> DataFrame:
    """(user, n_failures, longest_streak, locks): streaks of failures that no success interrupts.

    From the limit on, every failure of a streak locks again.
    """
    by = W.partitionBy(user).orderBy(order)
    streak = events.select(user, order, failed.alias("failed"), F.sum(F.when(failed, 0).otherwise(1)).over(by).alias("island"))
    nth = F.sum(F.col("failed").cast("int")).over(W.partitionBy(user, "island").orderBy(order))
    counted = streak.withColumn("nth", F.when(F.col("failed"), nth).otherwise(0))
    return counted.groupBy(user).agg(F.count_if("failed").alias("n_failures"), F.max("nth").alias("longest_streak"), F.count_if(F.col("nth") >= limit).alias("locks"))
