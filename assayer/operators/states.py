"""The pipeline's state relation: legality, replay of histories, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Every state with the states it may move to.
MOVES = {
    "RECEIVED": ("PREPROCESSING", "FAILED"),
    "PREPROCESSING": ("OCR_RUNNING", "QUALITY_REJECTED", "FAILED"),
    "QUALITY_REJECTED": ("PREPROCESSING", "FAILED"),
    "OCR_RUNNING": ("OCR_AGREED", "OCR_ARBITRATING", "FAILED"),
    "OCR_ARBITRATING": ("OCR_AGREED", "NEEDS_TRANSCRIPTION", "FAILED"),
    "OCR_AGREED": ("SEGMENTING", "FAILED"),
    "SEGMENTING": ("UNDERSTANDING", "NEEDS_TRANSCRIPTION", "FAILED"),
    "NEEDS_TRANSCRIPTION": ("UNDERSTANDING", "MANUAL_ONLY"),
    "UNDERSTANDING": ("SCORING", "MANUAL_ONLY", "FAILED"),
    "SCORING": ("AWAITING_REVIEW", "MANUAL_ONLY", "FAILED"),
    "AWAITING_REVIEW": ("REVIEWED",),
    "MANUAL_ONLY": ("REVIEWED",),
    "REVIEWED": ("MODERATION", "FINALISED"),
    "MODERATION": ("FINALISED", "AWAITING_REVIEW"),
    "FINALISED": (),
    "FAILED": (),
}
EDGES = [(s, d) for s, ds in MOVES.items() for d in ds]
HUMAN = ("NEEDS_TRANSCRIPTION", "AWAITING_REVIEW", "MANUAL_ONLY", "REVIEWED", "MODERATION")
MACHINE = ("RECEIVED", "PREPROCESSING", "OCR_RUNNING", "OCR_ARBITRATING", "OCR_AGREED", "SEGMENTING", "UNDERSTANDING", "SCORING")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "src string, dst string")


def states(spark: SparkSession) -> DataFrame:
    """(state, terminal, human, machine, allowed): allowed moves sorted, 'none' for terminal states."""
    rows = [(s, not d, s in HUMAN, s in MACHINE, ", ".join(sorted(d)) or "none") for s, d in MOVES.items()]
    return spark.createDataFrame(rows, "state string, terminal boolean, human boolean, machine boolean, allowed string")


def illegal(moves: DataFrame) -> DataFrame:
    """Moves (src, dst, ...) that the relation lacks, with the legal ones; the relation has 32 rows."""
    spark = moves.sparkSession
    bad = moves.join(F.broadcast(edges(spark)), ["src", "dst"], "left_anti")
    return bad.join(F.broadcast(states(spark).select(F.col("state").alias("src"), "allowed")), "src", "left")


def history_moves(history: DataFrame, key: str, order: str, state: str = "state") -> DataFrame:
    """(key, order, src, dst) of consecutive states."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    return history.select(key, order, before.alias("src"), F.col(state).alias("dst")).filter("src is not null")


def reachable(spark: SparkSession, start: str = "RECEIVED", without: tuple[str, ...] = ()) -> DataFrame:
    """(state, steps): states within reach and the fewest moves to them."""
    return distances(spark, without).filter(F.col("src") == start).select("state", "steps")


def distances(spark: SparkSession, without: tuple[str, ...] = ()) -> DataFrame:
    """(src, state, steps) of all states within reach of each other: steps are taken until none leads to a new state."""
    rows = []
    for start in MOVES:
        seen, edge, steps = {start}, {start}, 0
        while edge:
            rows += [(start, s, steps) for s in sorted(edge)]
            edge = {d for s in edge for d in MOVES[s] if d not in without} - seen
            seen, steps = seen | edge, steps + 1
    return spark.createDataFrame(rows, "src string, state string, steps int")


def once_only(attempts: DataFrame, order: str | Column) -> DataFrame:
    """The first attempt of each (script, stage, version)."""
    by = W.partitionBy("script_id", "stage", "pipeline_version").orderBy(order)
    return attempts.withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")
