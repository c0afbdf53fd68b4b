"""Calibration by group: isotonic fits on one part, thresholds chosen on a second, a report on a third that nothing was fitted to.

Scores lie between 0 and 1 and count in steps of 1 / ``BINS``, so a group has at most BINS + 1 points, sums before any shuffle. Pooling
adjacent violators is mergeable: ranges of bins are pooled side by side, and pooling their blocks gives the same as pooling all.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators.results import split_of

BINS = 10_000
RANGE = 512
#: A false award weighs as much as three false omissions.
FALSE_AWARD = 3.0


def bin_of(score: Column) -> Column:
    return F.least(F.greatest(F.rint(score * BINS), F.lit(0)), F.lit(BINS)).cast("int")


def pooled(blocks: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Blocks (lo, hi, n, good) in order with every two neighbours in the wrong order, or alike, made one; in whole numbers."""
    out: list[tuple[int, int, int, int]] = []
    for lo, hi, n, good in blocks:
        while out and out[-1][3] * n >= good * out[-1][2]:
            before = out.pop()
            lo, n, good = before[0], n + before[2], good + before[3]
        out.append((lo, hi, n, good))
    return out


def fit(df: DataFrame, by: list[str], score: str, outcome: str) -> DataFrame:
    """(by, lo, hi, n, good, value): the blocks of each group's isotonic fit, bounds in bins. Rows without a score or outcome don't count."""
    points = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(*by, bin_of(F.col(score)).alias("lo")).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("good"))
    blocks = points.select(*by, "lo", F.col("lo").alias("hi"), "n", "good")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "lo", "hi", "n", "good"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("lo")
        found = pd.DataFrame(pooled(zip(*(own[c].tolist() for c in ("lo", "hi", "n", "good")))), columns=["lo", "hi", "n", "good"])
        return found.assign(**{c: [pdf[c].iloc[0]] * len(found) for c in by})[[*by, "lo", "hi", "n", "good"]]

    parts = blocks.groupBy(*by, F.floor(F.col("lo") / RANGE).alias("range")).applyInPandas(lambda pdf: pool(pdf), schema)
    return parts.groupBy(*by).applyInPandas(lambda pdf: pool(pdf), schema).withColumn("value", F.col("good") / F.col("n"))


def curve(model: DataFrame, by: list[str]) -> DataFrame:
    """(by, bin, calibrated) of every bin: a block's value inside it, a line between two blocks, the outer values beyond them."""
    along = W.partitionBy(*by).orderBy("lo")  # a group's blocks
    lined = model.withColumns({"first": F.when(F.row_number().over(along) == 1, F.lit(0)).otherwise(F.col("lo")), "next": F.lead("lo").over(along), "after": F.lead("value").over(along)})
    bins = lined.withColumn("bin", F.explode(F.sequence("first", F.coalesce(F.col("next") - 1, F.lit(BINS)))))
    between = F.col("value") + (F.col("after") - F.col("value")) * (F.col("bin") - F.col("hi")) / (F.col("next") - F.col("hi"))
    return bins.select(*by, "bin", F.when((F.col("bin") <= F.col("hi")) | F.col("next").isNull(), F.col("value")).otherwise(between).alias("calibrated"))


def apply(df: DataFrame, by: list[str], score: str, curves: DataFrame) -> DataFrame:
    """``df`` with ``calibrated``, null where a group has no fit."""
    return df.withColumn("bin", bin_of(F.col(score))).join(curves, [*by, "bin"], "left").drop("bin")


def thresholds(df: DataFrame, by: list[str], outcome: str, false_award: float = FALSE_AWARD) -> DataFrame:
    """(by, threshold, cost): the calibrated score from which to award at the least cost; null if no award is cheapest. Equal costs: the higher one."""
    good = F.col(outcome).cast("long")
    rows = df.filter("calibrated is not null").groupBy(*by, "calibrated").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    along = W.partitionBy(*by).orderBy("calibrated")  # a group's distinct values: BINS + 1 at most
    cost = F.coalesce(F.sum("good").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + false_award * F.sum("bad").over(along.rowsBetween(W.currentRow, W.unboundedFollowing))
    none = rows.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.sum("good").cast("double").alias("cost"))
    options = rows.select(*by, F.col("calibrated").alias("threshold"), cost.cast("double").alias("cost")).unionByName(none)
    best = options.groupBy(*by).agg(F.min(F.struct("cost", F.coalesce(-F.col("threshold"), F.lit(-2.0)).alias("order"), "threshold")).alias("best"))
    return best.select(*by, "best.threshold", "best.cost")


def awarded(df: DataFrame, by: list[str], chosen: DataFrame) -> DataFrame:
    """``df`` stamped with its group's ``threshold``, and whether it reaches it."""
    return df.join(chosen.select(*by, "threshold"), by, "left").withColumn("awarded", F.coalesce(F.col("calibrated") >= F.col("threshold"), F.lit(False)))


def calibrate(df: DataFrame, by: list[str], score: str, outcome: str, key: str | None = None, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, curves) of each group, such as (rubric version, answer type).

    ``part`` is a column of train, validate and test; without one, ``key`` is split by its hash. The report has (by, n_train, n_validate,
    n_test, threshold, cost, awards, false_awards, false_omissions, brier), the last four on the test part alone.
    """
    rows = df.withColumn("__part", F.col(part) if part else split_of(F.col(key)))
    curves = curve(fit(rows.filter("__part = 'train'"), by, score, outcome), by)
    scored = apply(rows, by, score, curves)
    chosen = thresholds(scored.filter("__part = 'validate'"), by, outcome)
    held, good = F.col("__part") == "test", F.col(outcome).cast("boolean")
    sums = awarded(scored, by, chosen).groupBy(*by).agg(
        *(F.count_if(F.col("__part") == p).alias(f"n_{p}") for p in ("train", "validate", "test")),
        F.count_if(held & F.col("awarded")).alias("awards"), F.count_if(held & F.col("awarded") & ~good).alias("false_awards"), F.count_if(held & ~F.col("awarded") & good).alias("false_omissions"),
        F.avg(F.when(held, F.pow(F.col("calibrated") - good.cast("int"), 2))).alias("brier"),
    )
    return sums.join(chosen, by, "left").select(*by, "n_train", "n_validate", "n_test", "threshold", "cost", "awards", "false_awards", "false_omissions", "brier"), curves
