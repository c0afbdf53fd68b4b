"""Results and operations: pivots, statistics, calibration, moderation, assembly, fairness and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def results_pivot(scores: DataFrame, numbers: list) -> DataFrame:
    """(script, one column a question, total): the questions of an exam are known, so one pass suffices."""
    wide = scores.groupBy("script").pivot("question", numbers).agg(F.sum("marks"))
    return wide.join(scores.groupBy("script").agg(F.sum("marks").alias("total")), "script")


def statistics(df: DataFrame, by: list[str], value: str, most: str, pass_share: float = 0.5) -> DataFrame:
    """Count, mean, median, deviation, difficulty and pass rate."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.percentile(x, 0.5), 6).alias("median"), F.round(F.stddev_samp(x), 6).alias("sd"), F.round(F.avg(x / F.nullif(F.col(most), F.lit(0.0))), 6).alias("difficulty"), F.round(F.avg((x >= F.col(most) * pass_share).cast("int")), 6).alias("pass_rate"))


def discrimination(df: DataFrame, by: list[str], item: str, total: str) -> DataFrame:
    """Correlation of an item with the rest of the total; null without spread."""
    return df.groupBy(*by).agg(F.round(F.corr(F.col(item), F.col(total) - F.col(item)), 6).alias("discrimination"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def calibration_bins(df: DataFrame, score: str, outcome: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, actual) of scores from 0 to 1."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("predicted"), F.round(F.avg(F.col(outcome).cast("double")), 6).alias("actual"))


def split_of(key: Column) -> Column:
    """train, validate or test by a hash of the key: 60, 20 and 20 per cent, the same on every run."""
    place = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(100))
    return F.when(place < 60, "train").when(place < 80, "validate").otherwise("test")


def best_threshold(df: DataFrame, score: str, outcome: str, false_award: float = 3.0, ranges: int = 4096) -> DataFrame:
    """(threshold, cost): the score from which to award at least cost, a false award weighing three omissions.

    Equal scores are summed first. The running sums have two levels: over ranges of scores from 0 to 1, and within a range.
    """
    good = F.col(outcome).cast("int")
    rows = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    rows = rows.withColumn("range", F.floor(F.col("threshold") * ranges))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    sums = sums.select("range", F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g"), (F.sum("b").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("b").over(before), F.lit(0))).alias("b"))
    inside = W.partitionBy("range").orderBy("threshold").rowsBetween(W.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    costs = rows.join(sums, "range").select("threshold", (F.col("g") + within("good") + false_award * (F.col("b") - within("bad"))).alias("cost"))
    return costs.orderBy("cost", "threshold").limit(1)


def isotonic(df: DataFrame, score: str, outcome: str, out: str = "calibrated") -> DataFrame:
    """``df`` with scores mapped by isotonic regression fitted on all its rows."""
    rows = VectorAssembler(inputCols=[score], outputCol="__x").transform(df.withColumn("__y", F.col(outcome).cast("double")))
    return IsotonicRegression(featuresCol="__x", labelCol="__y", predictionCol=out).fit(rows).transform(rows).drop("__x", "__y")


def platt(df: DataFrame, score: str, outcome: str, out: str = "calibrated") -> DataFrame:
    """``df`` with scores mapped by a sigmoid fitted on all its rows, for where data is scarce."""
    rows = VectorAssembler(inputCols=[score], outputCol="__x").transform(df.withColumn("__y", F.col(outcome).cast("double")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return rows.withColumn(out, 1 / (1 + F.exp(-(F.col(score) * float(model.coefficients[0]) + float(model.intercept))))).drop("__x", "__y")


def misplaced(similarities: DataFrame) -> DataFrame:
    """(answer, question, best, own, other): answers that are more similar to another question's prompt than to their own's.

    similarities (answer, question, prompt, similarity), a row for each prompt of the exam; flagged, never moved.
    """
    own, other = F.max(F.when(F.col("prompt") == F.col("question"), F.col("similarity"))), F.when(F.col("prompt") != F.col("question"), F.struct("similarity", -F.col("prompt")))
    found = similarities.groupBy("answer", "question").agg(own.alias("own"), F.max(other).alias("o"))
    return found.filter(F.col("o.similarity") > F.col("own")).select("answer", "question", (-F.col("o.col2")).alias("best"), "own", F.col("o.similarity").alias("other"))


def override_rates(df: DataFrame, by: list[str], overridden: Column, limit: float = 0.15) -> DataFrame:
    rate = F.avg(overridden.cast("int"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(rate, 6).alias("rate"), (rate > limit).alias("too_many"))


def drift(df: DataFrame, group: str, period: Column, overridden: Column, allowed: float = 0.5) -> DataFrame:
    """(group, baseline, latest, drifted): the later period's override rate against the earlier's and half more."""
    late, rate = period, overridden.cast("int")
    out = df.groupBy(group).agg(F.avg(F.when(~late, rate)).alias("b"), F.avg(F.when(late, rate)).alias("l"))
    return out.select(group, F.round("b", 6).alias("baseline"), F.round("l", 6).alias("latest"), F.coalesce(F.col("l") > F.col("b") * (1 + allowed), F.lit(False)).alias("drifted"))


def sampled(df: DataFrame, key: str, per_cent: int, salt: str = "moderate") -> DataFrame:
    """A share of the rows, chosen by a digest of the key: the same rows each time."""
    return df.filter(F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(salt)).cast("binary")), F.lit(100)) < per_cent)


def moderation(scores: DataFrame, key: str, boundaries: list[float], band: float, per_cent: int) -> DataFrame:
    """``why`` of every script to look at: overridden, near a grade boundary, or in the sample."""
    near = reduce(lambda a, b: a | b, [F.abs(F.col("total") - x) <= band for x in boundaries])
    drawn = F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit("moderate")).cast("binary")), F.lit(100)) < per_cent
    why = F.when(F.col("overridden"), "OVERRIDDEN").when(near, "BOUNDARY").when(drawn, "SAMPLE")
    return scores.withColumn("why", why).filter("why is not null")


def largest_differences(df: DataFrame, a: str, b: str, tie: list[str]) -> DataFrame:
    return df.withColumn("difference", F.abs(F.col(a) - F.col(b))).filter("difference > 0").orderBy(F.col("difference").desc(), *tie)


def latest_versions(df: DataFrame, key: str, superseded_by: str) -> DataFrame:
    """Rows that no other row replaces: none points to a successor that exists."""
    return df.join(df.select(F.col(key).alias(superseded_by)), superseded_by, "left_anti").select(*df.columns)


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """(script, at, kind, note) of several event tables, in order."""
    rows = [df.select("script", "at", F.lit(kind).alias("kind"), F.col("note").cast("string").alias("note")) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).orderBy("script", "at", "kind", "note")


def identical_answers(df: DataFrame, key: str, column: str) -> DataFrame:
    """(digest, copies, first): normalised texts that several rows share."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(column)), r"[ \t\n\r]+", " "))
    return df.groupBy(F.md5(plain).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).filter("copies > 1")


def where(df: DataFrame, equal: dict | None = None, between: dict | None = None) -> DataFrame:
    """Rows of a dashboard's filters: equal to a value or one of a list, from a lower to an upper bound; None leaves a side open."""
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    for name, (low, high) in (between or {}).items():
        df = df if low is None else df.filter(F.col(name) >= low)
        df = df if high is None else df.filter(F.col(name) <= high)
    return df


def integrity(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, subject) of several detectors' findings, each with a column ``subject``: the queue for the exams officer."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("subject").cast("string").alias("subject")) for kind, df in parts.items()])


def duplicate_booklets(scans: DataFrame) -> DataFrame:
    """(booklet, pages): booklets of which a page was scanned with different contents, and how many such pages; scans (booklet, page_no, content)."""
    pages = scans.groupBy("booklet", "page_no").agg((F.min("content") != F.max("content")).alias("several"))
    return pages.filter("several").groupBy("booklet").agg(F.count("*").alias("pages"))


def best_pages(scans: DataFrame) -> DataFrame:
    """One scan of each page (script, page_no, content, quality): copies by content fall away, then the best quality stays."""
    once = scans.groupBy("script", "page_no", "content").agg(F.max("quality").alias("quality"))
    return once.groupBy("script", "page_no").agg(F.max_by("content", F.struct("quality", "content")).alias("content"), F.max("quality").alias("quality"), F.count("*").alias("versions"))


def fair_queue(jobs: DataFrame, tenant: str, order: list[str], most: int = 50) -> DataFrame:
    """(…, turn): each tenant's first jobs up to its cap; by turn, then tenant, is round robin."""
    nth = F.row_number().over(W.partitionBy(tenant).orderBy(*order))
    return jobs.withColumn("turn", nth).filter(F.col("turn") <= most)


def workers(depth: Column) -> Column:
    return F.least(F.greatest(F.ceil(depth / 40), F.lit(1)), F.lit(20))


def retention(df: DataFrame, at: str, today: Column, image_days: int = 180, mark_days: int = 2555) -> DataFrame:
    """(action, n): what a purge would remove; nothing is removed here."""
    age = F.datediff(today, F.col(at))
    action = F.when(age > mark_days, "PURGE_MARKS").when(age > image_days, "PURGE_IMAGES").otherwise("KEEP")
    return df.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def usage(df: DataFrame, by: list[str], cost: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("cost"))
