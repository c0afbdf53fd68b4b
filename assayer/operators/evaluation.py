"""Scoring of transcriptions and marks against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import stats, text

#: Gates on character error rate (two tiers) and on kappa.
CER_TIER1, CER_TIER2, KAPPA = 0.08, 0.06, 0.70


def truth(adjudicated: Column, a: Column, b: Column) -> Column:
    return F.coalesce(adjudicated, (a + b) / 2)


def line_key(booklet: Column, page: Column, line: Column) -> Column:
    return F.concat_ws(":", booklet, page, line)


def mark_key(booklet: Column, question: Column) -> Column:
    return F.concat_ws(":", booklet, question)


def legible(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("illegible"))


def pooled(df: DataFrame, by: list[str], errors: str, length: str) -> DataFrame:
    """Pooled error rate of each group: summed errors over summed lengths, never a mean of rates."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(errors).alias("errors"), F.sum(length).alias("length"))
    return out.withColumn("rate", text.rate(F.col("errors"), F.col("length"))).withColumn("accuracy", text.accuracy(F.col("rate")))


def score_transcriptions(lines: DataFrame, predictions: DataFrame, keys: list[str], unicode: bool = True) -> DataFrame:
    """One row: measured, skipped (illegible) and missing lines, pooled character and word error rates.

    A line without a prediction is missing, not scored as empty.
    """
    ref, hyp = (text.normalise(F.col(c), unicode=unicode) for c in ("text", "predicted"))
    joined = lines.join(predictions.select(*keys, F.col("text").alias("predicted"), F.lit(True).alias("found")), keys, "left")
    scored = joined.select("illegible", "found", ref.alias("ref"), hyp.alias("hyp")).withColumn("use", ~F.col("illegible") & F.coalesce("found", F.lit(False)))
    scored = scored.withColumn("r", text.tokens(F.col("ref"))).withColumn("h", text.tokens(F.col("hyp")))
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("use"), c)), F.lit(0))
    out = scored.agg(
        F.count_if("use").alias("measured"),
        F.count_if(F.col("illegible")).alias("skipped"),
        F.count_if(~F.col("illegible") & F.col("found").isNull()).alias("missing"),
        pick(text.char_errors(F.col("ref"), F.col("hyp"))).alias("char_errors"),
        pick(F.length("ref")).alias("chars"),
        pick(text.word_errors(F.col("r"), F.col("h"))).alias("word_errors"),
        pick(F.size("r")).alias("words"),
    )
    cer, wer = text.rate(F.col("char_errors"), F.col("chars")), text.rate(F.col("word_errors"), F.col("words"))
    return out.select("*", cer.alias("cer"), wer.alias("wer")).withColumns({"tier1": gate(F.col("cer") <= CER_TIER1), "tier2": gate(F.col("cer") <= CER_TIER2)})


def gate(passes: Column) -> Column:
    return F.when(passes, "PASS").otherwise("FAIL")


def score_marks(marks: DataFrame, predictions: DataFrame, keys: list[str], step: float = 0.5) -> DataFrame:
    """One row: kappa of system against truth and of marker against marker on the same matched marks.

    The scale runs from 0 to the greatest maximum among matched marks. Without a match both are null.
    """
    both = marks.join(predictions.select(*keys, "mark"), keys)
    scale = both.agg(F.max("max_marks").alias("scale"))
    rows = both.crossJoin(F.broadcast(scale))  # the scale is one row
    at = lambda c: stats.bucket(c, F.lit(0.0), F.col("scale"), step)
    rows = rows.select("scale", at(F.col("mark")).alias("s"), at(truth(F.col("adjudicated"), F.col("marker_a"), F.col("marker_b"))).alias("t"), at(F.col("marker_a")).alias("a"), at(F.col("marker_b")).alias("b"))
    out = rows.agg(F.count("*").alias("matched"), F.max("scale").alias("scale"), F.round(stats.kappa(F.col("s"), F.col("t")), 6).alias("kappa_system"), F.round(stats.kappa(F.col("a"), F.col("b")), 6).alias("kappa_markers"))
    return out.withColumn("at_parity", F.col("kappa_system") >= F.col("kappa_markers")).withColumn("verdict", gate(F.coalesce(F.col("kappa_system") >= KAPPA, F.lit(False))))


def agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Exact agreement, agreement within one, mean absolute difference and counts of disagreement."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((gap == 0).cast("int")), 6).alias("exact"), F.round(F.avg((gap <= 1).cast("int")), 6).alias("within_one"), F.round(F.avg(gap), 6).alias("mae"), F.count_if(gap > 0).alias("disagreements"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def golden_summary(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: booklets over both relations, lines, illegible lines, marks, marks where the markers differ."""
    booklets = lines.select("booklet_id").union(marks.select("booklet_id")).agg(F.count_distinct("booklet_id").alias("booklets"))
    of_lines = lines.agg(F.count("*").alias("lines"), F.count_if("illegible").alias("illegible"))
    of_marks = marks.agg(F.count("*").alias("marks"), F.count_if(F.col("marker_a") != F.col("marker_b")).alias("disagreements"))
    return booklets.crossJoin(of_lines).crossJoin(of_marks)  # three single rows


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def mark_violations(marks: DataFrame) -> DataFrame:
    """Marks outside 0 to the maximum; adjudicated marks are not checked."""
    off = lambda c: ~F.coalesce(F.col(c).between(0, F.col("max_marks")), F.lit(False))
    return marks.filter(off("marker_a") | off("marker_b"))


def routing_quality(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """Rates of false awards and omissions, precision and recall of a binary decision."""
    t, g = F.col(truth) > 0, F.col(guess) > 0
    share = lambda a, b: F.round(F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return df.groupBy(*by).agg(share(g, ~t).alias("false_award"), share(~g, t).alias("false_omission"), share(t, g).alias("precision"), share(g, t).alias("recall"))
