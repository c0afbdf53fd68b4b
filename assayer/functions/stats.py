"""Agreement and confidence measures as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, lo: Column, hi: Column, step: float) -> Column:
    """Half-even bucket index of a rating, clipped to the scale."""
    return F.least(F.greatest(F.rint((value - lo) / F.lit(step)), F.lit(0.0)), F.rint((hi - lo) / F.lit(step)))


def kappa(i: Column, j: Column) -> Column:
    """Quadratic weighted kappa of bucket indices, from sums alone.

    The weights' denominator cancels, so no matrix is needed. Without spread on either side the expected
    disagreement is 0: kappa is 1 if the raters agree throughout, else 0. Null without rows.
    """
    n = F.count(F.when(i.isNotNull() & j.isNotNull(), 1))
    observed = F.sum((i - j) * (i - j))
    expected = F.sum(i * i) + F.sum(j * j) - 2 * F.sum(i) * F.sum(j) / F.nullif(n, F.lit(0))
    return F.when(n == 0, F.lit(None).cast("double")).when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / F.nullif(expected, F.lit(0.0)))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def line_confidence(words: Column) -> Column:
    """Mean of word confidences, but no more than 1 - 2 sample deviations; 0 without words."""
    return F.when(F.count(words) == 0, 0.0).otherwise(clamp01(F.least(F.avg(words), 1 - 2 * F.coalesce(F.stddev_samp(words), F.lit(0.0)))))


def page_confidence(lines: Column) -> Column:
    return F.when(F.count(lines) == 0, 0.0).otherwise(clamp01(F.avg(lines)))


def overall_confidence(*parts: Column) -> Column:
    """The weakest part; null if any is null."""
    any_null = parts[0].isNull()
    for p in parts[1:]:
        any_null = any_null | p.isNull()
    return F.when(~any_null, F.least(*parts) if len(parts) > 1 else parts[0])


def semantic_confidence(verdict: Column, ocr: Column, unverifiable: Column, penalty: Column) -> Column:
    return 0.45 * F.avg(verdict) + 0.30 * F.avg(ocr) + 0.15 * (1 - F.avg(unverifiable.cast("int"))) + 0.10 * (1 - F.max(penalty))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def size(v: Column) -> Column:
    return F.sqrt(dot(v, v))
