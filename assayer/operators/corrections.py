"""What markers' corrections teach: points that are overridden too often, the commonest kind of answer there, and markers' consistency.

Answers are vectors. Those of a point are alike if they lie on the same sides of ``PLANES`` fixed planes, so a kind of answer is a key and
its members are summed before any shuffle, however many a point has. The proposed exemplar is the medoid of the greatest kind: as lengths
are made equal, the answer nearest to all others is the one nearest to their sum, and no pairs are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.operators.alignment import unit_mean

#: Fixed value: the override rate from which a point is shown to its author.
TOO_MANY = 0.15
PLANES = 4


def side(vector: Column, plane: int) -> Column:
    """Which side of a plane; its normal has whole components from -5 to 5 that repeat along the vector."""
    total = F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (F.pmod(i * 7 + plane * 13 + i * i * (plane + 1), F.lit(11)) - 5)), F.lit(0.0), lambda s, x: s + x)
    return F.when(total >= 0, "1").otherwise("0")


def kind_of(vector: Column, planes: int = PLANES) -> Column:
    return F.concat(*(side(vector, p) for p in range(planes)))


def proposals(marked: DataFrame, limit: float = TOO_MANY, planes: int = PLANES) -> DataFrame:
    """(question, point, n, rate, kind, members, exemplar, nearness): one proposed exemplar for each point overridden too often.

    marked (question, point, answer, vector, overridden) has a row for each marked answer. The greatest kind counts, ties by its key; the medoid is an
    overridden answer, ties to the smaller. Points whose overridden answers have no vector get no proposal.
    """
    by = ["question", "point"]
    rates = marked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("overridden").cast("int")).alias("rate")).filter(F.col("rate") > limit)
    usable = F.col("vector").isNotNull() & (stats.dot(F.col("vector"), F.col("vector")) > 0)
    wrong = marked.filter(F.col("overridden") & usable).join(rates.select(*by), by).select(*by, "answer", "vector", kind_of(F.col("vector"), planes).alias("kind"))
    kinds = wrong.groupBy(*by, "kind").agg(F.count("*").alias("members"))
    greatest = kinds.groupBy(*by).agg(F.max_by(F.struct("kind", "members"), F.struct("members", "kind")).alias("k")).select(*by, "k.kind", "k.members")
    own = wrong.join(greatest, [*by, "kind"]).withColumn("vector", F.transform("vector", lambda x: x.cast("double") / stats.size(F.col("vector"))))
    middle = unit_mean(own, [*by, "kind"], "vector").withColumnRenamed("vector", "middle")
    near = own.join(middle, [*by, "kind"]).withColumn("nearness", F.round(stats.dot(F.col("vector"), F.col("middle")), 9))
    best = near.groupBy(*by).agg(F.min(F.struct((-F.col("nearness")).alias("far"), "answer")).alias("m"), F.max("kind").alias("kind"), F.max("members").alias("members"))
    return rates.join(best, by).select(*by, "n", "rate", "kind", "members", F.col("m.answer").alias("exemplar"), (-F.col("m.far")).alias("nearness"))


def marker_consistency(marks: DataFrame, within: float = 0.5) -> DataFrame:
    """(marker, n, exact, bias, spread) of marks (marker, script, question, mark): against the mean of the others who marked the same.

    Answers that one person marked don't count. ``exact`` is the share ``within`` so many marks, ``bias`` the mean difference.
    """
    keys = ["script", "question"]
    sums = marks.groupBy(*keys).agg(F.sum("mark").alias("total"), F.count("*").alias("markers")).filter("markers > 1")
    gap = F.col("mark") - (F.col("total") - F.col("mark")) / (F.col("markers") - 1)
    rows = marks.join(sums, keys).withColumn("gap", gap)
    return rows.groupBy("marker").agg(F.count("*").alias("n"), F.avg((F.abs("gap") <= within).cast("int")).alias("exact"), F.avg("gap").alias("bias"), F.stddev_samp("gap").alias("spread"))
