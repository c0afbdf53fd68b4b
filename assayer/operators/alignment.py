"""Matching an answer's sentences with a question's marking points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions import stats

FLOOR, TOP = 0.25, 5


def unit_mean(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, vector): the mean of the group's vectors, scaled to length 1; summed component by component."""
    cells = df.select(*by, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # a vector's length
    mean = F.transform("v", lambda c: c["x"])
    size = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(*by, F.transform(mean, lambda x: x / F.nullif(size, F.lit(0.0))).alias("vector"))


def candidates(sentences: DataFrame, points: DataFrame, k: int = TOP, floor: float = FLOOR) -> DataFrame:
    """(question, point, sentence, cosine, place): each point's best sentences of its own question.

    sentences (question, sentence, vector) meet points (question, point, vector) by question; a question has as
    many points as its rubric. Ties go to the smaller sentence.
    """
    # Lengths are taken once a row, not once a pair.
    x = sentences.select("question", "sentence", F.col("vector").alias("v"), stats.size(F.col("vector")).alias("v_size"))
    y = points.select("question", "point", F.col("vector").alias("p"), stats.size(F.col("vector")).alias("p_size"))
    cosine = stats.dot(F.col("v"), F.col("p")) / F.nullif(F.col("v_size") * F.col("p_size"), F.lit(0.0))
    scored = x.join(y, "question").select("question", "point", "sentence", cosine.alias("cosine")).filter(F.col("cosine") >= floor)
    by = W.partitionBy("question", "point").orderBy(F.col("cosine").desc(), "sentence")
    return scored.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def neighbours(sentences: DataFrame) -> DataFrame:
    """(question, answer, first, second, vector): consecutive sentences of an answer, the mean of their vectors.

    sentences (question, answer, nth, sentence, vector); with ``candidates`` on these, a pair is evidence like a sentence.
    """
    by = W.partitionBy("answer").orderBy("nth")
    both = sentences.withColumns({"second": F.lead("sentence").over(by), "w": F.lead("vector").over(by)}).filter("second is not null")
    return both.select("question", "answer", F.col("sentence").alias("first"), "second", F.zip_with("vector", "w", lambda x, y: (x.cast("double") + y.cast("double")) / 2).alias("vector"))


def solve(cost: np.ndarray) -> list[int]:
    """Columns of the rows in a cheapest one-to-one assignment (rows no more than columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            k = int(np.argmin(np.where(done[1:], np.inf, least[1:]))) + 1
            step = least[k]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assign(scores: DataFrame) -> DataFrame:
    """(grp, point, sentence, score): one sentence for a point and one point for a sentence, the greatest total.

    scores (grp, point, sentence, score, and perhaps shared): a point whose ``shared`` is true takes its best sentence whatever
    others take, and leaves it to them. A group is an answer's points and sentences, some dozens of each.
    """
    if "shared" in scores.columns:
        alone = scores.filter("shared and score > 0").withColumn("place", F.row_number().over(W.partitionBy("grp", "point").orderBy(F.col("score").desc(), "sentence")))
        rest = assign(scores.filter(~F.coalesce("shared", F.lit(False))).select("grp", "point", "sentence", "score"))
        return alone.filter("place = 1").select("grp", "point", "sentence", "score").unionByName(rest)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="point", columns="sentence", values="score", aggfunc="max", fill_value=0.0).sort_index().sort_index(axis=1)
        values, turned = table.to_numpy(float), table.shape[0] > table.shape[1]
        at = solve(-(values.T if turned else values))
        pairs = [(j, i) if turned else (i, j) for i, j in enumerate(at)]
        rows = [(pdf["grp"].iloc[0], table.index[i], table.columns[j], values[i, j]) for i, j in pairs if values[i, j] > 0]
        return pd.DataFrame(rows, columns=["grp", "point", "sentence", "score"])

    return scores.groupBy("grp").applyInPandas(best, "grp long, point long, sentence long, score double")


def decide(nli: Column, nli_verdict: Column, other_verdict: Column) -> Column:
    """The first model's verdict where it is sure (0.85), else the second's, else unverifiable."""
    return F.when(nli >= 0.85, nli_verdict).otherwise(F.coalesce(other_verdict, F.lit("UNVERIFIABLE")))


def unmatched(sentences: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Well-read sentences of more than twelve tokens that no point claims."""
    rest = sentences.join(matched.select(*keys).distinct(), keys, "left_anti")
    return rest.filter((F.col("confidence") > 0.8) & (F.size(F.split(F.trim("sentence"), r"\s+")) > 12))


