"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a digest of their id and laid end to end, up to ``EPOCHS`` times over. A
copy that ends at word c of its source has virtual finish time c / target. All copies of all sources are taken
in the order of virtual time, ties by source, place and copy, until the budget, all words of the input, is reached. The
document that the cut falls in is taken in part. Targets sum to the budget, so a source is within about a document of its target.

Both running totals have two levels, so that a source with a third of all rows is no single task. Inside a
source, documents fall into slices of the shuffled order, slices are summed before a shuffle, and only within a
slice are documents ordered. In the queue, copies fall into ranges of virtual time, which hold about as many words each, as that
is what fair queueing makes equal; one prefix sum over the ranges finds the one that holds the cut, and only its
copies are ordered. Slices and ranges grow with the square root of the rows.

A null text has size 0 and is taken 0 times; a null source is a source of its own, after the others. Rows of
the same id and size share their place in the order in either way round, with the same total; such repeated
rows are told apart by a digest of the text. Texts count as whole, however long. Empty input gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.places import kept

#: Weights by the source's place, and how often a source may repeat.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """Totals (source_key, source, source_size, largest) with ``target``: weighted shares of the whole, filled up to EPOCHS times a source's size.

    With sources in the order of size to weight, some first ones are capped and the rest share what is left by
    weight; the first place where the share is no more than the next cap settles it. One row a source is ordered here.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))).cast("int") + 1).cast("double")
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(EPOCHS)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / rest)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.min_by(fits, F.when(fits.isNotNull(), F.col("cap") / F.col("weight"))).over(everything)
    return levels.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("source_key", "source_size", "target", "largest")


def sized(df: DataFrame, key: str, text: str, source: str, whole: bool) -> DataFrame:
    """(doc_id, source, source_key, size, shuffled, tie), and ``row`` if ``whole``."""
    rest = [F.struct(*df.columns).alias("row")] if whole else []
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(SEED)))
    docs = df.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), digest.alias("shuffled"), F.xxhash64(text).alias("tie"), *rest)
    return docs.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))


def sliced(docs: DataFrame, number: int) -> DataFrame:
    """``slice``: an order-preserving cut of the digest's first eight digits."""
    return docs.withColumn("slice", F.shiftright(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * number, 32).cast("int"))


def slice_starts(docs: DataFrame) -> DataFrame:
    """(source_key, slice, slice_start, source_size, target, largest): the words of a source before each slice."""
    slices = docs.groupBy("source_key", "source", "slice").agg(F.sum("size").alias("slice_size"), F.max("size").alias("largest"))
    order = W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    placed = slices.select("source_key", "slice", F.coalesce(F.sum("slice_size").over(order), F.lit(0)).alias("slice_start"))
    totals = slices.groupBy("source_key", "source").agg(F.sum("slice_size").alias("source_size"), F.max("largest").alias("largest"))
    return placed.join(targets(totals), "source_key")


def laid(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """``end``: where each document ends in its source."""
    within = W.partitionBy("source_key", "slice").orderBy("shuffled", "tie", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = docs.withColumn("within", F.sum("size").over(within)).join(starts, ["source_key", "slice"])
    return placed.withColumn("end", F.col("slice_start") + F.col("within")).drop("slice", "slice_start", "within", "shuffled", "tie")


def finish(copy: int) -> Column:
    return (F.col("end") + F.col("source_size") * copy) / F.col("target")


def cut(placed: DataFrame) -> tuple[float, str, int, int, int] | None:
    """(finish, source_key, end, copy, words) of the copy at which the queue reaches the budget, and how much of it fits."""
    real = placed.filter("size > 0")
    # By this time every source has its target or all its copies, so the cut is not later.
    whole = real.groupBy("source_key").agg(F.first("source_size").alias("n"), F.first("largest").alias("largest"), F.first("target").alias("target"), F.count("*").alias("rows"))
    total = whole.agg(F.sum("n").alias("budget"), F.max(1 + F.col("largest") / F.col("target")).alias("latest"), F.sum("rows").alias("rows")).first()
    if not total.budget:
        return None
    ranges = max(1, math.isqrt(total.rows))
    copies = real.select("source_key", "end", "size", F.posexplode(F.array(*(finish(e) for e in range(EPOCHS)))).alias("copy", "finish"))
    queue = copies.filter(F.col("finish") <= total.latest).withColumn("range", F.floor(F.col("finish") * ranges))
    sums = queue.groupBy("range").agg(F.sum("size").alias("words"))
    reached = sums.withColumn("reached", F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)))
    at = reached.filter(F.col("reached") >= total.budget).orderBy("range").first()
    order = W.orderBy("finish", "source_key", "end", "copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = queue.filter(F.col("range") == at.range).withColumn("upto", F.sum("size").over(order) + (at.reached - at.words))
    last = inside.filter(F.col("upto") >= total.budget).orderBy("upto").first()
    return last.finish, last.source_key, last.end, last.copy, last.size - (last.upto - total.budget)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, virtual_finish) of every row; ``whole`` adds the row itself as ``row``."""
    narrow = kept(sized(df, key, text, source, False), "sized")  # what is ordered to find the cut holds no texts
    number = max(1, math.isqrt(narrow.count()))
    starts = kept(slice_starts(sliced(narrow, number)), "slices")
    placed = kept(laid(sliced(narrow, number), starts), "laid")
    last = cut(placed)
    if whole:
        placed = laid(sliced(sized(df, key, text, source, True), number), starts)
    taken = F.lit(0)
    for e in range(EPOCHS if last else 0):
        at, own, end, copy, words = last
        same = (finish(e) == at) & (F.col("source_key") == own) & (F.col("end") == end)
        before = (finish(e) < at) | ((finish(e) == at) & ((F.col("source_key") < own) | ((F.col("source_key") == own) & ((F.col("end") < end) | ((F.col("end") == end) & F.lit(e < copy))))))
        taken = taken + F.when(F.col("size") == 0, 0).when(same & F.lit(e == copy), words).when(before, F.col("size")).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("virtual_finish"), *(["row"] if whole else []))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.split(F.concat(F.lit(" "), text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.regexp_replace(F.substring(F.array_join(F.slice(parts, F.lit(1), n.cast("int") + 1), ""), 2, 2**31 - 1), r"[\x20\x09-\x0D]+$", "")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", parts: bool = True) -> DataFrame:
    """The mix itself: rows of ``df``, repeated as often as they are taken, in the order of virtual time.

    A document that the cut falls in comes once more with as many of its first words as fit; without ``parts`` it
    comes whole if at least half of it fits, else not, so a source is within half a document of its words.
    """
    rows = mix(df, key, text, source, whole=True).filter("taken > 0")
    copies = F.floor((F.col("taken") + F.col("size") - 1) / F.col("size"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    own = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    rows = rows.withColumn("own", own).withColumn("at", F.col("virtual_finish") + F.col("copy") * F.col("source_size") / F.col("target"))
    if not parts:
        rows = rows.filter(F.col("own") * 2 >= F.col("size")).withColumn("own", F.col("size"))
    rows = rows.orderBy("at", "doc_id", "copy")
    shown = F.col("row").getField(text)
    short = F.when(F.col("own") < F.col("size"), first_words(shown, F.col("own"))).otherwise(shown)
    return rows.select(*((short if c == text else F.col("row").getField(c)).alias(c) for c in df.columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "virtual_finish").orderBy("virtual_finish", "doc_id")


OP5_SQL = """
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(source AS VARCHAR) AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || 'mix-1') AS shuffled
  FROM documents),
totals AS (
  SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM docs GROUP BY source),
caps AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM caps WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (
  SELECT source, source_size::BIGINT AS source_size,
         coalesce(least(cap, (SELECT arg_min(level, cap / weight) FROM levels WHERE level <= cap / weight) * weight), cap)::DOUBLE AS target
  FROM levels),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY shuffled ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM docs),
copies AS (
  SELECT doc_id, l.source, size, source_size, target, stop, copy, CASE WHEN target > 0 THEN CAST(stop + source_size * copy AS DOUBLE) / target END AS finish
  FROM laid l JOIN settled s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS copy)),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, stop, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies WHERE size > 0)
SELECT c.doc_id, any_value(c.size) AS size, any_value(c.source_size) AS source_size, any_value(c.target) AS target,
  CAST(coalesce(sum(greatest(0, least(q.size, (SELECT sum(size) FROM docs) - (q.upto - q.size)))), 0) AS BIGINT) AS taken, min(c.finish) AS virtual_finish
FROM copies c LEFT JOIN queue q ON q.doc_id = c.doc_id AND q.copy = c.copy GROUP BY c.doc_id
"""
