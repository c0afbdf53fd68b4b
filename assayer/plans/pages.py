"""Page images on the driver's tables: whole texts of ``documents`` as grey images 64 pixels wide, a byte a pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import images
from assayer.operators import capture, reconcile
from assayer.session import small_batches, table

WIDTH = 64


def _pages(spark, sf_dir):
    """(doc_id, image, h, w): whole texts, padded with white to full rows, in small Arrow batches."""
    small_batches(spark)
    raw = F.encode("text", "utf-8")
    rows = F.ceil(F.greatest(F.octet_length(raw), F.lit(1)) / WIDTH).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", rows.alias("h"), F.lit(WIDTH).alias("w"), raw.alias("raw")).select("doc_id", "h", "w", F.unhex(F.rpad(F.hex("raw"), F.col("h") * WIDTH * 2, F.lit("F"))).alias("image"))


def rectified_pages(spark, sf_dir):
    """Pages flattened onto 40 by 48 pixels from corners that lean by their id; every seventh lacks one."""
    k = F.pmod("doc_id", F.lit(5))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corners = F.array(at(2 + k, F.lit(1) + k / 2), at(60 - k, F.lit(0.5) + k), at(62 - k / 2, F.col("h") - 1 - k), F.when(F.pmod("doc_id", F.lit(7)) != 0, at(1 + k / 4, F.col("h") - 2.0)))
    out = images.rectify(F.col("image"), F.col("h"), F.col("w"), corners, [(2.0, 2.0), (37.0, 2.0), (37.0, 45.0), (2.0, 45.0)], 48, 40)
    return _pages(spark, sf_dir).select("doc_id", out.alias("r")).select("doc_id", F.md5("r.image").alias("digest"), F.octet_length("r.image").alias("size"), "r.error")


def page_gate(spark, sf_dir):
    measured = _pages(spark, sf_dir).select("doc_id", images.gate_measures(F.col("image"), F.col("h"), F.col("w")).alias("m"))
    g = measured.select("doc_id", "m", capture.pixel_gate(F.col("m")).alias("g"))
    return g.select("doc_id", *(F.round(f"m.{n}", 6).alias(n) for n in ("sharpness", "exposure", "contrast", "glare", "dpi", "skew", "ink")), F.round("g.overall", 6).alias("overall"), F.array_join("g.reasons", ",").alias("reasons"), "g.band")


def prepared_pages(spark, sf_dir):
    """Digests of pages turned straight and of pages lit evenly."""
    p = _pages(spark, sf_dir)
    return p.select("doc_id", F.md5(images.deskewed(F.col("image"), F.col("h"), F.col("w"))).alias("straight"), F.md5(images.evenly_lit(F.col("image"), F.col("h"), F.col("w"))).alias("lit"))


def screen_captures(spark, sf_dir):
    share = images.screen_share(F.col("image"), F.col("h"), F.col("w"))
    return _pages(spark, sf_dir).select("doc_id", F.round(share, 6).alias("share")).withColumn("suspected", F.col("share") > images.SCREEN_SHARE)


def struck_pixels(spark, sf_dir):
    """Each page's top 16 rows as a line's box, whether a run of ink strikes it out."""
    line = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(WIDTH).alias("w"), F.least("h", F.lit(16)).alias("h"))
    rows = _pages(spark, sf_dir).select("doc_id", line.alias("line"), images.strike_runs(F.col("image"), F.col("h"), F.col("w"), line).alias("runs"))
    struck = F.exists("runs", lambda r: reconcile.struck_through(r["x"], r["y"], r["width"], r["thickness"], F.col("line")))
    return rows.select("doc_id", F.size("runs").alias("runs"), struck.alias("struck"))


def upload_flags(spark, sf_dir):
    """Documents as uploads to their source's exam; ids give sizes, markers and what the spectrum says."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("upload"), F.coalesce("source", F.lit("none")).alias("exam"), F.encode("text", "utf-8").alias("content"), F.when(F.pmod(k, F.lit(11)) == 0, 1700).otherwise(1500).alias("height"), F.lit(1000).alias("width"), F.when(F.pmod(k, F.lit(17)) == 0, 2).otherwise(1).alias("marker_sets"), (F.pmod(k, F.lit(23)) == 0).alias("screen"))
    return capture.upload_flags(rows).select("upload", "first", F.array_join("flags", ",").alias("flags"))


def page_levels(spark, sf_dir):
    """The gate's measures that a histogram gives, of whole pages."""
    m = images.level_measures(F.col("image"), F.col("h"), F.col("w"))
    return _pages(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", *(F.round(f"m.{n}", 9).alias(n) for n in ("exposure", "contrast", "dpi", "ink")))


QUERIES = {f.__name__: f for f in (rectified_pages, page_gate, page_levels, prepared_pages, screen_captures, struck_pixels, upload_flags)}
SQL = {
    "page_levels": """WITH p AS (SELECT doc_id, hex(encode(text)) AS x, greatest(ceil(strlen(text) / 64), 1)::BIGINT AS h FROM documents),
b AS (SELECT doc_id, h, CASE WHEN i * 2 < length(x) THEN ('0x' || substr(x, i * 2 + 1, 2))::INTEGER ELSE 255 END AS v FROM (SELECT *, unnest(range(h * 64)) AS i FROM p)),
c AS (SELECT doc_id, any_value(h) AS h, v, count(*)::BIGINT AS n FROM b GROUP BY doc_id, v),
w AS (SELECT *, (sum(n) OVER up)::BIGINT AS cn, (sum(n * v) OVER up)::BIGINT AS cl, (sum(n) OVER whole)::BIGINT AS tn, (sum(n * v) OVER whole)::BIGINT AS tl, count(*) OVER whole AS kinds FROM c WINDOW up AS (PARTITION BY doc_id ORDER BY v), whole AS (PARTITION BY doc_id)),
g AS (SELECT *, (tl * cn - cl * tn)::DOUBLE AS d FROM w), f AS (SELECT *, CASE WHEN cn < tn THEN d * d / (cn * (tn - cn)) ELSE 0.0 END AS apart FROM g),
t AS (SELECT *, first_value(v) OVER (PARTITION BY doc_id ORDER BY apart DESC, v) AS level FROM f)
SELECT doc_id, round(1 - (coalesce(sum(n) FILTER (v < 5 OR v > 250), 0))::DOUBLE / any_value(tn), 9) AS exposure, round((min(v) FILTER (cn * 4 >= tn * 3) - min(v) FILTER (cn * 4 >= tn)) / 255::DOUBLE, 9) AS contrast, round(any_value(h) / 11.69::DOUBLE, 9) AS dpi,
  round(CASE WHEN any_value(kinds) > 1 THEN sum(n) FILTER (v <= level) / any_value(tn)::DOUBLE ELSE 0.0 END, 9) AS ink FROM t GROUP BY doc_id""",
    "upload_flags": """WITH u AS (SELECT doc_id AS upload, doc_id AS k, min(doc_id) OVER (PARTITION BY coalesce(source, 'none'), text) AS f, text IS NULL AS missing FROM documents)
SELECT upload, CASE WHEN NOT missing THEN f END AS first, array_to_string(list_filter([CASE WHEN k % 17 = 0 OR k % 11 = 0 THEN 'MULTIPLE_PAGES_IN_FRAME' END, CASE WHEN f < upload AND NOT missing THEN 'DUPLICATE_UPLOAD' END, CASE WHEN k % 23 = 0 THEN 'SUSPECTED_SCREEN_CAPTURE' END], lambda x: x IS NOT NULL), ',') AS flags FROM u""",
}
