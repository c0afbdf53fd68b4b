"""Capture quality, geometry and booklets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import pixels
from assayer.operators import booklet, capture, results
from assayer.session import table


def _pages(spark, sf_dir):
    """Line items as captured pages, with measures derived from their amounts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") * 5).alias("dpi"), (F.col("l_extendedprice") / 100).alias("sharpness"), (250 - F.col("l_quantity") * 4.5).alias("brightness"),
        (F.col("l_discount") * 3).alias("clipped"), (F.col("l_quantity") - 25).alias("skew"), (1 - F.col("l_tax") * 5).alias("keystone"), F.least(F.pmod("l_suppkey", F.lit(9)), F.lit(4)).alias("markers"),
    )


def _reasons():
    return capture.gate_reasons(*(F.col(c) for c in ("dpi", "sharpness", "brightness", "clipped", "skew", "keystone", "markers")))


def quality_gate(spark, sf_dir):
    judged = _pages(spark, sf_dir).withColumn("reasons", _reasons())
    return judged.groupBy(F.concat_ws(",", "reasons").alias("reasons"), capture.gate_verdict(F.col("reasons")).alias("verdict")).agg(F.count("*").alias("n"))


def rejection_reasons(spark, sf_dir):
    return capture.reason_counts(_pages(spark, sf_dir), _reasons()).select("reason", "n")


def ingest_outcome(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("reasons", _reasons())
    raw = F.when(F.pmod("l_partkey", F.lit(11)) != 0, F.concat(F.lit("p"), F.col("l_partkey")))
    flat = F.when(F.pmod("l_partkey", F.lit(13)) != 0, F.concat(F.lit("p"), F.col("l_partkey") + F.when(F.pmod("l_partkey", F.lit(17)) == 0, 1).otherwise(0)))
    rows = rows.withColumn("id", capture.identify(raw, flat))
    out = rows.withColumn("o", capture.ingest(F.col("markers"), F.col("reasons"), F.col("id.payload"), F.col("id.conflict"), F.col("l_linenumber")))
    return out.groupBy("o.outcome", "o.next_state", "o.redacted").agg(F.count("*").alias("n"), F.sum(F.size("o.why")).alias("whys"))


def capture_geometry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = F.col("value")
    rows = e.select(capture.dpi(x * 10, F.lit(186.0)).alias("dpi"), capture.skew(x + 1, x / 7).alias("skew"), capture.keystone(x + 100, x + 120).alias("keystone"), capture.region_px(x / 10, x / 8, F.lit(78.0), F.lit(20.0)).alias("a"), capture.identity_region_px(x / 10, x / 8, F.lit(78.0), F.lit(20.0), 200.0, F.lit(2339)).alias("b"))
    return rows.agg(F.round(F.avg("dpi"), 6).alias("dpi"), F.round(F.avg("skew"), 6).alias("skew"), F.round(F.avg("keystone"), 6).alias("keystone"), F.sum("a.x").alias("x"), F.sum("a.y").alias("y"), F.sum("b.y").alias("y_own"), F.max("a.w").alias("w"), F.max("a.h").alias("h"))


def image_composite(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    score = capture.composite(F.col("l_quantity") / 50, 1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_discount"))
    return li.groupBy("l_linestatus").agg(F.round(F.avg(score), 6).alias("composite"))


def pixel_measures(spark, sf_dir):
    """Embeddings as 8 x 8 images: components scaled to 0 to 255."""
    e = table(spark, sf_dir, "embeddings")
    level = lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor(x.cast("double") * 400 + 128), F.lit(0)), F.lit(255))), 2, "0")
    rows = e.select("vec_id", F.unhex(F.array_join(F.transform("embedding", level), "")).alias("image"), F.lit(8).alias("h"), (F.size("embedding") / 8).cast("int").alias("w"))
    return rows.select("vec_id", pixels.measure(F.col("image"), F.col("h"), F.col("w")).alias("m")).select("vec_id", F.round("m.sharpness", 6).alias("sharpness"), F.round("m.brightness", 6).alias("brightness"), F.round("m.clipped_fraction", 6).alias("clipped"))


def payload_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = booklet.encode_payload(F.md5(F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string")), F.pmod("o_orderkey", F.lit(7)), F.lit(5))
    odd = F.when(F.pmod("o_custkey", F.lit(10)) == 0, F.upper(raw)).otherwise(F.concat(F.lit(" "), raw))
    rows = o.select("o_orderkey", odd.alias("raw")).withColumn("p", booklet.decode_payload(F.col("raw")))
    return rows.select("o_orderkey", "p.booklet", "p.exam", "p.page_no", "p.page_total", "p.valid")


def _questions(spark, sf_dir):
    """An order's lines as the questions of a booklet, in a total order; equal lines are numbered apart."""
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("booklet"), F.row_number().over(by).cast("long").alias("nth"), booklet.suggested_height(F.col("l_quantity") / 5).alias("height"), (F.col("l_quantity") / 5).alias("marks"))


_QUESTIONS = "q AS (SELECT l_orderkey AS booklet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, least(greatest(8.0::DOUBLE + (l_quantity / 5) * 1.75::DOUBLE * 8.0::DOUBLE, 25.0), 181.0)::DOUBLE AS height, l_quantity / 5 AS marks FROM lineitem)"
_PAGES = f"""{_QUESTIONS},
p AS (SELECT booklet, nth, height, marks, 1 AS page, 187.0::DOUBLE - (height + 6) AS remaining FROM q WHERE nth = 1
  UNION ALL SELECT q.booklet, q.nth, q.height, q.marks, CASE WHEN q.height + 6 > p.remaining THEN p.page + 1 ELSE p.page END, CASE WHEN q.height + 6 > p.remaining THEN 213.0::DOUBLE ELSE p.remaining END - (q.height + 6) FROM p JOIN q ON q.booklet = p.booklet AND q.nth = p.nth + 1)"""


def paginate(spark, sf_dir):
    return booklet.paginate(_questions(spark, sf_dir)).select("booklet", "nth", "page")


def fit_to_page(spark, sf_dir):
    placed = booklet.fit_to_page(booklet.paginate(_questions(spark, sf_dir)))
    return placed.groupBy("booklet", "page").agg(F.round(F.sum("drawn"), 6).alias("drawn"), F.count("*").alias("boxes"))


def booklet_register(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("booklet"), F.lit(4).cast("long").alias("page_total"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("booklet"), F.col("l_linenumber").alias("page_no")).filter("page_no <= 4")
    return booklet.register(o, seen)


def missing_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("booklet"), F.lit(4).alias("page_total"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("booklet"), F.col("l_linenumber").alias("page_no"))
    return booklet.missing_pages(o, seen).groupBy("page_no").agg(F.count("*").alias("n"))


def slot_violations(spark, sf_dir):
    slots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("booklet"), F.col("l_linenumber").cast("string").alias("number"), (F.col("l_quantity") - 1).alias("marks"), (F.col("l_quantity") * 4).alias("height"))
    return booklet.slot_violations(slots).groupBy(F.concat_ws(",", "why").alias("why")).agg(F.count("*").alias("n"))


def formatted_marks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", booklet.format_marks((F.col("p_retailprice") / 10).cast("decimal(10,2)")).alias("shown"))


def best_pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    scans = li.select(F.col("l_orderkey").alias("script"), F.col("l_linenumber").alias("page_no"), F.col("l_partkey").alias("content"), F.col("l_quantity").alias("quality"))
    return results.best_pages(scans)


def page_layout(spark, sf_dir):
    """Where the markers' centres and the identity box fall in pixels on pages scanned at their own resolution; line items as pages."""
    box = booklet.identity_region()
    pages = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 4 + 100).alias("dpi"))
    marks = booklet.fiducials(spark).select("id", "centre_x", "centre_y", box["x"].alias("box_x"), box["y"].alias("box_y"), box["w"].alias("box_w"), box["h"].alias("box_h"))
    inch, height = F.col("dpi") / 25.4, booklet.PAGE_HEIGHT
    rows = pages.crossJoin(F.broadcast(marks))  # four markers
    placed = rows.select("id", F.rint(F.col("centre_x") * inch).alias("x"), F.rint((height - F.col("centre_y")) * inch).alias("y"), F.rint(F.col("box_x") * inch).alias("left"), F.rint((height - F.col("box_y") - F.col("box_h")) * inch).alias("top"), F.rint(F.col("box_w") * inch).alias("w"), F.rint(F.col("box_h") * inch).alias("h"), (F.col("dpi") * F.lit(booklet.PAGE_WIDTH) / 25.4 >= capture.least_pixels()).alias("enough"))
    return placed.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("x", "y", "left", "top", "w", "h")), F.count_if("enough").alias("enough"), F.count("*").alias("pages"))


def cropped_pixels(spark, sf_dir):
    """The middle of every embedding as an image, cut out, and what is left of the whole when it is painted white."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor(x.cast("double") * 100), F.lit(200))), 2, "0")), "")).alias("image"), F.lit(8).alias("h"), (F.size("embedding") / 8).cast("int").alias("w"))
    at = [F.col("image"), F.col("h"), F.col("w"), F.lit(2), F.lit(3), F.lit(3), F.lit(20)]
    return e.select("vec_id", F.hex(pixels.crop(*at)).alias("part"), F.hex(pixels.redact(*at)).alias("rest"))


QUERIES = {f.__name__: f for f in (quality_gate, rejection_reasons, ingest_outcome, capture_geometry, image_composite, pixel_measures, payload_roundtrip, paginate, fit_to_page, booklet_register, missing_pages, slot_violations, formatted_marks, best_pages, page_layout, cropped_pixels)}
_GATED = """g AS (SELECT *, list_filter([CASE WHEN markers < 4 THEN 'R_MARKERS' END, CASE WHEN dpi < 120 THEN 'R_DPI' WHEN dpi < 150 THEN 'W_DPI' END, CASE WHEN sharpness < 80 THEN 'R_SHARPNESS' WHEN sharpness < 150 THEN 'W_SHARPNESS' END, CASE WHEN abs(skew) > 12 THEN 'W_SKEW' END,
    CASE WHEN keystone < 0.70::DOUBLE THEN 'W_KEYSTONE' END, CASE WHEN brightness < 40 THEN 'R_DARK' END, CASE WHEN clipped > 0.25::DOUBLE THEN 'R_CLIPPED' END], lambda r: r IS NOT NULL) AS reasons
  FROM (SELECT l_linenumber, l_partkey, l_quantity * 5 AS dpi, l_extendedprice / 100 AS sharpness, 250 - l_quantity * 4.5::DOUBLE AS brightness, l_discount * 3 AS clipped, l_quantity - 25 AS skew, 1 - l_tax * 5 AS keystone, least(l_suppkey % 9, 4) AS markers FROM lineitem)),
v AS (SELECT *, CASE WHEN len(list_filter(reasons, lambda r: starts_with(r, 'R_'))) > 0 THEN 'REJECT' WHEN len(reasons) > 0 THEN 'WARN' ELSE 'ACCEPT' END AS verdict FROM g)"""
SQL = {
    "quality_gate": f"WITH {_GATED} SELECT array_to_string(reasons, ',') AS reasons, verdict, count(*) AS n FROM v GROUP BY ALL",
    "rejection_reasons": f"WITH {_GATED} SELECT unnest(reasons) AS reason, count(*) AS n FROM v GROUP BY 1",
    "ingest_outcome": f"""WITH {_GATED}, i AS (SELECT *, CASE WHEN l_partkey % 11 <> 0 THEN 'p' || l_partkey END AS raw, CASE WHEN l_partkey % 13 <> 0 THEN 'p' || (l_partkey + (l_partkey % 17 = 0)::INT) END AS flat FROM v),
w AS (SELECT *, CASE WHEN markers < 4 THEN 1 WHEN coalesce(raw <> flat, FALSE) THEN 1 + len(reasons) WHEN coalesce(flat, raw) IS NULL THEN 1 + len(reasons) WHEN verdict = 'REJECT' THEN len(reasons) END AS whys FROM i)
SELECT CASE WHEN whys IS NULL THEN 'INGESTED' ELSE 'REJECTED' END AS outcome, CASE WHEN whys IS NULL THEN 'OCR_RUNNING' ELSE 'QUALITY_REJECTED' END AS next_state, whys IS NULL AND l_linenumber = 1 AS redacted, count(*) AS n, sum(coalesce(whys, 0))::BIGINT AS whys FROM w GROUP BY 1, 2, 3""",
    "capture_geometry": """SELECT round(avg(value * 10 / (186.0::DOUBLE / 25.4::DOUBLE)), 6) AS dpi, round(avg(degrees(atan2(value / 7, value + 1))), 6) AS skew, round(avg((value + 100) / (value + 120)), 6) AS keystone,
  sum(round_even(value / 10 * k, 0))::BIGINT AS x, sum(round_even((297.0::DOUBLE - value / 8 - 20.0::DOUBLE) * k, 0))::BIGINT AS y, sum(2339 - round_even((value / 8 + 20.0::DOUBLE) * k, 0))::BIGINT AS y_own, max(round_even(78.0::DOUBLE * k, 0))::INTEGER AS w, max(round_even(20.0::DOUBLE * k, 0))::INTEGER AS h
  FROM (SELECT value, 200.0::DOUBLE / 25.4::DOUBLE AS k FROM events)""",
    "image_composite": "SELECT l_linestatus, round(avg(least(greatest(0.35::DOUBLE * (l_quantity / 50) + 0.25::DOUBLE * (1 - l_discount) + 0.20::DOUBLE * (1 - l_tax) + 0.20::DOUBLE * (1 - 10 * l_discount), 0.0), 1.0)), 6) AS composite FROM lineitem GROUP BY 1",
    "payload_roundtrip": """WITH r AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS b, md5(o_custkey::VARCHAR) AS e, o_orderkey % 7 AS page, o_custkey % 10 = 0 AS odd FROM orders), v AS (SELECT *, page BETWEEN 1 AND 5 AND NOT odd AS valid FROM r)
SELECT o_orderkey, CASE WHEN valid THEN b END AS booklet, CASE WHEN valid THEN e END AS exam, CASE WHEN valid THEN page END AS page_no, CASE WHEN valid THEN 5::BIGINT END AS page_total, valid FROM v""",
    "paginate": f"WITH RECURSIVE {_PAGES} SELECT booklet, nth, page::BIGINT AS page FROM p",
    "fit_to_page": f"""WITH RECURSIVE {_PAGES}, s AS (SELECT *, CASE WHEN page = 1 THEN 187.0 ELSE 213.0 END::DOUBLE - sum(height + 6) OVER w AS spare, sum(marks) OVER w AS total FROM p WINDOW w AS (PARTITION BY booklet, page))
SELECT booklet, page::BIGINT AS page, round(sum(CASE WHEN spare > 0.5 THEN height + least(CASE WHEN total > 0 THEN spare * marks / total ELSE 0 END, height * 1.5::DOUBLE) ELSE height END), 6) AS drawn, count(*) AS boxes FROM s GROUP BY 1, 2""",
    "booklet_register": """WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), s AS (SELECT l_orderkey, count(*) AS seen, max(times) AS most FROM p GROUP BY 1)
SELECT o_orderkey AS booklet, 4::BIGINT AS page_total, coalesce(seen, 0) AS seen, CASE WHEN seen IS NULL THEN 'NOT_SCANNED' WHEN seen < 4 THEN 'INCOMPLETE' WHEN most > 1 THEN 'DUPLICATE' ELSE 'COMPLETE' END AS status FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""",
    "missing_pages": "SELECT page_no, count(*) AS n FROM (SELECT o_orderkey, unnest(range(1, 5)) AS page_no FROM orders) WHERE (o_orderkey, page_no) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem) GROUP BY 1",
    "slot_violations": """WITH s AS (SELECT l_quantity - 1 AS marks, l_quantity * 4 AS height, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS used FROM lineitem),
w AS (SELECT list_filter([CASE WHEN NOT marks > 0 THEN 'MARKS' END, CASE WHEN NOT height BETWEEN 25 AND 181 THEN 'HEIGHT' END, CASE WHEN used > 1 THEN 'TWICE' END], lambda r: r IS NOT NULL) AS why FROM s)
SELECT array_to_string(why, ',') AS why, count(*) AS n FROM w WHERE len(why) > 0 GROUP BY 1""",
    "formatted_marks": r"SELECT p_partkey, regexp_replace((p_retailprice / 10)::DECIMAL(10, 2)::VARCHAR, '\.?0+$', '') AS shown FROM part",
    "best_pages": """WITH o AS (SELECT l_orderkey AS script, l_linenumber AS page_no, l_partkey AS content, max(l_quantity) AS quality FROM lineitem GROUP BY ALL)
SELECT script, page_no, arg_max(content, (quality, content)) AS content, max(quality) AS quality, count(*) AS versions FROM o GROUP BY 1, 2""",
}
SQL["page_layout"] = """WITH m AS (SELECT * FROM (VALUES (0, 14.0::DOUBLE, 283.0::DOUBLE), (1, 196.0, 283.0), (2, 196.0, 14.0), (3, 14.0, 14.0)) t(id, cx, cy)), p AS (SELECT l_quantity * 4 + 100 AS dpi, (l_quantity * 4 + 100) / 25.4::DOUBLE AS k FROM lineitem)
SELECT id, sum(round_even(cx * k, 0)) AS x, sum(round_even((297.0::DOUBLE - cy) * k, 0)) AS y, sum(round_even(25.0::DOUBLE * k, 0)) AS left, sum(round_even((297.0::DOUBLE - 218.0 - 20.0) * k, 0)) AS top, sum(round_even(78.0::DOUBLE * k, 0)) AS w, sum(round_even(20.0::DOUBLE * k, 0)) AS h, count(*) FILTER (dpi * 210.0::DOUBLE / 25.4::DOUBLE >= 1241) AS enough, count(*) AS pages FROM m, p GROUP BY id"""
