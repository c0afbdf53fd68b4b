"""Booklets: payload text, box heights, pagination and the register of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators.folds import ordered_fold

#: Fixed values in millimetres: usable page heights, box limits, gap, title, growth and lines.
FIRST_PAGE, OTHER_PAGE, LOWEST, HIGHEST, GAP, TITLE = 187.0, 213.0, 25.0, 181.0, 6.0, 8.0
LINES_A_MARK, LINE, GROWTH = 1.75, 8.0, 1.5
PAGE_WIDTH, PAGE_HEIGHT, MARKER, MARKER_MARGIN, QR = 210.0, 297.0, 12.0, 8.0, 26.0
CONTENT_MARGIN, IDENTITY_WIDTH, IDENTITY_HEIGHT = 25.0, 78.0, 20.0
PAYLOAD = r"^MA1:([0-9a-f]{32}):([0-9a-f]{32}):([0-9]+):([0-9]+)$"


def fiducials(spark: SparkSession) -> DataFrame:
    """(id, x, y, centre_x, centre_y) in mm from the bottom left, from the top left marker clockwise."""
    near, right, top = MARKER_MARGIN, PAGE_WIDTH - MARKER_MARGIN - MARKER, PAGE_HEIGHT - MARKER_MARGIN - MARKER
    corners = spark.createDataFrame([(0, near, top), (1, right, top), (2, right, near), (3, near, near)], "id int, x double, y double")
    return corners.withColumns({"centre_x": F.col("x") + MARKER / 2, "centre_y": F.col("y") + MARKER / 2})


def identity_region(header_bottom: Column | None = None) -> Column:
    """(x, y, w, h) in mm from the bottom left, below the header."""
    bottom = F.lit(PAGE_HEIGHT - CONTENT_MARGIN - QR - 8.0) if header_bottom is None else header_bottom
    return F.struct(F.lit(CONTENT_MARGIN).alias("x"), (bottom - IDENTITY_HEIGHT).alias("y"), F.lit(IDENTITY_WIDTH).alias("w"), F.lit(IDENTITY_HEIGHT).alias("h"))


def encode_payload(booklet: Column, exam: Column, page: Column, total: Column) -> Column:
    return F.concat_ws(":", F.lit("MA1"), F.replace(booklet, F.lit("-"), F.lit("")), F.replace(exam, F.lit("-"), F.lit("")), page.cast("string"), total.cast("string"))


def decode_payload(raw: Column) -> Column:
    """(booklet, exam, page_no, page_total, valid): nulls where the text isn't exactly a payload."""
    own = F.trim(raw)
    part = lambda i: F.regexp_extract(own, PAYLOAD, i)
    page, total = F.try_to_number(part(3), F.lit("9999999999")).cast("long"), F.try_to_number(part(4), F.lit("9999999999")).cast("long")
    valid = F.coalesce(own.rlike(PAYLOAD) & (page >= 1) & (page <= total), F.lit(False))
    show = lambda c: F.when(valid, c)
    return F.struct(show(part(1)).alias("booklet"), show(part(2)).alias("exam"), show(page).alias("page_no"), show(total).alias("page_total"), valid.alias("valid"))


def suggested_height(marks: Column) -> Column:
    return F.least(F.greatest(TITLE + marks * LINES_A_MARK * LINE, F.lit(LOWEST)), F.lit(HIGHEST))


def usable_height(page: Column) -> Column:
    return F.when(page == 1, FIRST_PAGE).otherwise(OTHER_PAGE)


def _place(state: dict, row: dict) -> dict:
    needed = row["height"] + GAP
    if state["filled"] and needed > state["left"]:
        state["page"], state["filled"], state["left"] = state["page"] + 1, 0, OTHER_PAGE
    state["filled"], state["left"] = state["filled"] + 1, state["left"] - needed
    return {**row, "page": state["page"]}


def paginate(questions: DataFrame) -> DataFrame:
    """(booklet, nth, height, marks, page): boxes in order, a new page where the next doesn't fit a begun one."""
    return ordered_fold(questions.select("booklet", "nth", "height", "marks"), ["booklet"], ["nth"], lambda: {"page": 1, "filled": 0, "left": FIRST_PAGE}, _place, "booklet long, nth long, height double, marks double, page long")


def fit_to_page(placed: DataFrame) -> DataFrame:
    """``drawn``: spare height of a page shared by marks, at most GROWTH times a box's own height."""
    by = W.partitionBy("booklet", "page")
    spare = usable_height(F.col("page")) - F.sum(F.col("height") + GAP).over(by)
    total = F.sum("marks").over(by)
    share = F.when(total > 0, spare * F.col("marks") / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return placed.withColumn("drawn", F.when(spare > 0.5, F.col("height") + F.least(share, F.col("height") * GROWTH)).otherwise(F.col("height")))


def slot_violations(slots: DataFrame) -> DataFrame:
    """Slots (booklet, number, marks, height) with a blank number, no marks, a height out of range, or a number used twice."""
    used = slots.groupBy("booklet", "number").agg(F.count("*").alias("used"))
    rows = slots.join(used, ["booklet", "number"], "left")
    why = F.array_compact(F.array(F.when(F.coalesce(F.trim("number") == "", F.lit(True)), "BLANK"), F.when(~F.coalesce(F.col("marks") > 0, F.lit(False)), "MARKS"), F.when(~F.coalesce(F.col("height").between(LOWEST, HIGHEST), F.lit(False)), "HEIGHT"), F.when(F.col("used") > 1, "TWICE")))
    return rows.withColumn("why", why).filter(F.size("why") > 0).drop("used")


def format_marks(marks: Column) -> Column:
    """Decimal text without trailing zeros or an exponent."""
    own = marks.cast("string")
    return F.when(F.instr(own, ".") > 0, F.regexp_replace(own, r"\.?0+$", "")).otherwise(own)


def register(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """(booklet, page_total, seen, status): expected (booklet, page_total) against scans (booklet, page_no)."""
    pages = scanned.groupBy("booklet", "page_no").agg(F.count("*").alias("times"))
    seen = pages.groupBy("booklet").agg(F.count("*").alias("seen"), F.max("times").alias("most"))
    joined = expected.join(seen, "booklet", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    status = F.when(F.col("seen") == 0, "NOT_SCANNED").when(F.col("seen") < F.col("page_total"), "INCOMPLETE").when(F.col("most") > 1, "DUPLICATE").otherwise("COMPLETE")
    return joined.withColumn("status", status).drop("most")


def missing_pages(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """(booklet, page_no) of pages that no scan shows."""
    due = expected.filter("page_total >= 1").select("booklet", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_total").cast("long"))).alias("page_no"))
    return due.join(scanned.select("booklet", F.col("page_no").cast("long").alias("page_no")).distinct(), ["booklet", "page_no"], "left_anti")
