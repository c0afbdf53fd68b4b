"""Capture quality and geometry: the gate, page measures and the ingest decision, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the gate, and the page in millimetres.
MARKERS, DPI_REJECT, DPI_WARN, SHARP_REJECT, SHARP_WARN = 4, 120.0, 150.0, 80.0, 150.0
SKEW, KEYSTONE, DARK, CLIPPED = 12.0, 0.70, 40.0, 0.25
PAGE_MM = (210.0, 297.0)


def gate_reasons(dpi: Column, sharpness: Column, brightness: Column, clipped: Column, skew: Column, keystone: Column, markers: Column) -> Column:
    """Codes of what is wrong, in the order of checking; null measures count as failing."""
    fails = lambda c: F.coalesce(c, F.lit(True))
    return F.array_compact(
        F.array(
            F.when(fails(markers < MARKERS), "R_MARKERS"),
            F.when(fails(dpi < DPI_REJECT), "R_DPI").when(dpi < DPI_WARN, "W_DPI"),
            F.when(fails(sharpness < SHARP_REJECT), "R_SHARPNESS").when(sharpness < SHARP_WARN, "W_SHARPNESS"),
            F.when(fails(F.abs(skew) > SKEW), "W_SKEW"),
            F.when(fails(keystone < KEYSTONE), "W_KEYSTONE"),
            F.when(fails(brightness < DARK), "R_DARK"),
            F.when(fails(clipped > CLIPPED), "R_CLIPPED"),
        )
    )


def gate_verdict(reasons: Column) -> Column:
    return F.when(F.exists(reasons, lambda r: r.startswith("R_")), "REJECT").when(F.size(reasons) > 0, "WARN").otherwise("ACCEPT")


def reason_counts(pages: DataFrame, reasons: Column) -> DataFrame:
    """(reason, n, pages): how many of all pages each reason holds back."""
    named = pages.select(F.explode_outer(F.when(F.size(reasons) > 0, reasons)).alias("reason"))
    counts = named.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.filter("reason is not null").crossJoin(pages.agg(F.count("*").alias("pages")))  # one row


def composite(sharp: Column, contrast: Column, exposure: Column, glare: Column) -> Column:
    return F.least(F.greatest(0.35 * sharp + 0.25 * contrast + 0.20 * exposure + 0.20 * (1 - 10 * glare), F.lit(0.0)), F.lit(1.0))


def dpi(pixels: Column, millimetres: Column) -> Column:
    """Null without a length."""
    return F.when(millimetres > 0, pixels / (millimetres / 25.4))


def least_pixels(at_dpi: float = DPI_WARN, millimetres: float = PAGE_MM[0]) -> int:
    """The shortest image edge that clears the gate, rounded up."""
    return math.ceil(at_dpi * millimetres / 25.4)


def skew(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def keystone(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0.0))


def pixels(mm: Column, at_dpi: float) -> Column:
    """Half-even rounding to whole pixels."""
    return F.rint(mm * (at_dpi / 25.4)).cast("int")


def region_px(x: Column, y: Column, w: Column, h: Column, at_dpi: float = 200.0) -> Column:
    """A rectangle measured in mm from the bottom left, in pixels from the top left."""
    return F.struct(pixels(x, at_dpi).alias("x"), pixels(PAGE_MM[1] - y - h, at_dpi).alias("y"), pixels(w, at_dpi).alias("w"), pixels(h, at_dpi).alias("h"))


def identity_region_px(x: Column, y: Column, w: Column, h: Column, at_dpi: float, page_height: Column) -> Column:
    """As above, but measured against the image's own height; may differ by a pixel."""
    return F.struct(pixels(x, at_dpi).alias("x"), (page_height - pixels(y + h, at_dpi)).alias("y"), pixels(w, at_dpi).alias("w"), pixels(h, at_dpi).alias("h"))


def identify(raw: Column, rectified: Column) -> Column:
    """(payload, conflict): the rectified reading wins, two different readings are none."""
    conflict = F.coalesce(raw != rectified, F.lit(False))
    return F.struct(F.when(~conflict, F.coalesce(rectified, raw)).alias("payload"), conflict.alias("conflict"))


def ingest(markers: Column, reasons: Column, payload: Column, conflict: Column, page_no: Column) -> Column:
    """(outcome, why, next_state, redacted) of a page; reasons come from the gate."""
    why = F.when(markers < MARKERS, F.array(F.lit("R_MARKERS"))).when(conflict, F.concat(F.array(F.lit("R_CONFLICT")), reasons)).when(payload.isNull(), F.concat(F.array(F.lit("R_UNIDENTIFIED")), reasons)).when(gate_verdict(reasons) == "REJECT", reasons)
    rejected = why.isNotNull()
    return F.struct(
        F.when(rejected, "REJECTED").otherwise("INGESTED").alias("outcome"),
        F.coalesce(why, F.array().cast("array<string>")).alias("why"),
        F.when(rejected, "QUALITY_REJECTED").otherwise("OCR_RUNNING").alias("next_state"),
        (~rejected & (page_no == 1)).alias("redacted"),
    )


#: What the pixel gate rejects and warns of.
PIXEL_GATE = {"sharpness": (0.35, 0.55), "exposure": (0.60, 0.80), "contrast": (0.25, 0.40), "dpi": (150.0, 200.0)}
PIXEL_GLARE, PIXEL_SKEW, BLANK, PROCEED, DEGRADED = (0.06, 0.02), (5.0, 2.0), 0.005, 0.70, 0.50


#: Fixed value: a frame longer than this for its width holds two pages.
TWO_PAGES = 1.6


def upload_flags(uploads: DataFrame) -> DataFrame:
    """``flags`` and ``first`` for uploads (upload, exam, content, height, width, marker_sets, screen).

    MULTIPLE_PAGES_IN_FRAME: two sets of markers, or a frame too long for one page; it is rejected, as is DUPLICATE_UPLOAD: bytes that the exam already has,
    ``first`` being the upload that brought them (null without bytes). SUSPECTED_SCREEN_CAPTURE is a warning. Copies meet by digest, summed before they are joined back.
    """
    digest = uploads.withColumn("digest", F.sha2("content", 256))
    firsts = digest.groupBy("exam", "digest").agg(F.min("upload").alias("first"))
    long, short = F.greatest("height", "width"), F.least("height", "width")
    flags = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("marker_sets") > 1, F.lit(False)) | (long > short * TWO_PAGES), "MULTIPLE_PAGES_IN_FRAME"),
            F.when(F.col("first") < F.col("upload"), "DUPLICATE_UPLOAD"),
            F.when(F.col("screen"), "SUSPECTED_SCREEN_CAPTURE"),
        )
    )
    return digest.join(firsts, ["exam", "digest"], "left").withColumn("flags", flags)


def pixel_reasons(m: Column) -> Column:
    """Codes of what the measures (sharpness, exposure, contrast, glare, dpi, skew, ink) show; null measures reject."""
    below = [F.when(F.coalesce(m[n] < reject, F.lit(True)), f"R_{n.upper()}").when(m[n] < warn, f"W_{n.upper()}") for n, (reject, warn) in PIXEL_GATE.items()]
    above = [F.when(F.coalesce(v > reject, F.lit(True)), f"R_{n}").when(v > warn, f"W_{n}") for n, v, (reject, warn) in (("GLARE", m["glare"], PIXEL_GLARE), ("SKEW", F.abs(m["skew"]), PIXEL_SKEW))]
    return F.array_compact(F.array(*below, *above, F.when(m["ink"] < BLANK, "W_BLANK_PAGE")))


def pixel_gate(m: Column) -> Column:
    """(overall, reasons, band): PROCEED, IMAGE_DEGRADED (which holds later routing at a review) or REJECT."""
    overall = composite(m["sharpness"], m["contrast"], m["exposure"], m["glare"])
    reasons = pixel_reasons(m)
    band = F.when(F.exists(reasons, lambda r: r.startswith("R_")) | F.coalesce(overall < DEGRADED, F.lit(True)), "REJECT").when(overall < PROCEED, "IMAGE_DEGRADED").otherwise("PROCEED")
    return F.struct(overall.alias("overall"), reasons.alias("reasons"), band.alias("band"))
