"""Image kernels pixel by pixel, and planted angles, blobs, gratings and strikes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from assayer import catalog
from assayer.functions import images
from assayer.functions.pixels import homography
from assayer.operators import capture, reconcile


def page(rng, h=220, w=180, lines=9, slope=0.0):
    """White paper with lines of short dark strokes, leaning by ``slope`` degrees."""
    a = np.full((h, w), 235, np.uint8)
    for k in range(lines):
        for x in 10 + rng.integers(4, 13, w).cumsum():
            if x < w - 16:
                y = 20 + k * 20 + math.tan(math.radians(slope)) * (x - w / 2)
                top = int(round(y + rng.integers(0, 3)))
                a[max(0, top) : top + 7, x : x + 2] = 40
                a[max(0, top) : top + 2, x : x + 6] = 40
    return a


def cubic(t):
    t, a = abs(t), -0.75
    return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


def plain_warp(image, matrix, h, w, border):
    back, out = np.linalg.inv(matrix), np.zeros((h, w), np.uint8)
    for v in range(h):
        for u in range(w):
            x, y, z = back @ (u, v, 1.0)
            x, y = x / z, y / z
            total = 0.0
            for j in range(math.floor(y) - 1, math.floor(y) + 3):
                for i in range(math.floor(x) - 1, math.floor(x) + 3):
                    inside = 0 <= j < image.shape[0] and 0 <= i < image.shape[1]
                    value = float(image[j, i]) if inside else border if border is not None else float(image[min(max(j, 0), image.shape[0] - 1), min(max(i, 0), image.shape[1] - 1)])
                    total += cubic(x - i) * cubic(y - j) * value
            out[v, u] = min(255, max(0, round(total)))
    return out


def close(a, b):
    """Equal but for sums that lie on a half."""
    return np.abs(a.astype(int) - b.astype(int)).max() <= 1 and (a != b).mean() < 0.01


def test_rectified_pages(spark):
    """The query's pages, pixel by pixel, and an error where a corner is missing."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = catalog.QUERIES["rectified_pages"](spark, SMALL).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i in sorted(texts)[:40]:
        if i % 7 == 0:
            assert pd.isna(got.digest[i]) and got.error[i] == "corners missing: 3"
            continue
        h, k = max(1, -(-len(texts[i]) // 64)), i % 5
        image = np.frombuffer(texts[i].ljust(h * 64, b"\xff"), np.uint8).reshape(h, 64)
        source = np.array([(2 + k, 1 + k / 2), (60 - k, 0.5 + k), (62 - k / 2, h - 1 - k), (1 + k / 4, h - 2.0)], float)
        if got.error[i]:
            continue
        matrix = homography(source, np.array([(2, 2), (37, 2), (37, 45), (2, 45)], float))
        own = images.warped(image, matrix, 48, 40)
        assert hashlib.md5(own.tobytes()).hexdigest() == got.digest[i] and got["size"][i] == 48 * 40
        if i < 8:
            assert close(own, plain_warp(image, matrix, 48, 40, 255))


def test_pages_come_in_small_batches(spark):
    """40 pages of 1 MB in one task: a worker holds a few at a time, not 64 MB of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        catalog.QUERIES["rectified_pages"](spark, SMALL)
        many = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
        pages = spark.range(0, 40, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1 << 20), "utf-8").alias("image"))
        assert max(r.n for r in pages.select(many("image").alias("n")).collect()) <= 8
    finally:
        spark.conf.unset(key)


def test_a_page_comes_back_from_its_photograph():
    flat = page(np.random.default_rng(0))
    corners, seen = np.array([(0, 0), (179, 0), (179, 219), (0, 219)], float), np.array([(20, 12), (190, 25), (200, 240), (8, 228)], float)
    photo = images.warped(flat, homography(corners, seen), 260, 215)
    back = images.warped(photo, homography(seen, corners), 220, 180)
    assert np.abs(back[8:-8, 8:-8].astype(int) - flat[8:-8, 8:-8]).mean() < 6


def flooded(mask):
    """Blob sizes by flood filling, corners included."""
    seen, sizes = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        seen[y, x], todo, n = True, [(y, x)], 0
        while todo:
            a, b = todo.pop()
            n += 1
            for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        todo.append((i, j))
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.45, 0.6, 1.0])
def test_blobs_by_flood_filling(share):
    rng = np.random.default_rng(int(share * 100))
    mask = rng.random((40, 37)) < share
    row, start, end = images.runs(mask)
    assert sorted(np.bincount(images.joined(row, start, end, 37), weights=end - start)[np.unique(images.joined(row, start, end, 37))].astype(int)) == flooded(mask)


def test_gate_measures_by_pixels(spark):
    rng = np.random.default_rng(3)
    shots = [page(rng), np.full((50, 40), 128, np.uint8), rng.integers(0, 256, (60, 50)).astype(np.uint8), np.where(np.arange(100)[:, None] < 30, 255, page(rng, 100, 90, 4)).astype(np.uint8), np.array([[7]], np.uint8)]
    df = spark.createDataFrame([(i, bytearray(a.tobytes()), *a.shape) for i, a in enumerate(shots)] + [(9, None, 4, 4), (10, bytearray(b"abc"), 2, 2)], "i int, image binary, h int, w int")
    m = images.gate_measures(F.col("image"), F.col("h"), F.col("w"))
    got = {r.i: r for r in df.select("i", m.alias("m"), capture.pixel_gate(m).alias("g")).collect()}
    assert got[9].m.ink is None and got[10].m.glare is None and got[9].g.band == got[10].g.band == "REJECT"
    for i, a in enumerate(shots):
        flat = sorted(a.ravel().tolist())
        n, r = len(flat), got[i].m
        quarter = lambda q: flat[max(0, math.ceil(q * n) - 1)]
        splits = {t: (sum(v <= t for v in flat), sum(v for v in flat if v <= t)) for t in set(flat)}
        spread = {t: (s / c - (sum(flat) - s) / (n - c)) ** 2 * c * (n - c) if c < n else 0.0 for t, (c, s) in splits.items()}
        best = max(spread.values())
        dark = min(t for t, v in spread.items() if v >= best * (1 - 1e-12)) if best > 0 else -1
        big = sum(s for s in flooded(a > 250) if s > 0.005 * n)
        assert r.exposure == pytest.approx(1 - sum(v <= 4 or v >= 251 for v in flat) / n) and r.contrast == pytest.approx((quarter(0.75) - quarter(0.25)) / 255)
        assert r.glare == pytest.approx(big / n) and r.ink == pytest.approx(sum(v <= dark for v in flat) / n) and r.dpi == pytest.approx(a.shape[0] / 11.69)
    assert got[3].m.glare > 0.25 and "R_GLARE" in got[3].g.reasons and got[1].m.ink == 0 and "W_BLANK_PAGE" in got[1].g.reasons


def plain_skew(image):
    """Angle by angle."""
    y, x = np.nonzero(images.ink(image))
    y, x = y - (image.shape[0] - 1) / 2, x - (image.shape[1] - 1) / 2
    reach, best, angle = 4 * (int(np.hypot(*image.shape) / 2) + 3), -1.0, 0.0
    for tenth in sorted(range(-40, 41), key=lambda t: (abs(t), t)) if len(y) else ():
        turn = np.deg2rad(tenth / 10)
        total = np.r_[0, np.bincount(np.floor(4 * (y * np.cos(turn) - x * np.sin(turn))).astype(int) + reach, minlength=2 * reach + 1).cumsum()]
        spread = float((total[8:] - total[:-8]).var())
        if spread > best * (1 + 1e-12):
            best, angle = spread, tenth / 10
    return angle


def counted(monkeypatch, calls):
    inner = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or inner(*a, **k))


def test_skew_tries_many_angles_at_once(monkeypatch):
    rng = np.random.default_rng(11)
    shots = [rng.integers(0, 256, s).astype(np.uint8) for s in ((1, 1), (1, 64), (3, 64), (40, 64), (64, 3))] + [page(rng, slope=a) for a in (-3.3, 0.0, 1.7)] + [np.full((9, 9), 7, np.uint8)]
    assert [images.skew_of(a) for a in shots] == [plain_skew(a) for a in shots]
    monkeypatch.setattr(images, "ANGLE_PIXELS", 1000)
    assert images.skew_of(shots[6]) == plain_skew(shots[6])
    monkeypatch.undo()
    calls = []
    counted(monkeypatch, calls)
    images.measures(shots[3])
    assert len(calls) <= 10  # 84 when each angle had its own


def plain_maps(image, rows, columns, clip=2.0):
    """Tile by tile: the level that each level is taken to."""
    out = np.empty((len(rows) - 1, len(columns) - 1, 256))
    for i, j in np.ndindex(out.shape[:2]):
        counts = np.bincount(image[rows[i] : rows[i + 1], columns[j] : columns[j + 1]].ravel(), minlength=256).astype(float)
        most = max(clip * counts.sum() / 256, 1.0)
        out[i, j] = (np.minimum(counts, most) + np.maximum(counts - most, 0).sum() / 256).cumsum() * (255 / counts.sum())
    return out


@pytest.mark.parametrize("shape", [(70, 64), (600, 33), (5, 64), (1, 1)])
def test_tiles_are_counted_together(monkeypatch, shape):
    image = np.random.default_rng(4).integers(0, 256, shape).astype(np.uint8)
    rows, columns = (np.linspace(0, n, min(8, n) + 1).astype(int) for n in shape)
    maps, want = plain_maps(image, rows, columns), np.empty(shape)
    for y, x in np.ndindex(shape):
        p, q = (np.interp(v, (b[1:] + b[:-1] - 1) / 2, np.arange(len(b) - 1)) for v, b in ((y, rows), (x, columns)))
        i, j = int(p), int(q)
        i2, j2 = min(i + 1, len(rows) - 2), min(j + 1, len(columns) - 2)
        v = image[y, x]
        want[y, x] = (maps[i, j, v] * (1 - q + j) + maps[i, j2, v] * (q - j)) * (1 - p + i) + (maps[i2, j, v] * (1 - q + j) + maps[i2, j2, v] * (q - j)) * (p - i)
    calls = []
    counted(monkeypatch, calls)
    assert close(images.equalised(image), np.clip(np.rint(want), 0, 255).astype(np.uint8))
    assert len(calls) <= -(-shape[0] // images.STRIP)  # one a strip; 64 when each tile had its own


def test_levels_need_a_histogram_only(spark, monkeypatch):
    """The same as the gate's, without a search for angles or blobs."""
    rng = np.random.default_rng(6)
    shots = [page(rng), rng.integers(0, 256, (60, 50)).astype(np.uint8), np.array([[7]], np.uint8), np.full((5, 4), 255, np.uint8)]
    df = spark.createDataFrame([(i, bytearray(a.tobytes()), *a.shape) for i, a in enumerate(shots)] + [(9, None, 4, 4), (10, bytearray(b"abc"), 2, 2)], "i int, image binary, h int, w int")
    at, names = (F.col("image"), F.col("h"), F.col("w")), ("exposure", "contrast", "dpi", "ink")
    for r in df.select("i", images.level_measures(*at).alias("m"), images.gate_measures(*at).alias("g")).collect():
        assert (r.m is None or r.m.ink is None) == (r.i > 8)
        assert r.i > 8 or [r.m[n] for n in names] == [r.g[n] for n in names]
    plan = catalog.QUERIES["page_levels"](spark, SMALL)._jdf.queryExecution().toString()
    assert "skew" not in plan and "glare" not in plan
    for name in ("skew_of", "glare", "laplacian_variance"):
        monkeypatch.delattr(images, name)
    assert len(images.levels(shots[0])) == 4


def test_bands_of_the_pixel_gate(spark):
    good = dict(sharpness=0.9, exposure=0.95, contrast=0.6, glare=0.0, dpi=210.0, skew=0.0, ink=0.05)
    cases = [({}, "PROCEED", []), ({"contrast": 0.3, "sharpness": 0.5}, "IMAGE_DEGRADED", ["W_SHARPNESS", "W_CONTRAST"]), ({"skew": -5.1}, "REJECT", ["R_SKEW"]), ({"skew": 2.1}, "PROCEED", ["W_SKEW"]), ({"glare": 0.061}, "REJECT", ["R_GLARE"]), ({"dpi": 149.0}, "REJECT", ["R_DPI"]), ({"ink": 0.004}, "PROCEED", ["W_BLANK_PAGE"]), ({"sharpness": None}, "REJECT", ["R_SHARPNESS"])]
    names = list(good)
    df = spark.createDataFrame([(i, *((good | change)[n] for n in names)) for i, (change, _, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r.g for r in df.select("i", capture.pixel_gate(F.struct(*names)).alias("g")).collect()}
    assert [(got[i].band, got[i].reasons) for i in range(len(cases))] == [(band, why) for _, band, why in cases]


@pytest.mark.parametrize("degrees", [-3.7, -1.2, 0.0, 0.4, 2.5, 4.0])
def test_planted_angles(degrees):
    leaning = page(np.random.default_rng(5), 300, 260, 12, slope=degrees)
    assert abs(images.skew_of(leaning) - degrees) <= 0.1 + 1e-9
    assert abs(images.skew_of(images.turned(leaning, images.skew_of(leaning)))) <= 0.2


def test_turning_by_pixels():
    small = np.random.default_rng(2).integers(0, 256, (11, 9)).astype(np.uint8)
    c, s, (cx, cy) = math.cos(math.radians(3)), math.sin(math.radians(3)), (4, 5)
    there = np.array([[1, 0, cx], [0, 1, cy], [0, 0, 1]]) @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) @ np.array([[1, 0, -cx], [0, 1, -cy], [0, 0, 1]])
    assert close(images.turned(small, 3.0), plain_warp(small, there, 11, 9, None))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 40])
def test_sliding_extremes(size):
    a = np.random.default_rng(size).integers(0, 256, (23, 17)).astype(np.uint8)
    before = (size - 1) // 2
    for pick, name in ((np.maximum, "max"), (np.minimum, "min")):
        for axis in (0, 1):
            n = a.shape[axis]
            want = np.stack([getattr(a.take(np.clip(np.arange(i - before, i - before + size), 0, n - 1), axis), name)(axis) for i in range(n)], axis)
            assert (images.sliding(a, size, pick, axis) == want).all()


def test_even_light():
    rng = np.random.default_rng(8)
    flat = page(rng, 250, 200, 10)
    shade = np.linspace(0.45, 1.0, 200)[None, :]
    shaded = np.rint(flat * shade).astype(np.uint8)
    paper = flat > 200
    background = images.closed(shaded, 10)
    assert background[paper].astype(float).std() > 20 and np.abs(background[:, 60:140].astype(float) / (235 * shade[:, 60:140]) - 1).max() < 0.1
    assert images.lit(shaded)[paper].astype(float).std() < shaded[paper].astype(float).std() / 2
    a = rng.integers(90, 120, (16, 16)).astype(np.uint8)
    one = images.equalised(a, clip=1e9, tiles=1)
    counts = np.bincount(a.ravel(), minlength=256).cumsum()
    assert (one == np.rint(counts[a] * 255 / 256)).all()


def test_screens_and_clean_pages(spark):
    rng = np.random.default_rng(4)
    clean = [page(rng, 200, 160, 8), page(rng, 240, 200, 10, slope=1.5), np.full((64, 64), 200, np.uint8), rng.integers(0, 256, (128, 128)).astype(np.uint8)]
    y, x = np.mgrid[0:200, 0:160]
    screens = [np.clip(clean[0] + 22 * np.sin(2 * np.pi * (fx * x + fy * y)), 0, 255).astype(np.uint8) for fx, fy in ((0.31, 0.0), (0.2, 0.27), (0.0, 0.45), (-0.15, 0.1))]
    df = spark.createDataFrame([(i, bytearray(a.tobytes()), *a.shape) for i, a in enumerate(clean + screens)], "i int, image binary, h int, w int")
    got = {r.i: r.s for r in df.select("i", images.suspected_screen(F.col("image"), F.col("h"), F.col("w")).alias("s")).collect()}
    assert [got[i] for i in range(8)] == [False] * 4 + [True] * 4


def test_strikes_from_pixels(spark):
    rng = np.random.default_rng(6)
    plain = page(rng, 60, 200, 1)
    shots = {"plain": plain.copy(), "struck": plain.copy(), "slanting": plain.copy(), "short": plain.copy(), "low": plain.copy(), "thick": plain.copy()}
    shots["struck"][27:30, 15:180] = 30
    for x in range(15, 180):
        top = 26 + (x - 15) // 40
        shots["slanting"][top : top + 2, x] = 30
    shots["short"][27:30, 15:100] = 30
    shots["low"][40:42, 15:180] = 30
    shots["thick"][24:33, 15:180] = 30
    line = F.struct(F.lit(10).alias("x"), F.lit(14).alias("y"), F.lit(180).alias("w"), F.lit(28).alias("h"))
    df = spark.createDataFrame([(k, bytearray(a.tobytes()), *a.shape) for k, a in shots.items()], "k string, image binary, h int, w int").withColumn("line", line)
    found = df.select("k", "line", images.strike_runs(F.col("image"), F.col("h"), F.col("w"), F.col("line")).alias("runs"))
    got = {r.k: r.s for r in found.select("k", F.exists("runs", lambda r: reconcile.struck_through(r["x"], r["y"], r["width"], r["thickness"], F.col("line"))).alias("s")).collect()}
    assert got == {"plain": False, "struck": True, "slanting": True, "short": False, "low": False, "thick": False}
