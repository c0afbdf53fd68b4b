"""Page images (8-bit grey, bytes with height and width) in Arrow batches: rectifying, the pixel gate, skew, light, screens, strikes.

A row whose bytes are null or don't fit its size has a null result. Batches are as large as Spark makes them (``session.small_batches`` asks for 4 MB), and an
image is worked on in strips or by whole-array operations: some 10 bytes a pixel for most, some 60 for spectra.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.pixels import homography, laplacian_variance

STRIP = 256
#: Places of pixels that a search for the skew holds at once.
ANGLE_PIXELS = 1 << 15
#: The bicubic kernel's parameter, the angles of the search in tenths of a degree, and the gate's constants.
CUBIC, SKEW_TENTHS, GLARE_LEVEL, GLARE_AREA, SHARP_FULL, PAGE_INCHES = -0.75, 40, 250, 0.005, 900.0, 11.69
#: Screens: the least frequency that counts (cycles a pixel), and the share of what lies above it that one peak must hold. This library's choice.
SCREEN_FROM, SCREEN_SHARE = 0.1, 0.05


def grey(data: bytes | None, h, w) -> np.ndarray | None:
    if data is None or pd.isna(h) or pd.isna(w) or h * w != len(data) or not len(data):
        return None
    return np.frombuffer(data, np.uint8).reshape(int(h), int(w))


def sampled(padded: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bicubic samples of an image that has one more pixel on each side; beyond them it carries on."""

    def weights(t: np.ndarray) -> list[np.ndarray]:
        near = lambda d: ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
        far = lambda d: ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
        return [far(1 + t), near(t), near(1 - t), far(2 - t)]

    h, w = padded.shape[0] - 2, padded.shape[1] - 2
    x, y = np.clip(x, -4.0, w + 4.0), np.clip(y, -4.0, h + 4.0)
    left, top = np.floor(x), np.floor(y)
    across, down = weights(x - left), weights(y - top)
    columns = [np.clip(left.astype(np.intp) + i, 0, w + 1) for i in range(4)]
    total, flat = np.zeros(x.shape), padded.ravel()
    for j in range(4):
        row = np.clip(top.astype(np.intp) + j, 0, h + 1) * (w + 2)
        for i in range(4):
            weight = across[i] * down[j]
            weight *= flat.take(row + columns[i])
            total += weight
    return np.clip(np.rint(total), 0, 255).astype(np.uint8)


def warped(image: np.ndarray, matrix: np.ndarray, height: int, width: int, border: int | None = 255) -> np.ndarray:
    """The image under a homography of its coordinates, by the inverse map, in strips of rows; outside it lies ``border``, or the nearest pixel if it is None."""
    back, out = np.linalg.inv(matrix), np.empty((height, width), np.uint8)
    padded = np.pad(image, 1, mode="edge") if border is None else np.pad(image, 1, constant_values=border)
    for top in range(0, height, STRIP):
        v, u = np.arange(top, min(height, top + STRIP), dtype=float)[:, None], np.arange(width, dtype=float)[None, :]
        x, y, z = (back[k, 0] * u + back[k, 1] * v + back[k, 2] for k in range(3))
        z = np.where(z == 0, np.finfo(float).tiny, z)
        out[top : top + STRIP] = sampled(padded, x / z, y / z)
    return out


RECTIFIED = T.StructType([T.StructField("image", T.BinaryType()), T.StructField("error", T.StringType())])


def rectify(image: Column, h: Column, w: Column, corners: Column, targets: list[tuple[float, float]], height: int, width: int) -> Column:
    """(image, error): a page flattened onto ``height`` by ``width`` pixels, white outside the photograph.

    ``corners`` is an array of four structs (x, y), the markers' centres in the order of ``targets``. Three points have no perspective: a
    missing corner, or four that no perspective takes to the targets, is an error, and there is no image.
    """

    @F.pandas_udf(RECTIFIED)
    def run(image: pd.Series, h: pd.Series, w: pd.Series, corners: pd.Series) -> pd.DataFrame:
        rows = []
        for data, hh, ww, found in zip(image, h, w, corners):
            points = [None if c is None or c["x"] is None or c["y"] is None else (c["x"], c["y"]) for c in (found if found is not None else [])]
            missing = [str(i) for i in range(4) if i >= len(points) or points[i] is None]
            page = grey(data, hh, ww)
            if missing or page is None:
                rows.append((None, f"corners missing: {', '.join(missing)}" if missing else "no image"))
                continue
            try:
                matrix = homography(np.array(points[:4], float), np.array(targets, float))
                rows.append((warped(page, matrix, height, width).tobytes(), None))
            except np.linalg.LinAlgError:
                rows.append((None, "corners on a line"))
        return pd.DataFrame(rows, columns=["image", "error"])

    return run(image, h, w, corners)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every horizontal run of true pixels, in order; ends are exclusive."""
    begins, ends = mask.copy(), mask.copy()
    begins[:, 1:] &= ~mask[:, :-1]
    ends[:, :-1] &= ~mask[:, 1:]
    row, start = np.divmod(np.flatnonzero(begins), mask.shape[1])
    return row, start, np.flatnonzero(ends) % mask.shape[1] + 1


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """A label for each run: runs of neighbouring rows that touch, corners included, are one blob. Union-find over runs."""
    n, span = len(row), width + 2
    begins, ends = row * span + start, row * span + end
    first, stop = np.searchsorted(ends, begins + span), np.searchsorted(begins, ends + span, side="right")
    count = np.maximum(stop - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while (after != after[after]).any():
            after = after[after]
        if (after == root).all():
            return root
        root = after


def glare(image: np.ndarray) -> float:
    """The share of pixels above GLARE_LEVEL in blobs of more than GLARE_AREA of the page."""
    bright = image > GLARE_LEVEL
    if np.count_nonzero(bright) <= GLARE_AREA * image.size:
        return 0.0
    row, start, end = runs(bright)
    area = np.bincount(joined(row, start, end, image.shape[1]), weights=end - start)
    return float(area[area > GLARE_AREA * image.size].sum() / image.size)


def otsu(counts: np.ndarray) -> int:
    """The level that parts a histogram with the greatest variance between both sides; up to it is dark. The least of equals."""
    n, level = counts.cumsum().astype(float), (counts * np.arange(256)).cumsum().astype(float)
    inside, outside = n, n[-1] - n
    between = np.where((inside > 0) & (outside > 0), (level[-1] * n - level * n[-1]) ** 2 / np.maximum(inside * outside, 1), 0)
    return int(between.argmax())


def quantile(counts: np.ndarray, share: float) -> int:
    """The least level up to which lies at least ``share`` of a histogram."""
    return int(np.searchsorted(counts.cumsum(), share * counts.sum()))


def darkest(counts: np.ndarray) -> int:
    """The level of a histogram up to which is ink; -1 on a page of one level."""
    return otsu(counts) if np.count_nonzero(counts) > 1 else -1


def ink(image: np.ndarray) -> np.ndarray:
    """Pixels up to Otsu's threshold; none on a page of one level."""
    return image <= darkest(np.bincount(image.ravel(), minlength=256))


def skew_of(image: np.ndarray) -> float:
    """Degrees, in tenths from -4 to 4, at which rows of ink, turned back by them, differ most; the smallest turn of equals.

    Rows are two pixels high and begin at every quarter of one, so that no angle gains by how its pixels fall into rows. Several
    angles are tried at once, as many as keep ANGLE_PIXELS places. The rows' mean is the same at every angle, so that sums of squares tell variances apart.
    """
    y, x = np.nonzero(ink(image))
    if not len(y):
        return 0.0
    h, w = image.shape
    tenths = sorted(range(-SKEW_TENTHS, SKEW_TENTHS + 1), key=lambda t: (abs(t), t))
    turns = np.deg2rad(np.array(tenths) / 10)[:, None]
    down, across = 4 * ((np.arange(h) - (h - 1) / 2) * np.cos(turns)), 4 * ((np.arange(w) - (w - 1) / 2) * np.sin(turns))
    reach = 4 * (int(np.hypot(h, w) / 2) + 3)
    span, step = 2 * reach + 1, max(1, ANGLE_PIXELS // len(y))
    squares: list[int] = []
    for at in range(0, len(tenths), step):
        place = down[at : at + step].take(y, axis=1)
        place -= across[at : at + step].take(x, axis=1)
        np.floor(place, out=place)
        n = len(place)
        place += np.arange(n)[:, None] * span + reach
        total = np.zeros((n, span + 1), np.int64)
        np.cumsum(np.bincount(place.astype(np.intp).ravel(), minlength=n * span).reshape(n, span), axis=1, out=total[:, 1:])
        rows = total[:, 8:] - total[:, :-8]
        squares += np.einsum("ij,ij->i", rows, rows).tolist()
    best, angle, count = -1.0, 0.0, span - 7
    for tenth, square in zip(tenths, squares):
        spread = count * square - (8 * len(y)) ** 2
        if spread > best * (1 + 1e-12):
            best, angle = spread, tenth / 10
    return angle


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned back by ``degrees`` about its middle, bicubic, its border carried on."""
    turn, (h, w) = np.deg2rad(degrees), image.shape
    cx, cy = (w - 1) / 2, (h - 1) / 2
    c, s = np.cos(turn), np.sin(turn)
    matrix = np.array([[c, s, cx - c * cx - s * cy], [-s, c, cy + s * cx - c * cy], [0, 0, 1]])
    return warped(image, matrix, h, w, None)


def sliding(image: np.ndarray, size: int, pick: np.ufunc, axis: int) -> np.ndarray:
    """The extreme of ``size`` neighbours along an axis by doubling: of 2, 4, 8 neighbours, then of two spans that overlap; borders carry on."""
    n, before = image.shape[axis], (size - 1) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (before, size - 1 - before)
    part = lambda a, start, stop: a[start:stop] if axis == 0 else a[:, start:stop]
    spans, span = np.pad(image, pad, mode="edge"), 1
    while 2 * span <= size:
        m = spans.shape[axis]
        spans, span = pick(part(spans, 0, m - span), part(spans, span, m)), 2 * span
    return pick(part(spans, 0, n), part(spans, size - span, size - span + n))


def closed(image: np.ndarray, size: int) -> np.ndarray:
    """Grey closing by a square: the lightest of neighbours, then the darkest of those."""
    for pick in (np.maximum, np.minimum):
        for axis in (0, 1):
            image = sliding(image, size, pick, axis)
    return image


def equalised(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles, counts clipped at ``clip`` times their mean, maps interpolated between tile middles."""
    h, w = image.shape
    rows, columns = (np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (h, w))
    wide = len(columns) - 1
    tile_row, tile_column = np.repeat(np.arange(len(rows) - 1) * wide, np.diff(rows))[:, None], np.repeat(np.arange(wide), np.diff(columns))
    counts = np.zeros((len(rows) - 1) * wide * 256, np.int64)
    for start in range(0, h, STRIP):
        own = (tile_row[start : start + STRIP] + tile_column) * 256 + image[start : start + STRIP]
        counts += np.bincount(own.ravel(), minlength=len(counts))
    counts = counts.reshape(-1, 256).astype(float)
    size = counts.sum(axis=1, keepdims=True)
    most = np.maximum(clip * size / 256, 1.0)
    excess = np.maximum(counts - most, 0).sum(axis=1, keepdims=True)
    maps = ((np.minimum(counts, most) + excess / 256).cumsum(axis=1) * (255 / size)).ravel()

    def between(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = (bounds[1:] + bounds[:-1] - 1) / 2
        place = np.interp(np.arange(n), middle, np.arange(len(middle)))
        low = np.floor(place).astype(int)
        return low, np.minimum(low + 1, len(middle) - 1), place - low

    out = np.empty(image.shape, np.uint8)
    across, (j, j2, q) = between(rows, h), (x[None, :] for x in between(columns, w))
    for start in range(0, h, STRIP):
        part = image[start : start + STRIP]
        i, i2, p = (x[start : start + STRIP, None] for x in across)
        at = lambda i, j: maps.take((i * wide + j) * 256 + part)  # noqa: B023, E731
        top, bottom = at(i, j) * (1 - q) + at(i, j2) * q, at(i2, j) * (1 - q) + at(i2, j2) * q
        out[start : start + STRIP] = np.clip(np.rint(top * (1 - p) + bottom * p), 0, 255)
    return out


def lit(image: np.ndarray) -> np.ndarray:
    """Even light: divided by its background (a closing of a 25th of the height), then equalised by tiles."""
    background = closed(image, max(3, image.shape[0] // 25)).astype(float)
    return equalised(np.clip(np.rint(image * 255.0 / np.maximum(background, 1)), 0, 255).astype(np.uint8))


def periodic(image: np.ndarray) -> float:
    """The greatest share of the energy at high frequencies that lies at one frequency and its neighbours."""
    h, w = image.shape
    if min(h, w) < 8:
        return 0.0
    taper = np.outer(np.hanning(h), np.hanning(w))
    power = np.abs(np.fft.fft2((image - image.mean()) * taper)) ** 2
    high = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :]) >= SCREEN_FROM
    power = np.where(high, power, 0)
    total = power.sum()
    if total <= 1e-9 * image.size:
        return 0.0
    around = sum(np.roll(power, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1))
    return float(2 * around.max() / total)  # a real image has each frequency twice


def strikes(image: np.ndarray, box: tuple[int, int, int, int]) -> list[dict]:
    """Long horizontal runs of ink in a line's box, joined over rows: (x, y, width, thickness), y the middle, thickness the mean.

    A run counts from an eighth of the box's width, as strokes of letters are shorter; a slanting stroke is several runs that touch.
    """
    x, y, w, h = box
    part = image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    if not part.size:
        return []
    row, start, end = runs(ink(image)[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)])
    long = (end - start) * 8 >= w
    row, start, end = row[long], start[long], end[long]
    label = joined(row, start, end, part.shape[1])
    out = []
    for k in np.unique(label).tolist():
        own = label == k
        length, left, right = (end - start)[own], start[own].min(), end[own].max()
        out.append({"x": float(max(0, x) + left), "y": float(max(0, y) + ((row[own] + 0.5) * length).sum() / length.sum()), "width": float(right - left), "thickness": float(np.rint(length.sum() / (right - left)))})
    return out


def levels(image: np.ndarray) -> tuple[float, ...]:
    """The measures that a histogram gives: exposure, contrast, dpi, ink."""
    counts = np.bincount(image.ravel(), minlength=256)
    return 1 - float(counts[:5].sum() + counts[251:].sum()) / image.size, (quantile(counts, 0.75) - quantile(counts, 0.25)) / 255, image.shape[0] / PAGE_INCHES, float(counts[: darkest(counts) + 1].sum() / image.size)


def measures(image: np.ndarray) -> tuple[float, ...]:
    exposure, contrast, dpi, inked = levels(image)
    return min(1.0, laplacian_variance(image) / SHARP_FULL), exposure, contrast, glare(image), dpi, skew_of(image), inked


def _per_image(kind: T.DataType, kernel: Callable) -> Callable:
    """A column function of (image, h, w, more...) that calls the kernel for each image that there is."""

    def each(columns: tuple[pd.Series, ...]) -> list:
        pages = (grey(*row[:3]) for row in zip(*columns[:3]))
        return [None if page is None else kernel(page, *more) for page, *more in zip(pages, *columns[3:])]

    if isinstance(kind, T.StructType):

        @F.pandas_udf(kind)
        def run(*columns: pd.Series) -> pd.DataFrame:
            names = kind.fieldNames()
            return pd.DataFrame([(None,) * len(names) if x is None else x for x in each(columns)], columns=names)

    else:

        @F.pandas_udf(kind)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(each(columns), dtype=object)

    return run


MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "exposure", "contrast", "glare", "dpi", "skew", "ink")])
STRIKES = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "thickness")]))
LEVELS = T.StructType([MEASURES[n] for n in ("exposure", "contrast", "dpi", "ink")])
_measures = _per_image(MEASURES, measures)
_levels = _per_image(LEVELS, levels)
_deskewed = _per_image(T.BinaryType(), lambda page: turned(page, skew_of(page)).tobytes())
_lit = _per_image(T.BinaryType(), lambda page: lit(page).tobytes())
_periodic = _per_image(T.DoubleType(), periodic)
_strikes = _per_image(STRIKES, lambda page, x, y, w, h: strikes(page, (int(x), int(y), int(w), int(h))))


def gate_measures(image: Column, h: Column, w: Column) -> Column:
    """The gate's seven measures from pixels."""
    return _measures(image, h, w)


def level_measures(image: Column, h: Column, w: Column) -> Column:
    """Those of the gate's measures that a histogram gives: exposure, contrast, dpi, ink."""
    return _levels(image, h, w)


def deskewed(image: Column, h: Column, w: Column) -> Column:
    return _deskewed(image, h, w)


def evenly_lit(image: Column, h: Column, w: Column) -> Column:
    return _lit(image, h, w)


def screen_share(image: Column, h: Column, w: Column) -> Column:
    return _periodic(image, h, w)


def suspected_screen(image: Column, h: Column, w: Column) -> Column:
    """Whether a page looks like a photograph of a screen."""
    return _periodic(image, h, w) > SCREEN_SHARE


def strike_runs(image: Column, h: Column, w: Column, line: Column) -> Column:
    """Runs that may strike a line out, for ``reconcile.struck_through``; ``line`` is its box (x, y, w, h)."""
    return _strikes(image, h, w, line["x"], line["y"], line["w"], line["h"])
