"""Pixel measures of 8-bit greyscale images (bytes with height and width), in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "brightness", "clipped_fraction")])


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian with mirrored borders."""
    p = np.pad(image.astype(np.int16), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.int16), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).astype(np.float64).var())


@F.pandas_udf(MEASURES)
def _measure(image: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    rows = []
    for data, h, w in zip(image, height, width):
        if data is None or not len(data) or h * w != len(data):
            rows.append((None, None, None))
            continue
        a = np.frombuffer(data, np.uint8).reshape(int(h), int(w))
        rows.append((laplacian_variance(a), float(a.mean()), float((a >= 255).mean())))
    return pd.DataFrame(rows, columns=["sharpness", "brightness", "clipped_fraction"])


def measure(image: Column, height: Column, width: Column) -> Column:
    """Sharpness, brightness and clipped share; nulls where the bytes don't fit the size."""
    return _measure(image, height, width)


def cropped(data: bytes, h: int, w: int, x: int, y: int, cw: int, ch: int) -> bytes | None:
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + cw), min(h, y + ch)
    return np.frombuffer(data, np.uint8).reshape(h, w)[y0:y1, x0:x1].tobytes() if x0 < x1 and y0 < y1 else None


@F.pandas_udf(T.BinaryType())
def crop(image: pd.Series, h: pd.Series, w: pd.Series, x: pd.Series, y: pd.Series, cw: pd.Series, ch: pd.Series) -> pd.Series:
    """The part of a rectangle that lies in the image; null where nothing does."""
    return pd.Series([None if a[0] is None else cropped(*a) for a in zip(image, h, w, x, y, cw, ch)], dtype=object)


@F.pandas_udf(T.BinaryType())
def redact(image: pd.Series, h: pd.Series, w: pd.Series, x: pd.Series, y: pd.Series, cw: pd.Series, ch: pd.Series) -> pd.Series:
    """The image with a rectangle painted white."""
    out = []
    for data, hh, ww, xx, yy, cc, rr in zip(image, h, w, x, y, cw, ch):
        if data is None:
            out.append(None)
            continue
        a = np.frombuffer(data, np.uint8).reshape(hh, ww).copy()
        a[max(0, yy) : max(0, yy + rr), max(0, xx) : max(0, xx + cc)] = 255
        out.append(a.tobytes())
    return pd.Series(out, dtype=object)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four source points to four target points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
