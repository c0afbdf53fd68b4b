"""Text normalisation, edit distances and error rates as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Unicode white space and the four separators that Java leaves out.
WHITE = r"(?U)[\s\x1c-\x1f]+"
HELD_BITS = 1 << 29


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(text: Column, lower: bool = True, strip_punctuation: bool = False, collapse: bool = True, unicode: bool = True) -> Column:
    """NFKC, lower case, no punctuation, single blanks, trimmed; ``unicode=False`` for text known to be ASCII."""
    out = _nfkc(text) if unicode else text
    if lower:
        out = F.lower(out)
    if strip_punctuation:
        out = F.regexp_replace(out, r"\p{P}", "")
    if collapse:
        out = F.regexp_replace(out, WHITE, " ")
    return F.regexp_replace(out, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def describe(lower: bool = True, strip_punctuation: bool = False) -> str:
    return f"{'lowercased' if lower else 'case kept'}, {'punctuation dropped' if strip_punctuation else 'punctuation kept'}"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda t: t != "")


def edits(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences: a bit for each item of the longer one, all of a column's steps at once in wide integers.

    Equal ends fall away first. Items' places are held up to HELD_BITS. Time is the product of the lengths over the width of a machine's operations on such integers.
    """
    if len(a) < len(b):
        a, b = b, a
    start, stop, gone = 0, len(b), len(a) - len(b)
    while start < stop and a[start] == b[start]:
        start += 1
    while stop > start and a[stop + gone - 1] == b[stop - 1]:
        stop -= 1
    a, b = a[start : stop + gone], b[start:stop]
    if not len(b):
        return len(a)
    places: dict = {}
    for i, item in enumerate(a):
        places.setdefault(item, []).append(i)
    at: dict = {}
    most = 1 + HELD_BITS // len(a)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)  # where the distance grows or falls by one from row to row
    for item in b:
        if item not in at:
            if len(at) >= most:
                at.clear()
            at[item] = sum(1 << i for i in places.get(item, ()))
        same = at[item] | down
        level = (((same & up) + up) ^ up) | same
        right, left = down | (full & ~(up | level)), up & level
        distance += 1 if right & last else -1 if left & last else 0
        right = (right << 1) | 1
        up, down = ((left << 1) | ~(right | level)) & full, right & level & full
    return distance


@F.pandas_udf(IntegerType())
def _text_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edits(a, b) for a, b in zip(reference, hypothesis)], dtype="Int32")


@F.arrow_udf(IntegerType())
def _word_edits(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Tokens stay in Arrow until their row's turn: as a batch of Python strings they would take some ten times the room."""
    return pa.array([edits(a.as_py(), b.as_py()) if a.is_valid and b.is_valid else None for a, b in zip(reference, hypothesis)], pa.int32())


def char_errors(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two texts, in Arrow batches."""
    return _text_edits(reference, hypothesis)


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two token arrays, however many different tokens there are."""
    return _word_edits(reference, hypothesis)


def rate(errors: Column, length: Column) -> Column:
    """Errors over length; with no reference, 0 without errors and 1 with any. May exceed 1."""
    return F.when(length == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / F.nullif(length, F.lit(0)))


def accuracy(of_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - of_rate)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


def folded(text: Column) -> Column:
    """Case, blanks, quotes and dashes made alike."""
    plain = F.translate(F.lower(text), "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(plain, WHITE, " "))
