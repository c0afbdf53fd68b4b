"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword of +1 and -1. For each bit a binary classifier weighs n-grams by the log
odds between the languages on its two sides, learned from n-gram counts over all training documents. A
text's bit margins are compared with all codewords under an exponential loss, each bit weighted by how far
apart its two sides are; the nearest codeword wins, and a close second flags the row as ambiguous.

The counts (languages x bins integers, whatever the input's size) are all that reaches the driver: ``lang``
is taken to be a label column, and more than ``LANGUAGES`` values fail the fit. Of codewords at equal loss the one of the smaller name wins.
Texts count as whole, however long: a worker holds a batch of 1 MB or one longer text, at some 30 bytes a byte. A null text, or one without a letter, is ``und`` with score 0; with no
labelled row every text is. Repeated rows each count and are each judged; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.batches import bounded, text_bytes

BINS = 8192
LANGUAGES = 1000
SMOOTHING = 0.5
SHARPNESS = 12.0
AMBIGUOUS = 0.6
REJECT = 0.34
LETTER = re.compile(r"[^\W\d_]")
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32


def grams(body: np.ndarray) -> np.ndarray:
    """Bins of the 2- and 3-grams that start at each byte, as two rows; the last places are filler."""
    b = np.r_[FOLD[body], np.zeros(2, np.uint32)]
    two = b[:-2] | b[1:-1] << 8
    three = two | b[2:] << 16
    shift = np.uint32(32 - BINS.bit_length() + 1)
    return np.stack([(two * np.uint32(2654435761) >> shift), (three * np.uint32(2246822519) >> shift)])


def document_counts(bins: np.ndarray, start: int, stop: int) -> np.ndarray:
    return np.bincount(bins[0, start : max(start, stop - 1)], minlength=BINS) + np.bincount(bins[1, start : max(start, stop - 2)], minlength=BINS)


def counted(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bin, n): n-gram counts over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in bounded(batches, text):
            body, at = text_bytes(b.column(text))
            bins = grams(body)
            for i, name in enumerate(b.column(lang).to_pylist()):
                total.setdefault(name, np.zeros(BINS, np.int64))
                total[name] += document_counts(bins, int(at[i]), int(at[i + 1]))
        for name, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen])], ["lang", "bin", "n"])

    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string").alias(lang))
    return rows.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of k classes: all splits for up to 7, else the best of some drawn codes."""
    if k <= 7:
        rows = np.array([(1, *x) for x in product((1, -1), repeat=max(0, k - 1))]).T.reshape(max(k, 1), -1)
        keep = (rows == -1).any(axis=0)
        return rows[:, keep] if keep.any() else rows
    length, best, distance = int(np.ceil(10 * np.log2(k))), None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice((1, -1), (k, length))
        mixed = (np.abs(code.sum(axis=0)) < k).all()
        apart = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(k - 1))
        if mixed and apart > distance:
            best, distance = code, apart
    return best


class Model:
    """Learned languages, their codewords, the weights of each bit's classifier and of each bit."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.code = codewords(len(names))
        share = counts + SMOOTHING
        share = share / share.sum(axis=1, keepdims=True)
        self.weights, apart = np.zeros((BINS, self.code.shape[1])), np.ones(self.code.shape[1])
        for b in range(self.code.shape[1]):
            yes, no = self.code[:, b] > 0, self.code[:, b] < 0
            if yes.any() and no.any():
                p, q = share[yes].mean(axis=0), share[no].mean(axis=0)
                self.weights[:, b] = np.log(p / q)
                apart[b] = -np.log(np.sqrt(p * q).sum()) + 1e-9
        self.bit_weight = apart / apart.sum()

    def predict(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the second is close."""
        loss = np.exp(-self.code * np.clip(margins, -3, 3)) @ self.bit_weight
        z = np.exp(-SHARPNESS * (loss - loss.min()))
        k = int(np.argmin(loss))
        return self.names[k], float(1 / z.sum()), bool(len(loss) > 1 and 1 / z.sum() < AMBIGUOUS)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    rows = counted(df, text, lang).limit(LANGUAGES * BINS + 1).collect()
    if len(rows) > LANGUAGES * BINS:
        raise ValueError(f"{lang} has more than {LANGUAGES} values: it is no label")
    names = sorted({r.lang for r in rows})
    index, counts = {n: i for i, n in enumerate(names)}, np.zeros((len(names), BINS), np.int64)
    for r in rows:
        counts[index[r.lang], r.bin] = r.n
    return Model(names, counts)


def classify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x bins numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in bounded(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(key), *judged(b.column(text), m)], [key, "lang_pred", "score", "ambiguous"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def has_letter(text: str) -> bool:
    """Fractions and numerals that are word characters, such as ½ or Ⅷ, are no letters."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def judged(column: pa.Array, m: Model) -> list[pa.Array]:
    body, at = text_bytes(column)
    bins = grams(body)
    out = []
    for i, t in enumerate(column.to_pylist()):
        if not t or not m.names or not has_letter(t):
            out.append(("und", 0.0, True))
            continue
        counts = document_counts(bins, int(at[i]), int(at[i + 1]))
        margins = counts @ m.weights / max(1, counts.sum())
        out.append(m.predict(margins * 2))
    names, scores, close = zip(*out)
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())]


def identified(df: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``df`` whose language is told, with ``lang`` as predicted; und and hopelessly split rows go."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {'string' if f.name == lang else f.dataType.simpleString()}" for f in df.schema.fields)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            told, scores, _ = judged(b.column(text), shared.value)
            keep = pa.array([n != "und" and s >= REJECT for n, s in zip(told.to_pylist(), scores.to_pylist())])
            yield pa.RecordBatch.from_arrays([told if n == lang else b.column(n) for n in names], names).filter(keep)

    return df.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
