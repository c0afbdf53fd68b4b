"""SimHash near-duplicates: fingerprints of word shingles, and links by multi-index hashing.

A fingerprint has 64 bits; bit i is 1 if more than half of a text's shingle hashes (XXH64, seed 42; repeats
count) have it. Fingerprints link at ``DISTANCE`` = 2 or fewer differing bits.

A fingerprint is two segments of 32 bits, one table each. It enumerates the ball of radius 1 in each segment,
the other segment as it is, and stands in the table at every entry of its balls: 65 entries with itself. Of two
fingerprints at a distance of 2, each is one step from an entry between them, whether the two bits lie in one segment or in
both (then it is an entry of one's first table and the other's second; entries are whole fingerprints, so the tables
share one key), so they meet there, and what meets is verified at its complete distance. Both sides probe, where a common table
would hold fingerprints as they are and have only one side enumerate: so an entry is a whole
fingerprint and has at most 65 holders, however many fingerprints share a segment, and a group of near copies
never becomes its pairs. Holders of an entry link to its least holder, two steps away at most.
Equal fingerprints are one node before anything is enumerated.

Texts that are null, empty or without words have fingerprint zero and link like any other. A text with fewer words
than a shingle is one shingle. A null id takes no part: its component is null. Rows of one id are one document,
linked by it whatever their texts. Other columns are ignored. Texts count as whole, however long: words are read
in pieces of 1 MB that carry on the last words of the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.batches import bounded
from assayer.llm.components import components
from assayer.llm.places import kept

WIDTH = 3
SEED = 42
DISTANCE = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Parts of at least ``size`` bytes that end at a blank."""
    at = 0
    while at < len(text):
        end = BLANK.search(text, at + size)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED, size: int = PIECE) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, piece by piece."""
    from xxhash import xxh64_intdigest

    carried: list[bytes] = []
    found = False
    for piece in pieces((text or "").encode().translate(LOWER), size):
        words = carried + piece.split()
        if len(words) >= width:
            found = True
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            yield np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - width + 1)
        carried = words[len(words) - width + 1 :] if len(words) >= width else words
    if carried and not found:
        yield np.array([xxh64_intdigest(b" ".join(carried), seed)], np.uint64)


def fingerprints(texts: list[str | None], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text; bits are counted over the hashes of many texts at once."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    waiting, owners, held = [], [], 0

    def count() -> None:
        nonlocal held
        if waiting:
            bits = np.unpackbits(np.concatenate(waiting).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sizes = np.array([len(x) for x in waiting])
            np.add.at(counts, owners, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            np.add.at(totals, owners, sizes)
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width, seed):
            waiting.append(hashes)
            owners.append(i)
            held += len(hashes)
            if held >= 1 << 16:
                count()
    count()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def prints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, print long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            own = fingerprints(b.column(text).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(own.view(np.int64))], ["doc_id", "print"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "doc_id long, print long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links enough to connect all nodes (node, print) whose fingerprints differ in ``DISTANCE`` bits or fewer.

    Prints are distinct. Each holder of an entry is linked to its least holder, once the two are verified.
    """
    entries = nodes.select("node", "print", F.expr("explode(concat(array(print), transform(sequence(0, 63), b -> print ^ shiftleft(1L, b))))").alias("entry"))
    holders = W.partitionBy("entry").orderBy("node")
    met = entries.select(F.first("node").over(holders).alias("a"), F.first("print").over(holders).alias("print_a"), F.col("node").alias("b"), "print")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("print_a"))) <= DISTANCE
    return met.filter((F.col("a") < F.col("b")) & near).select("a", "b")


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    seen = kept(prints(df, key, text, width), "prints")
    named = seen.filter("doc_id is not null")
    nodes = kept(named.groupBy("print").agg(F.min("doc_id").alias("node")), "nodes")
    # One id with several fingerprints is one document. Few, if ids are keys at all.
    split = named.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo <> hi").select("doc_id")
    same = named.join(split, "doc_id", "left_semi").distinct().join(nodes, "print").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    found = components(links(nodes).union(same))
    classes = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    whole = seen.join(classes, "print", "left")
    text_of = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return whole.select("doc_id", text_of.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return linked(docs)
