"""Vector code compression: codebooks for parts of vectors by dual-tree Lloyd rounds, in integers.

A vector's components become integers, floor(4096 x), cut into ``PARTS`` equal consecutive parts. Each part position has a
codebook of ``ENTRIES`` entries, at first that part of the vectors with the smallest ids. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry by floor(sum / count) of its parts.

Vectors are packed into blocks once, and a block keeps a tree over its parts for each position: halves
along the widest component, boxes of all nodes, and their sums. A round builds a tree over the entries of each
codebook, takes pairs of nodes of both trees down level by level, and drops a pair whose boxes are further apart than
some other pair of the same node is at most. A node left with one entry is assigned whole, by its cached sum; the points of leaves with
several are compared with those entries in integers. All bounds are integers too, so nothing is rounded. Tasks
return sums for each position and entry, and what reaches the driver is one codebook, whatever the input.

Rows without an id take no part, as do vectors that are null, empty, or hold a null or non-finite component. Vectors have the length of the first row in
the order of id and vector among those whose length ``PARTS`` divides; others cannot be coded and are left out. Rows of one id each count and are
each coded. Fewer rows than entries make a smaller codebook; an empty table gives no rows. A component beyond 2**26 as an
integer fails the query, as sums and errors would leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.places import kept
from assayer.llm.topk import usable

SCALE = 4096.0
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LEAF = 32
#: Components of a block, so that it and its trees stay within some megabytes whatever a vector's length.
BLOCK_CELLS = 1 << 19
LARGEST = 1 << 26


def whole(vector: Column) -> Column:
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * F.lit(SCALE))
        return F.when(F.abs(y) > LARGEST, F.raise_error(F.lit("a component times 4096 is beyond 2**26")).cast("long")).otherwise(y).cast("int")

    return F.transform(vector, one)


class Level(NamedTuple):
    """Nodes of one depth: where each starts, its box and the sum of its points."""

    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def edges(n: int, depth: int) -> np.ndarray:
    """Bounds of the 2**depth nodes at a depth; children of node i are 2 i and 2 i + 1."""
    return np.arange((1 << depth) + 1, dtype=np.int64) * n >> depth


def depth_of(n: int, leaf: int) -> int:
    """The greatest depth at which every node has a point and leaves have about ``leaf``."""
    return max(0, (max(n, 1) // leaf).bit_length() - 1)


def grown(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points in a tree that halves every node along its widest component."""
    n, order = len(points), np.arange(len(points))
    for depth in range(depth_of(n, leaf)):
        at = edges(n, depth)
        own = points[order]
        widest = (np.maximum.reduceat(own, at[:-1]) - np.minimum.reduceat(own, at[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(1 << depth), np.diff(at))
        order = order[np.lexsort((own[np.arange(n), widest[node]], node))]
    return order


def levels(points: np.ndarray, leaf: int) -> list[Level]:
    """Boxes and sums of all nodes over points in tree order."""
    out, n = [], len(points)
    wide = points.astype(np.int64)
    for depth in range(depth_of(n, leaf) + 1):
        at = edges(n, depth)[:-1]
        out.append(Level(at, np.minimum.reduceat(wide, at), np.maximum.reduceat(wide, at), np.add.reduceat(wide, at)))
    return out


class Entries:
    """The tree over a codebook: entries in tree order and the boxes of its nodes, down to single entries."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.order = grown(book, 1)
        self.levels = levels(book[self.order], 1)
        self.last = len(self.levels) - 1
        self.bounds = [edges(len(book), d) for d in range(self.last + 1)]


def between(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance of points of two boxes."""
    gap = np.maximum(np.maximum(low2 - high, low - high2), 0)
    span = np.maximum(high2 - low, high - low2)
    return (gap * gap).sum(axis=1), (span * span).sum(axis=1)


def descend(tree: list[Level], entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes assigned whole (depth, node, entry), and pairs (leaf, entry) that bounds leave open, by leaf and entry."""
    node, other, depth2 = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth, level in enumerate(tree):
        while True:
            box = entries.levels[depth2]
            least, most = between(level.low[node], level.high[node], box.low[other], box.high[other])
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            length = np.diff(np.r_[first, len(node)])
            near = least <= np.repeat(np.minimum.reduceat(most, first), length)
            node, other = node[near], other[near]
            if depth2 == entries.last or depth2 > depth:
                break  # both trees go down together; the smaller one to its end first
            node, other = np.repeat(node, 2), np.c_[2 * other, 2 * other + 1].ravel()
            depth2 += 1
        # A pair names entries first .. last; one pair with one entry, and its node is done.
        lo, hi = entries.bounds[depth2][other], entries.bounds[depth2][other + 1]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        length = np.diff(np.r_[first, len(node)])
        alone = np.repeat(length == 1, length) & (hi - lo == 1)
        done.append((np.full(alone.sum(), depth), node[alone], entries.order[lo[alone]]))
        node, other = node[~alone], other[~alone]
        if not len(node):
            break
        if depth + 1 < len(tree):
            node, other = np.r_[2 * node, 2 * node + 1], np.r_[other, other]
            order = np.argsort(node, kind="stable")
            node, other = node[order], other[order]
    lo, hi = entries.bounds[depth2][other], entries.bounds[depth2][other + 1]
    leaf = np.repeat(node, hi - lo)
    open_entries = np.concatenate([entries.order[a:b] for a, b in zip(lo.tolist(), hi.tolist())] or [np.zeros(0, np.int64)])
    depths, nodes, assigned = (np.concatenate(x) for x in zip(*done))
    return depths, nodes, assigned, leaf, open_entries


def assign(points: np.ndarray, tree: list[Level], entries: Entries) -> tuple[np.ndarray, np.ndarray]:
    """For points in tree order: sums (a row for each entry: count, then components), and the entry of each point."""
    n, size = points.shape
    book = entries.book
    sums, codes = np.zeros((len(book), size + 1), np.int64), np.full(n, -1, np.int64)
    depths, nodes, assigned, leaf, candidates = descend(tree, entries)
    for depth, node, entry in zip(depths.tolist(), nodes.tolist(), assigned.tolist()):
        at = edges(n, depth)
        sums[entry, 0] += at[node + 1] - at[node]
        sums[entry, 1:] += tree[depth].sums[node]
        codes[at[node] : at[node + 1]] = entry
    if len(leaf):
        at = edges(n, len(tree) - 1)
        best = np.full(n, np.iinfo(np.int64).max)
        for e in np.unique(candidates).tolist():  # in order, so that ties stay with the lower index
            own = leaf[candidates == e]
            marks = np.zeros(n + 1, np.int64)
            np.add.at(marks, at[own], 1)
            np.add.at(marks, at[own + 1], -1)
            rows = np.flatnonzero(np.cumsum(marks[:-1]))
            gap = points[rows].astype(np.int64) - book[e]
            gap = (gap * gap).sum(axis=1)
            closer = gap < best[rows]
            best[rows[closer]], codes[rows[closer]] = gap[closer], e
        rows = np.flatnonzero(best < np.iinfo(np.int64).max)
        wide = np.c_[np.ones(len(rows), np.int64), points[rows].astype(np.int64)]
        np.add.at(sums, codes[rows], wide)
    return sums, codes


def packed(rows: DataFrame, length: int) -> DataFrame:
    """A row for each block: ids, labels (as an Arrow file), points of each position in tree order, the orders, and trees."""
    size, most = length // PARTS, max(1, BLOCK_CELLS // length)

    def block(batch: pa.Table) -> dict[str, bytes]:
        points = batch["v"].combine_chunks().flatten().to_numpy().reshape(-1, PARTS, size)
        orders = [grown(points[:, p], LEAF) for p in range(PARTS)]
        own = [points[o, p] for p, o in enumerate(orders)]
        trees = [np.concatenate([np.stack(level[1:]) for level in levels(x, LEAF)], axis=1) for x in own]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.select(["vec_id", "label"]).schema) as out:
            out.write_table(batch.select(["vec_id", "label"]))
        return {"rows": sink.getvalue().to_pybytes(), "points": np.stack(own).astype("<i4").tobytes(), "orders": np.stack(orders).astype("<i4").tobytes(), "trees": np.stack(trees).astype("<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for start in range(0, b.num_rows, most):
                piece = b.slice(start, most)
                if n + piece.num_rows > most:
                    yield made(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([block(pa.Table.from_batches(held))], pa.schema([(c, pa.binary()) for c in ("rows", "points", "orders", "trees")]))

    return rows.select("vec_id", "label", "v").mapInArrow(run, "rows binary, points binary, orders binary, trees binary")


def opened(points: bytes, trees: bytes, size: int) -> Iterator[tuple[np.ndarray, list[Level]]]:
    """Points and tree of each position of a block."""
    own = np.frombuffer(points, "<i4").reshape(PARTS, -1, size)
    n = own.shape[1]
    nodes = np.frombuffer(trees, "<i8").reshape(PARTS, 3, -1, size)
    for p in range(PARTS):
        tree, at = [], 0
        for depth in range(depth_of(n, LEAF) + 1):
            low, high, sums = nodes[p, :, at : at + (1 << depth)]
            tree.append(Level(edges(n, depth)[:-1], low, high, sums))
            at += 1 << depth
        yield own[p], tree


def summed(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """(position, entry, count and component sums) over all blocks under the codebooks."""
    size = books.shape[2]
    out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Entries(b) for b in books]
        total = np.zeros((PARTS, books.shape[1], size + 1), np.int64)
        for b in batches:
            for points, tree in zip(b.column("points").to_pylist(), b.column("trees").to_pylist()):
                for p, (own, levels_of) in enumerate(opened(points, tree, size)):
                    total[p] += assign(own, levels_of, trees[p])[0]
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], schema=out)

    partial = blocks.select("points", "trees").mapInArrow(run, "part int, entry int, sums array<long>")
    columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size + 1)]
    total = np.zeros((PARTS, books.shape[1], size + 1), np.int64)
    for r in partial.groupBy("part", "entry").agg(*columns).collect():  # a row for each entry
        total[r.part, r.entry] = r[2:]
    return total


def trained(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        sums = summed(blocks, books)
        count = sums[:, :, :1]
        books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
    return books


def coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    size = books.shape[2]
    out = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Entries(b) for b in books]
        for b in batches:
            for held, points, orders, tree in zip(*(b.column(c).to_pylist() for c in ("rows", "points", "orders", "trees"))):
                rows = pa.ipc.open_stream(held).read_all()
                codes, error = np.zeros((rows.num_rows, PARTS), np.uint8), np.zeros(rows.num_rows, np.int64)
                for p, (order, (own, levels_of)) in enumerate(zip(np.frombuffer(orders, "<i4").reshape(PARTS, -1), opened(points, tree, size))):
                    found = assign(own, levels_of, trees[p])[1]
                    gap = own.astype(np.int64) - books[p][found]
                    codes[order, p] = found
                    error[order] += (gap * gap).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([rows["vec_id"].combine_chunks(), rows["label"].combine_chunks(), pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def least(rows: DataFrame) -> list[list[int]]:
    """The vectors of the ENTRIES smallest ids."""
    return [r.v for r in rows.orderBy("vec_id", "v").select("v").limit(ENTRIES).collect()]


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks by position, entry and component)."""
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vector)) & (F.size(vector) % PARTS == 0)).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector)).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    first = least(rows)
    if not first:
        return df.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    length = len(first[0])
    rows = rows.filter(F.size("v") == length)
    if any(len(v) != length for v in first):
        first = least(rows)
    first = np.array(first, np.int64)
    books = first.reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    blocks = kept(packed(rows, length), "blocks")
    books = trained(blocks, books, rounds)
    return coded(blocks, books, kind), books


def listed(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error`` added: errors summed over equal labels, nulls together; summed before the shuffle."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op11_codebooks(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    codes = with_label_error(kept(codes, "codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(listed(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT p.nth, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN b{k} b USING (part)),
a{k} AS MATERIALIZED (SELECT nth, part, min(entry) AS entry, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY nth, part) AS least FROM d{k}) WHERE d = least GROUP BY nth, part)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT part, entry, place, sum(value)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM a{k} JOIN parts USING (nth, part)) GROUP BY ALL),
n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN n{k} n USING (part, entry))""")
    return f"""
WITH whole AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
rows AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS nth FROM whole WHERE len(v) = (SELECT len(v) FROM whole ORDER BY vec_id, v LIMIT 1)),
parts AS MATERIALIZED (SELECT nth, part::INT AS part, v[1 + part * len(v) // 8 : (part + 1) * len(v) // 8] AS x FROM rows, range(8) r(part)),
b0 AS (SELECT part, nth::INT - 1 AS entry, x FROM parts WHERE nth <= 16),
{", ".join(steps)},
coded AS (SELECT nth, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY nth),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM rows JOIN coded USING (nth), book"""


OP11_SQL = _sql()
