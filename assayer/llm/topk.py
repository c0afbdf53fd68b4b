"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors become integers, floor(256 x) of every component. Candidates are grouped by length into buckets whose
lengths differ by a twentieth at most, and a bucket's rows are dealt into blocks by a hash, so that a bucket with most
rows is many blocks. A first round scores every query against the longest block and so bounds
its k-th score from below. A second round meets query blocks with candidate blocks: the bound, divided by
the query's length and the block's greatest length, is the block's local cosine threshold. Above 1 the block is
skipped; a low threshold is met by length alone, as a prefix of the block sorted by length; a high one by the
query's largest coordinates, each of which limits the same coordinate of any vector at that cosine to a range.
What is left is verified with exact products.

Scores are exact whatever the components: products are taken in doubles while their sums stay below 2**53, in 64-bit
integers below 2**63, else in Python's integers. Components that don't fit 64 bits, and scores that don't, have no exact value of the
result's type: the query fails there and drops nothing.

A vector that is null, or holds a null or non-finite component, takes no part; vectors of other dimensions than the query's are no candidates. A repeated query id asks once,
with the greatest of its vectors; repeated candidate rows each count. Rows of a query's own id are no
candidates. A row with a null id takes no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.places import kept

SCALE = 256.0
RATIO = 1.05
BLOCK_ROWS = 8192
#: Keys over which candidate blocks are dealt where they meet the queries: at least so many, and one for so many blocks.
DEALS, DEAL_BLOCKS = 64, 32
QUERY_ROWS = 1024
#: Local cosine thresholds from which coordinates prune, and how many of a query's are used.
COORDINATE_FROM = 0.75
FOCUS = 4


def scaled(vector: Column) -> Column:
    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(SCALE)
        beyond = finite(x) & (F.abs(y) >= F.lit(2.0**63))
        return F.when(beyond, F.raise_error(F.lit("a component times 256 is beyond 64 bits")).cast("long")).otherwise(F.floor(y))

    return F.transform(vector, whole)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<long>, dim, squared, bucket); squared is rounded beyond 2**53."""
    own = df.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), scaled(F.col(vector)).alias("v"))
    own = own.withColumn("squared", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).withColumn("dim", F.size("v"))
    return own.withColumn("bucket", F.when(F.col("squared") > 0, F.floor(F.log("squared") / F.lit(2 * np.log(RATIO)))).otherwise(-1).cast("int"))


def blocks(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """A row for each block: ids, a matrix and the greatest squared length; rows in the order of length."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["squared", "id"], ascending=[False, True], kind="stable")
        matrix = np.stack(pdf["v"].to_numpy())
        matrix = matrix.astype("<i4" if np.abs(matrix).max(initial=0) < 2**31 else "<i8")
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "ids": [pdf["id"].to_numpy("<i8").tobytes()], "matrix": [matrix.tobytes()], "squared": [float(pdf["squared"].iloc[0])]})

    names = {"dim": "int", "bucket": "int", "sub": "long"}
    return rows.groupBy(*by).applyInPandas(pack, ", ".join(f"{c} {names[c]}" for c in by) + ", ids binary, matrix binary, squared double")


def dealt(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """``sub`` added: rows of a group dealt over as many blocks as its count asks for."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))  # a row for each dimension and bucket
    return rows.join(F.broadcast(counts), by).withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / size))).drop("n")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 8 * k:
        floor = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def products(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while sums stay below 2**53, in 64-bit integers below 2**63, else in Python's."""
    most = int(np.abs(matrix).max(initial=0)) * int(np.abs(vector).max(initial=0)) * len(vector)
    if most < 2**53:
        return (matrix.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return matrix.astype(np.int64) @ vector.astype(np.int64)
    return matrix.astype(object) @ vector.astype(object)


def rows_of(block: bytes, count: int, dim: int) -> np.ndarray:
    """The matrix of a block, in 4 or 8 bytes a component."""
    return np.frombuffer(block, f"<i{len(block) // (count * dim)}").reshape(count, dim)


def meet(queries: tuple, candidates: tuple, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) of the best k in one block for each query that it may serve."""
    query_ids, query_rows = queries
    ids, rows = candidates
    exact = rows.astype(np.float64)
    lengths = np.sqrt((exact * exact).sum(axis=1))
    top = lengths[0]
    ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.sqrt((query_rows.astype(np.float64) ** 2).sum(axis=1))
    greatest = float(np.abs(rows).max(initial=0))
    for i, (q, bound) in enumerate(zip(query_ids.tolist(), bounds.tolist())):
        own, size = query_rows[i].astype(np.float64), sizes[i]
        slack = 1e-9 * max(1.0, abs(bound))
        local = (bound - slack) / (size * top) if size > 0 and top > 0 else -1.0 if bound <= 0 else 2.0
        if local > 1:
            continue
        if local <= 0 or not np.isfinite(bound):
            chosen = slice(None)
        elif local < COORDINATE_FROM:  # a prefix of the block, in the order of length
            chosen = slice(0, int(np.searchsorted(-lengths, -(bound - slack) / size, side="right")))
        else:
            focus = np.argsort(-np.abs(own))[:FOCUS]
            seen = np.zeros(len(ids), np.int16)
            for f in focus.tolist():
                if f not in ordered:
                    unit = exact[:, f] / np.maximum(lengths, 1e-300)
                    order = np.argsort(unit, kind="stable")
                    ordered[f] = order, unit[order]
                order, values = ordered[f]
                x = own[f] / size
                swing = np.sqrt(max(0.0, 1 - local * local)) * np.sqrt(max(0.0, 1 - x * x))
                a, b = np.searchsorted(values, x * local - swing - 1e-9), np.searchsorted(values, (x * local + swing if x * local + swing < 1 and x < local else 1.0) + 1e-9, side="right")
                a = a if -x < local else 0  # a query along -f: nothing limits from below
                seen[order[a:b]] += 1
            chosen = np.flatnonzero(seen == len(focus))
        picked = ids[chosen]
        if not len(picked):
            continue
        if greatest * float(np.abs(own).max(initial=0)) * len(own) < 2**53:
            scores = (exact[chosen] @ own).astype(np.int64)
        else:
            scores = products(rows[chosen], query_rows[i])
        other = picked != q
        if np.isfinite(bound):
            other &= scores >= bound
        picked, scores = picked[other], scores[other]
        if len(picked):
            at = best(scores, picked, k)
            yield q, picked[at], scores[at]


PAIRED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scored(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The best k of each pair of blocks (query blocks with ``bounds``); one row is one pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                asked = (ids := np.frombuffer(r["q_ids"], "<i8")), rows_of(r["q_matrix"], len(ids), r["dim"])
                given = (ids := np.frombuffer(r["ids"], "<i8")), rows_of(r["matrix"], len(ids), r["dim"])
                found = list(meet(asked, given, np.frombuffer(r["bounds"], "<f8"), k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]), pa.int64()), pa.array(np.concatenate([x for _, x, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, _, s in found]), pa.int64())], schema=PAIRED)

    # Candidate blocks are dealt over keys and shuffled once; a query block has a copy for each key, not for each block. Neither
    # side is broadcast by force, and a pair that the bound leaves in never leaves its task.
    blocks = candidates.count()
    deals = max(1, min(blocks, max(DEALS, blocks // DEAL_BLOCKS)))
    given = candidates.withColumn("deal", F.pmod(F.xxhash64("bucket", "sub"), F.lit(deals)))
    asked = queries.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    least = (F.col("low") <= 0) | (F.col("low") * F.col("low") <= F.col("q_squared") * F.col("squared") * 1.000001)
    pairs = given.join(asked, ["dim", "deal"]).filter(least)
    return pairs.select("dim", "q_ids", "q_matrix", "bounds", "ids", "matrix").mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k rows of each query, by partial results of at most k from every block."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner products for each query."""
    rows = prepared(candidates, key, vector)
    given = kept(blocks(dealt(rows, ["dim", "bucket"], BLOCK_ROWS), ["dim", "bucket", "sub"], BLOCK_ROWS), "blocks")
    asked = prepared(queries, key, vector).groupBy("id").agg(F.max(F.struct("v", "squared", "dim")).alias("x")).select("id", "x.v", "x.squared", "x.dim")
    asked = kept(blocks(dealt(asked, ["dim"], QUERY_ROWS), ["dim", "sub"], QUERY_ROWS), "queries")
    asked = asked.select("dim", F.col("sub").alias("q_sub"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("squared").alias("q_squared"))
    # First round: the block of the greatest length for each dimension.
    lead = given.groupBy("dim").agg(F.max(F.struct("squared", "bucket", F.col("sub").alias("s"))).alias("x")).select("dim", F.col("x.bucket").alias("bucket"), F.col("x.s").alias("sub"))
    first = given.join(F.broadcast(lead), ["dim", "bucket", "sub"], "left_semi")
    free = asked.withColumn("bounds", lowest()).withColumn("low", F.lit(0.0))
    seeds = kept(scored(free, first, k), "seeds")
    kth = seeds.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id", "bound")
    bounded = with_bounds(asked, kth)
    rest = given.join(F.broadcast(lead), ["dim", "bucket", "sub"], "left_anti")
    found = seeds.unionByName(scored(bounded, rest, k))
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def lowest() -> Column:
    """Bounds of minus infinity, as doubles, for a block of ids."""
    return F.unhex(F.expr("repeat('000000000000F0FF', cast(octet_length(q_ids) / 8 as int))"))


def with_bounds(asked: DataFrame, kth: DataFrame) -> DataFrame:
    """Query blocks with the first round's bounds in the order of their ids."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("q_ids")[i].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([b.column("dim")[i].as_py()] * len(ids), pa.int32()), pa.array([b.column("q_sub")[i].as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)], ["dim", "q_sub", "place", "query_id"])

    flat = asked.select("dim", "q_sub", "q_ids").mapInArrow(ids_of, "dim int, q_sub long, place int, query_id long").join(kth, "query_id", "left")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds = pdf.sort_values("place")["bound"].astype(float).fillna(-np.inf).to_numpy("<f8")
        bounds = np.where(np.abs(bounds) < 2**53, bounds, np.nextafter(bounds, -np.inf))  # rounded scores: never above the k-th
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "q_sub": [pdf["q_sub"].iloc[0]], "bounds": [bounds.tobytes()], "low": [max(0.0, float(bounds.min()))]})

    return asked.join(flat.groupBy("dim", "q_sub").applyInPandas(pack, "dim int, q_sub long, bounds binary, low double"), ["dim", "q_sub"])


def op3_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows.filter("vec_id % 50 = 0"), rows, 5)


OP3_SQL = """
WITH rows AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""
