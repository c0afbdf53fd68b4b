"""Near-duplicate documents: fast similarity sketches, banding, and exact verification.

A document's set holds the fingerprints (64 bits) of its word shingles. The sketch has ``BANDS * ROWS`` places: in
round i every element falls into a place chosen by hash function i, the smallest hash of the earliest round that
reaches a place fills it, and rounds after the first ``BANDS * ROWS`` go to one fixed place each, so that
no place stays empty however small the set is. Documents that agree on all rows of a band are candidates;
at the similarity of 0.8, five rows and 40 bands miss a pair with a chance of about 1e-7.

Copies first fall into classes of equal sets. In a band's bucket the member with the most bucket-mates is
the centre; every other member is compared with it, on the full sets. Components of these links leave some
buckets with members in several components: there, and only there, members of different components meet again by
prefixes of their sets in the order of rarity, as long as exact bounds ask for, and what meets is compared on the full sets. A bucket
never becomes all its pairs, and no pair of candidates that could join two components is left out.

Null and empty texts, and texts without words, have empty sets and are linked with nothing. A text with
fewer words than a shingle is one shingle. A null id takes no part in links: its component is null and it is
kept. Equal ids are one node. Other columns are ignored. Texts count as whole, however long: a worker holds a batch of 1 MB or one
longer text, at some 100 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.batches import bounded, text_bytes
from assayer.llm.components import components
from assayer.llm.places import kept

WIDTH = 5
BANDS, ROWS = 40, 5
PERCENT = 80
U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of every element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mixed(np.arange(256, dtype=U) + U(0x9E3779B97F4A7C15))
BYTE[65:91] = BYTE[97:123]
FACTOR = U(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def powers(n: int) -> np.ndarray:
    return np.r_[U(1), np.cumprod(np.full(n, FACTOR))]


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted set of shingle fingerprints of each text."""
    body, at = text_bytes(column)
    solid = ~SPACES[body]
    solid_ahead = np.r_[False, solid[:-1]]
    edge = np.zeros(len(body), bool)
    edge[at[:-1][at[:-1] < len(body)]] = True  # a new text begins a new word
    starts = np.flatnonzero(solid & (~solid_ahead | edge))
    if not len(starts):
        return [np.zeros(0, U)] * len(column)
    place = np.maximum.accumulate(np.where(marks(len(body), starts), np.arange(len(body)), 0))
    place = np.arange(len(body)) - place
    table = powers(1 << int(place.max() + 1).bit_length())
    words = np.add.reduceat(np.where(solid, BYTE[body] * table[place], U(0)), starts)
    words = mixed(words)
    first = np.searchsorted(starts, at)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        w = words[a:b]
        k = min(width, len(w))
        if not k:
            out.append(np.zeros(0, U))
            continue
        total = np.full(len(w) - k + 1, U(k) if k < width else U(0))
        for i in range(k):
            total = mixed(total * FACTOR + w[i : len(w) - k + 1 + i])
        out.append(np.unique(total))
    return out


def marks(n: int, at: np.ndarray) -> np.ndarray:
    m = np.zeros(n, bool)
    m[at] = True
    return m


def sketch(own: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set: ``size`` values, the round in the high bits."""
    places = np.full(size, np.iinfo(U).max)
    todo, start = max(1, int(1.3 * size * np.log(size) / len(own))), 0
    while start < size:
        rounds = np.arange(start, min(size, start + todo), dtype=U)
        h = mixed(own[None, :] ^ mixed(rounds + U(1))[:, None])
        place = ((h >> U(32)) * U(size) >> U(32)).astype(np.int64)
        np.minimum.at(places, place.ravel(), ((rounds << U(32))[:, None] | (h & U(0xFFFFFFFF))).ravel())
        start += len(rounds)
        if places.max() != np.iinfo(U).max:
            return places
    for p in np.flatnonzero(places == np.iinfo(U).max).tolist():
        h = mixed(own ^ mixed(U(size + p + 1).reshape(1)))
        places[p] = U(size + p) << U(32) | (h & U(0xFFFFFFFF)).min()
    return places


def band_keys(places: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells, key = places.reshape(bands, rows), mixed(np.arange(bands, dtype=U))
    for i in range(rows):
        key = mixed(key * FACTOR + mixed(cells[:, i]))
    return key.view(np.int64)


def features(df: DataFrame, key: str, text: str, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set1, set2, bands): all that later steps need but the sets themselves."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            made = []
            for k, own in zip(b.column(key).to_pylist(), shingles(b.column(text), width)):
                digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                places = sketch(own, bands * rows) if len(own) else None
                made.append((k, len(own), digest[0], digest[1], None if places is None else band_keys(places, bands, rows)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), out)], schema=out)

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>")


def full_sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, members array<long>)."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            sets = shingles(b.column(text), width)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=out)

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "id long, n long, members array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, with the size of the intersection."""
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("members_b"))
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("members_a"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("members_a", "members_b")).cast("long")
    return both.select("a", "b", common.alias("common"), "n_a", "n_b").filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def close_in_size(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def across(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components around a centre that may be similar enough, by exact bounds.

    Sizes n and m need ``least`` = (n + m) * percent / (100 + percent) common members, and two components share only members that
    both have: what one component alone has around a centre is left out. Of the ``shared`` members that stay in a set, any two such sets meet by
    one of the first shared - least + 1, in an order that has members beyond the centre's set first, and rare ones before others.
    Sizes fall into classes of a tenth, and
    a set has a prefix for each class that a partner may be of, so ``least`` is close to what the pair needs. Members of most sets
    come last, so two large groups whose sets differ by more than their prefixes don't meet. A pair meets only where what follows in both
    sets is enough, and where what both share with the centre and what both have beyond it add up to enough. In a key, the largest component
    meets the others only, never itself.
    """
    own, by_member = W.partitionBy("centre", "id"), ["centre", "member"]
    rows = around.join(sets.select("id", "members"), "id").select("centre", "id", "n", "component", F.explode("members").alias("member"))
    inside = around.select(F.col("centre").alias("id")).distinct().join(sets.select("id", "members"), "id").select(F.col("id").alias("centre"), F.explode("members").alias("member"))
    counted = rows.select(*by_member, "component").unionByName(inside.withColumn("component", F.lit(None).cast("long")))
    holders = counted.groupBy(*by_member).agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("component").alias("times"), (F.count("*") > F.count("component")).alias("inside")).filter("c1 < c2").drop("c1", "c2")
    rows = rows.join(holders, by_member).withColumn("shared", F.count("*").over(own)).filter(F.col("shared") * 100 >= F.col("n") * percent)
    rows = rows.withColumns({"common": F.count_if("inside").over(own), "nth": F.row_number().over(own.orderBy("inside", "times", "member"))})
    step = lambda n: F.floor(F.log(n.cast("double")) / F.lit(np.log(1.1)))
    low, high = F.ceil(F.col("n") * percent / 100), F.floor(F.col("n") * 100 / percent)
    rows = rows.withColumn("kind", step(F.col("n"))).withColumn("other", F.explode(F.sequence(step(F.greatest(low, F.lit(1))), step(high))))
    partner = F.greatest(F.floor(F.pow(F.lit(1.1), F.col("other"))), low)
    needed = lambda n, m: F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    least = needed(F.col("n"), partner)
    rows = rows.filter((F.col("shared") >= least) & (F.col("nth") <= F.col("shared") - least + 1))
    key, sizes = [*by_member, "small", "large"], ["id", "n", "component", "common", "beyond", "left"]
    found = rows.select(*by_member, F.least("kind", "other").alias("small"), F.greatest("kind", "other").alias("large"), "kind", "other", "id", "n", "component", "common", (F.col("shared") - F.col("common")).alias("beyond"), (F.col("shared") - F.col("nth") + 1).alias("left"))
    rows = kept(found, "prefixes")
    groups = rows.groupBy(*key, "component").agg(F.count("*").alias("times"))
    major = groups.groupBy(*key).agg(F.max_by("component", F.struct("times", "component")).alias("major"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").drop("c1", "c2")
    y = rows.join(major, key).withColumn("minor", F.col("component") != F.col("major")).drop("major")
    x = y.filter("minor").select(*key, F.col("kind").alias("other"), F.col("other").alias("kind"), *(F.col(c).alias(f"{c}_x") for c in sizes))
    least = needed(F.col("n"), F.col("n_x"))
    enough = (F.least("left", "left_x") >= least) & (F.least("common", "common_x") + F.least("beyond", "beyond_x") >= least)
    met = x.join(y, [*key, "kind", "other"]).filter((F.col("component") != F.col("component_x")) & close_in_size("n", "n_x", percent) & (~F.col("minor") | (F.col("id") < F.col("id_x"))) & enough)
    return met.select(F.least("id", "id_x").alias("a"), F.greatest("id", "id_x").alias("b")).distinct()


def link(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    seen = kept(features(df, key, text, width), "features")
    usable = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = kept(usable.groupBy("set1", "set2").agg(F.min("doc_id").alias("id")), "classes")
    first = usable.join(classes.select(F.col("id").alias("doc_id"), "set1", "set2"), ["doc_id", "set1", "set2"], "left_semi")
    banded = first.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("mates")).filter("mates > 1")
    members = kept(banded.join(buckets, "band"), "members")
    crowd = members.groupBy("id").agg(F.sum("mates").alias("crowd"))
    ranked = members.select("band", "id", "n").join(crowd, "id")
    centres = ranked.groupBy("band").agg(F.max(F.struct("crowd", -F.col("id"), "n")).alias("c")).select("band", (-F.col("c.col2")).alias("b"), F.col("c.n").alias("n_b"))
    near = members.select("band", F.col("id").alias("a"), "n").join(centres, "band").filter((F.col("a") != F.col("b")) & close_in_size("n", "n_b", percent))
    pairs = kept(near.select("a", "b").distinct(), "pairs")
    wanted = members.select("id").distinct()
    sets = kept(full_sets(df.select(F.col(key).cast("long").alias(key), text).join(wanted.withColumnRenamed("id", key), key, "left_semi"), key, text, width), "sets")
    links = kept(verified(pairs, sets, percent), "links")
    found = kept(components(links), "components")
    # Buckets that still hold several components: their members meet again, once for each centre.
    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("band")
    around = named.join(several, "band").join(centres.select("band", F.col("b").alias("centre")), "band").filter("id <> centre")
    around = kept(around.select("centre", "id", "n", "component").distinct(), "around")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = kept(verified(across(around, sets, percent).join(tried, ["a", "b"], "left_anti"), sets, percent), "links")
    if not more.isEmpty():
        upper = found.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
        found = kept(components(upper.union(more)), "components")
    of_class = classes.join(found, classes.id == found.node, "left").select("set1", "set2", F.coalesce("component", "id").alias("component"))
    whole = seen.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set1")).alias("set1"), "set2").join(of_class, ["set1", "set2"], "left")
    named = whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows of ``df`` without near-duplicates: the smallest id of each group stays, once.

    Rows without an id or without a word are near-duplicates of nothing; rows of one id are one document.
    """
    chosen = link(df, key, text, width, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    once = W.partitionBy(key).orderBy(F.xxhash64(text))
    named = df.filter(F.col(key).isNotNull()).join(chosen, key, "left_semi")
    named = named.withColumn("__nth", F.row_number().over(once)).filter("__nth = 1").select(*df.columns)
    return named.unionByName(df.filter(F.col(key).isNull()))


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return link(docs, width=2)
