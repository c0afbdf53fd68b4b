"""Folds on streams: rows shuffled over micro-batches equal the batch result, late rows fall away, state stays bounded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import audit, limits, recognition
from assayer.streaming import folds, ordered


def streamed(spark, tmp_path, name, build, rows, batches, closing):
    """What the stream of ``batches`` (lists of row positions, a file each) and then of two closing rows gives."""
    src, kept = str(tmp_path / "in"), rows.collect()
    for n, own in enumerate([*batches, None, None]):
        part = [closing] if own is None else [kept[i] for i in own]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ordered.use_rocksdb(spark)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def shuffled(n, parts, seed):
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return [order[k::parts] for k in range(parts)]


@pytest.fixture(scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.usefixtures("few_partitions")
@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_shuffled_micro_batches(spark, tmp_path, seed):
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("tenant_id"), "id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("at"), F.concat(F.lit("p"), F.col("id")).alias("payload"))
    late = spark.sql("select timestamp_seconds(1800000000) as at").head().at
    got = streamed(spark, tmp_path, f"chained{seed}", lambda s: folds.append(s, "1 hour"), rows, shuffled(60, 4, seed), ("closing", 0, late, "x"))
    want = sorted(tuple(r) for r in audit.append(rows).collect())
    assert [r for r in got if r[0] != "closing"] == want


@pytest.mark.usefixtures("few_partitions")
def test_breakers_of_shuffled_micro_batches(spark, tmp_path):
    rows = spark.range(80).select((F.col("id") % 2).alias("provider"), F.col("id").alias("seq"), (F.col("id") * 2 + 1_700_000_000).cast("double").alias("at"), (F.pmod(F.col("id") * 7, F.lit(5)) < 3).alias("failed"))
    got = streamed(spark, tmp_path, "breakers", lambda s: folds.circuit_breaker(s, 2, 9.0, "1 hour"), rows, shuffled(80, 4, 5), (-1, 0, 1.8e9, False))
    assert [r for r in got if r[0] != -1] == sorted(map(tuple, recognition.circuit_breaker(rows, 2, 9.0).collect()))


@pytest.mark.usefixtures("few_partitions")
def test_late_rows_fall_away(spark, tmp_path):
    """The last file's row belongs where the watermark has passed; the one before still finds its place."""
    rows = spark.createDataFrame([(1, "read", i, 1.7e9 + t) for i, t in enumerate([0, 10, 4000, 4010, 1, 4005])], "caller long, kind string, seq long, at double")
    got = streamed(spark, tmp_path, "late", lambda s: folds.rate_limit(s, {"read": 2}, 60.0, "10 minutes"), rows, [[0, 1], [2, 3], [5], [4]], (-1, "read", 0, 1.8e9))
    own = [r for r in got if r[0] == 1]
    assert [(r[2], r[4]) for r in own] == [(0, True), (1, True), (2, True), (3, False), (5, True)]


def replayed(rows, caps, window):
    """Each request against all that were let through before it."""
    out, passed = [], []
    for caller, kind, seq, at in sorted(rows, key=lambda r: (r[3], r[2])):
        live = [t for c, k, t in passed if c == caller and k == kind and at - window < t]
        if len(live) < caps[kind]:
            passed.append((caller, kind, at))
        out.append((caller, kind, seq, at, len(live) < caps[kind], min(len(live) + 1, caps[kind])))
    return sorted(out)


@pytest.mark.usefixtures("few_partitions")
def test_rate_limits_against_a_replay(spark, tmp_path):
    rng = random.Random(9)
    data = [(rng.randint(0, 3), rng.choice(["auth", "upload", "read"]), i, 1.7e9 + rng.choice([rng.uniform(0, 400), rng.randint(0, 100)])) for i in range(400)]
    caps = {"auth": 5, "upload": 7, "read": 9}
    rows = spark.createDataFrame(data, "caller long, kind string, seq long, at double")
    batch = limits.rate_limit(rows, caps).collect()
    assert sorted((r.caller, r.kind, r.seq, r.at, r.allowed, r.used) for r in batch) == replayed(data, caps, 60.0)
    assert all((r.retry_after is None) == r.allowed and (r.allowed or 0 < r.retry_after <= 60) for r in batch) and any(not r.allowed for r in batch)
    got = streamed(spark, tmp_path, "limited", lambda s: folds.rate_limit(s, caps, 60.0, "1 hour"), rows, shuffled(400, 4, 3), (-1, "read", 0, 1.8e9))
    assert [r for r in got if r[0] != -1] == sorted(map(tuple, batch), key=repr) or sorted(r[:6] for r in got if r[0] != -1) == sorted(tuple(r)[:6] for r in batch)
    assert limits.tenant_ceiling(rows.select(F.lit(1).cast("long").alias("tenant"), "seq", "at"), 20).filter("allowed").count() < 400


def test_limits_as_stated():
    assert limits.LIMITS == {"auth": 5, "upload": 60, "read": 300} and limits.WINDOW == 60.0
