"""Queries that SQL can't express, value by value against plain versions."""

from __future__ import annotations

import itertools
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from compare import SMALL
from pyspark.sql import functions as F
from test_scoring import distance

from assayer import catalog
from assayer.functions import text
from assayer.operators import results, rubric, rules, tenancy


def load(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


def run(spark, name: str) -> pd.DataFrame:
    return catalog.QUERIES[name](spark, SMALL).toPandas()


def words(t: str) -> list[str]:
    return unicodedata.normalize("NFKC", t).lower().split()


def test_word_errors(spark):
    turns, mistaken = load("conversations"), str.maketrans("mnrv", "nmnu")
    want = {}
    for r in turns.itertuples():
        n, e, l = want.get(r.role, (0, 0, 0))
        ref = words(r.text)
        want[r.role] = n + 1, e + distance(ref, words(r.text.translate(mistaken))), l + len(ref)
    assert {r.role: (r.n, r.errors, r.length) for r in run(spark, "wer_by_role").itertuples()} == want
    read = [r for r in turns.itertuples() if (r.conv_id + r.turn) % 9 and (r.conv_id * 3 + r.turn) % 5]
    got = run(spark, "score_words").iloc[0]
    errors, total = sum(distance(words(r.text), words(r.text.translate(str.maketrans("mv", "nu")))) for r in read), sum(len(words(r.text)) for r in read)
    assert (got.measured, got.word_errors, got.words) == (len(read), errors, total) and got.wer == pytest.approx(errors / total)


def test_words_of_one_row_at_a_time(spark):
    """A million tokens in a batch: only a row's are Python strings at once; batches themselves have 4 MB."""
    line = [f"w{i % 700}" for i in range(5000)]
    read = [*line[:2500], "x", *line[2501:]]
    a, b = pa.array([line] * 200 + [None]), pa.array([read] * 200 + [line])
    tracemalloc.start()
    try:
        got = text._word_edits.func(a, b)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [1] * 200 + [None] and peak < 8 << 20
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        catalog.QUERIES["score_words"](spark, SMALL)
        many = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
        assert max(r.n for r in spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).select(many("t").alias("n")).collect()) <= 8
    finally:
        spark.conf.unset(key)


def plain_sentences(t: str) -> list[str]:
    t = regex.sub(r"(\p{L})-\n(\p{Ll})", r"\1\2", t)
    parts = regex.split(r"\n+(?=\p{Lu}|[-*•]|\(?[0-9a-z]{1,2}[.)])|(?<=[.!?])[ \t\n\x0b\f\r]+(?=\p{Lu})", t)
    parts = [p for p in (regex.sub(r"[ \t\n\x0b\f\r]+", " ", p).strip(" ") for p in parts) if p]
    done, held = [], ""
    for p in parts:
        held = f"{held} {p}" if held else p
        if len(held.split(" ")) >= 4:
            done.append(held)
            held = ""
    return done + [held] * bool(held)


def test_sentences_of_whole_documents(spark):
    want = {r.doc_id: plain_sentences(r.text) for r in load("documents").itertuples()}
    want = {k: (len(s), sum(len(x.split(" ")) for x in s)) for k, s in want.items() if s}
    assert {r.doc_id: (r.sentences, r.tokens) for r in run(spark, "sentence_segments").itertuples()} == want
    assert max(n for n, _ in want.values()) > 120


def test_assignment(spark):
    e = load("embeddings")
    e["unit"] = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for v in e.embedding]
    want = {}
    for label, own in e.groupby("label"):
        points = {p: np.mean([np.array(v, float) for v in g.embedding], axis=0) for p, g in own.groupby(own.vec_id % 3)}
        scores = {}
        for p, m in points.items():
            near = sorted(((-float(u @ m / np.linalg.norm(m)), i) for i, u in zip(own.vec_id, own.unit)), key=lambda x: (x[0], x[1]))
            for s, i in [x for x in near if -x[0] >= 0.25][:5]:
                scores[p, i] = -s
        options = [[None, *(i for q, i in scores if q == p)] for p in points]
        want[label] = max(sum(scores[p, i] for p, i in zip(points, c) if i is not None) for c in itertools.product(*options) if len({i for i in c if i is not None}) == sum(i is not None for i in c))
    got = run(spark, "assignment")
    assert set(got.grp) == set(want) and all(r.total == pytest.approx(want[r.grp], abs=2e-5) for r in got.itertuples())


def bucket(*parts) -> int:
    return zlib.crc32("".join(map(str, parts)).encode()) % 100


def test_splits_and_samples(spark):
    place = [bucket(i) for i in load("labels").doc_id]
    want = {"train": sum(p < 60 for p in place), "validate": sum(60 <= p < 80 for p in place), "test": sum(p >= 80 for p in place)}
    assert {r.part: r.n for r in run(spark, "data_split").itertuples()} == want
    orders = load("orders")
    assert set(run(spark, "sampled_scripts").o_orderkey) == {i for i in orders.o_orderkey if bucket(i, "moderate") < 10}
    why = {}
    for r in orders.itertuples():
        near = any(abs(r.o_totalprice / 1000 - b) <= 2.0 for b in (40.0, 70.0, 100.0))
        kind = "OVERRIDDEN" if r.o_orderstatus == "P" else "BOUNDARY" if near else "SAMPLE" if bucket(r.o_orderkey, "moderate") < 10 else None
        why |= {r.o_orderkey: kind} if kind else {}
    assert {r.o_orderkey: r.why for r in run(spark, "moderation").itertuples()} == why and set(why.values()) == {"OVERRIDDEN", "BOUNDARY", "SAMPLE"}


def test_isotonic_scores_by_pooling(spark):
    got = run(spark, "calibrated_scores")
    rows = got.merge(load("labels")[["doc_id", "quality"]]).sort_values("score")
    blocks = []
    for score, g in rows.groupby("score"):
        blocks.append([float(g.quality.mean()), len(g), [score]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, s = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + s]
    want = {s: m for m, _, ss in blocks for s in ss}
    assert all(r.calibrated == pytest.approx(want[r.score], abs=1e-9) for r in got.itertuples())


def test_platt_scores_are_a_maximum(spark):
    got = run(spark, "platt_scores")
    x, y, p = (got[c].to_numpy(float) for c in ("score", "quality", "calibrated"))
    assert abs((p - y).sum()) < 1e-3 and abs(((p - y) * x).sum()) < 1e-3  # the likelihood's slopes are 0


def test_pixels(spark):
    e = load("embeddings").set_index("vec_id").embedding
    for r in run(spark, "pixel_measures").itertuples():
        a = np.clip(np.floor(np.array(e[r.vec_id], np.float32).astype(float) * 400 + 128), 0, 255).reshape(8, -1)
        p = np.pad(a, 1, mode="reflect")
        edges = [p[i - 1, j] + p[i + 1, j] + p[i, j - 1] + p[i, j + 1] - 4 * p[i, j] for i in range(1, 9) for j in range(1, a.shape[1] + 1)]
        assert (r.sharpness, r.brightness, r.clipped) == pytest.approx((np.var(edges), a.mean(), (a == 255).mean()), abs=2e-6)
    for r in run(spark, "cropped_pixels").itertuples():
        a = (np.floor(np.array(e[r.vec_id], np.float32).astype(float) * 100).astype(int) % 200).astype(np.uint8).reshape(8, -1)
        assert bytes.fromhex(r.part) == a[3:, 2:5].tobytes()
        a[3:, 2:5] = 255
        assert bytes.fromhex(r.rest) == a.tobytes()


def points(spark, rows):
    return spark.createDataFrame(rows, "script int, question int, code string, max_marks double, rule string, marks double, question_max double, requires string")


def test_question_caps_and_rounding(spark):
    """Any two of four: the points' maxima sum to 8, the question has 3; 0.75 rounds half-up once; a penalty may be kept."""
    rows = [(1, 1, c, 2.0, "R-ENTAIL-FULL", 2.0, 3.0, None) for c in "abc"] + [(2, 1, c, 1.0, "R-ENTAIL-FULL", 0.25, 3.0, None) for c in "abc"] + [(3, 1, "a", 1.0, "R-CONTRADICTION-PENALTY", -0.75, 3.0, None)]
    got = {r.script: (r.raw, r.marks) for r in rules.question_scores(points(spark, rows)).collect()}
    assert got == {1: (6.0, 3.0), 2: (0.75, 1.0), 3: (-0.75, 0.0)}
    assert {r.script: r.marks for r in rules.question_scores(points(spark, rows), negative_allowed=True).collect()}[3] == -1.0
    assert rules.question_scores(points(spark, rows).drop("question_max")).filter("script = 1").first().marks == 6.0


def test_chains_and_cycles_of_any_length(spark):
    chain = [(1, 1, f"c{i}", 1.0, "R-ENTAIL-FULL", float(i != 1), 9.0, f"c{i - 1}" if i > 1 else None) for i in range(1, 14)]
    loop = [(1, 2, f"d{i}", 1.0, "R-ENTAIL-FULL", 1.0, 9.0, f"d{i % 3}") for i in range(3)] + [(1, 2, "e", 1.0, "R-ENTAIL-FULL", 1.0, 9.0, "none")]
    got = {r.code: (r.rule, r.marks) for r in rules.dependencies(points(spark, chain + loop)).collect()}
    assert got == {f"c{i}": ("R-DEPENDENCY" if i > 1 else "R-ENTAIL-FULL", 0.0) for i in range(1, 14)} | {f"d{i}": ("R-ENTAIL-FULL", 1.0) for i in range(3)} | {"e": ("R-DEPENDENCY", 0.0)}
    edges = [("q", f"a{i}", f"a{(i + 1) % 11}") for i in range(11)] + [("q", "t", "a0"), ("r", "a0", "a1")]
    found = rubric.cycles(spark.createDataFrame(edges, "question string, code string, requires string")).collect()
    assert {(r.question, r.code) for r in found} == {("q", f"a{i}") for i in range(11)}


def test_scopes_and_filters(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "tenant_id string, n int")
    with pytest.raises(ValueError, match="no column"):
        tenancy.refuse_unscoped(df.drop("tenant_id"))
    with pytest.raises(Exception, match="tenant_id is null"):
        tenancy.refuse_unscoped(df).collect()
    assert tenancy.refuse_unscoped(df.filter("n = 1")).count() == 1
    assert [r.n for r in results.where(df, between={"n": (2, None)}).collect()] == [2] and results.where(df, {"n": [1, 2]}, {"n": (None, 1)}).count() == 1


def test_typed_tables_in_every_format(spark, tmp_path):
    from assayer import schemas
    from assayer.sources import tables

    rows = [("1", "t1", "a@x.org", None, "marker", "ACTIVE", 0, None, None), ("2", None, 'b,"q"', "h", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schemas.TABLES["users"])
    for form in ("parquet", "orc", "json"):
        df.write.format(form).save(f"{tmp_path}/{form}")
        assert sorted(tables.read(spark, "users", f"{tmp_path}/{form}", form).collect(), key=str) == sorted(df.collect(), key=str)
    tables.export_csv(df, f"{tmp_path}/csv")
    back = tables.read(spark, "users", f"{tmp_path}/csv", "csv")
    assert pd.concat(pd.read_csv(f, dtype={"id": str}) for f in tmp_path.glob("csv/*.csv")).set_index("id").email.to_dict() == {"1": "a@x.org", "2": 'b,"q"'}
    assert {r.id: r.email for r in back.collect()} == {"1": "a@x.org", "2": 'b,"q"'}
    with pytest.raises(Exception, match="exist"):
        tables.export_csv(df, f"{tmp_path}/csv")
    for _ in range(2):
        tables.append(df.withColumn("extra", F.lit(1)), "users", f"{tmp_path}/kept")
    assert tables.read(spark, "users", f"{tmp_path}/kept").count() == 4


def test_streamed_repeats_are_dropped(spark, tmp_path):
    from assayer.streaming import windows

    rows = spark.range(40).select((F.col("id") % 7).alias("key"), F.timestamp_seconds(F.col("id")).alias("at"))
    src = str(tmp_path / "attempts")
    for a in (0, 20):
        rows.filter(F.unix_seconds("at").between(a, a + 19)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = windows.first_of_key(stream, ["key"], "at").writeStream.format("memory").queryName("first").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("first").collect()) == sorted(r.key for r in windows.first_of_key(rows, ["key"], "at").collect()) == list(range(7))
