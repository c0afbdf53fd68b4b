"""Calibration, corrections, numbered lines, batches, exit codes and scopes."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import schemas
from assayer.operators import audit, calibration, capture, corrections, recognition, tenancy
from assayer.sources import exports, golden, tables


def level(points):
    """The isotonic values of (bin, n, good) in order, by the greatest least mean of all spans."""
    n = len(points)
    mean = lambda a, b: sum(p[2] for p in points[a : b + 1]) / sum(p[1] for p in points[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_pooled_parts_pool_to_the_same(seed):
    rng = random.Random(seed)
    points = [(b, n, rng.randint(0, n)) for b in sorted(rng.sample(range(1000), 40)) for n in [rng.randint(1, 6)]]
    blocks = [(b, b, n, g) for b, n, g in points]
    whole = calibration.pooled(blocks)
    cut = rng.randint(0, 40)
    assert calibration.pooled(calibration.pooled(blocks[:cut]) + calibration.pooled(blocks[cut:])) == whole
    want = level(points)
    for b, v in zip((p[0] for p in points), want):
        lo, hi, n, g = next(x for x in whole if x[0] <= b <= x[1])
        assert g / n == pytest.approx(v)


def test_groups_are_calibrated_apart_on_three_parts(spark, monkeypatch):
    """Each group's curve, threshold and report by hand; the parts that are fitted and chosen on aren't reported."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        group, s = i % 3, round(rng.random(), 4)
        good = rng.random() < (s if group == 0 else 1 - s if group == 1 else 0.02)
        rows.append((i, group, s, int(good), rng.choice(["train"] * 3 + ["validate", "test"])))
    monkeypatch.setattr(calibration, "RANGE", 900)
    report, curves = calibration.calibrate(spark.createDataFrame(rows, "id int, g int, s double, y int, part string"), ["g"], "s", "y", part="part")
    got, lines = {r.g: r for r in report.collect()}, defaultdict(dict)
    for r in curves.collect():
        lines[r.g][r.bin] = r.calibrated
    for g in range(3):
        own = [r for r in rows if r[1] == g]
        sums = defaultdict(lambda: [0, 0])
        for _, _, s, y, part in own:
            if part == "train":
                sums[round(s * 10_000)][0] += 1
                sums[round(s * 10_000)][1] += y
        points = [(b, *sums[b]) for b in sorted(sums)]
        curve = np.interp(np.arange(10_001), [p[0] for p in points], level(points))
        assert len(lines[g]) == 10_001 and np.allclose([lines[g][b] for b in range(10_001)], curve, atol=1e-12)
        at = lambda r: lines[g][round(r[2] * 10_000)]
        held = [(at(r), r[3]) for r in own if r[4] == "validate"]
        options = {t: sum(3 * (p >= t and not y) + (p < t and y) for p, y in held) for t in {p for p, _ in held} | {2.0}}
        least = min(options.values())
        best = max(t for t, c in options.items() if c == least)
        assert got[g].cost == least and (got[g].threshold or 2.0) == best
        test = [(at(r), r[3]) for r in own if r[4] == "test"]
        assert (got[g].n_test, got[g].awards, got[g].false_awards, got[g].false_omissions) == (len(test), sum(p >= best for p, _ in test), sum(p >= best and not y for p, y in test), sum(p < best and y for p, y in test))
        assert got[g].brier == pytest.approx(np.mean([(p - y) ** 2 for p, y in test]))
    assert got[2].threshold is None and got[2].awards == 0  # where hardly any is good, none is awarded


def test_proposed_exemplars_are_medoids(spark):
    rng = np.random.default_rng(3)
    rows = [(1, p, i, (rng.normal(size=6) + 3 * (i % 3 == 0)).tolist() if i % 50 else None, bool(rng.random() < (0.5 if p < 2 else 0.05))) for p in range(3) for i in range(p * 300, p * 300 + 300)]
    got = {r.point: r for r in corrections.proposals(spark.createDataFrame(rows, "question int, point int, answer int, vector array<double>, overridden boolean")).collect()}
    assert set(got) == {0, 1}
    normal = lambda p: np.array([(i * 7 + p * 13 + i * i * (p + 1)) % 11 - 5 for i in range(6)])
    for p, r in got.items():
        kinds = defaultdict(list)
        for _, q, a, v, o in rows:
            if q == p and o and v:
                kinds["".join("1" if np.dot(v, normal(k)) >= 0 else "0" for k in range(4))].append((a, np.array(v) / np.linalg.norm(v)))
        kind = max(kinds, key=lambda k: (len(kinds[k]), k))
        medoid = max(kinds[kind], key=lambda x: (round(sum(float(x[1] @ y) for _, y in kinds[kind]), 9), -x[0]))[0]
        assert (r.kind, r.members, r.exemplar) == (kind, len(kinds[kind]), medoid)


def test_line_numbers_of_one_split_and_of_many(spark, tmp_path):
    """Two files, blank lines, comments and both kinds of line ends: the same numbers however the files are cut."""
    for name, n in (("a.txt", 400), ("b.txt", 3)):
        (tmp_path / name).write_bytes(b"".join(f"line {i} {'x' * (i % 37)}".encode() + (b"\r\n" if i % 5 == 0 else b"\n") if i % 7 else b"// no\n" if i % 2 else b"\n" for i in range(n)))
    want = {(f, i + 1, f"line {i} {'x' * (i % 37)}") for f, n in (("a.txt", 400), ("b.txt", 3)) for i in range(n) if i % 7}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("128m", "500", "77"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        lines = golden.read_lines(spark, str(tmp_path))
        assert {(r.file.rpartition("/")[2], r.line, r.text) for r in lines.collect()} == want
    for k, v in before.items():
        spark.conf.set(k, v)


def test_batches_have_an_audit_row_each(spark):
    rows = spark.range(1203).select((F.col("id") % 2).alias("request"), "id")
    audit = sorted(tuple(r) for r in tenancy.batch_audit(tenancy.in_batches(rows, "request", "id"), "request", "id").select("request", "batch", "n", "first_id", "last_id").collect())
    assert audit == [(0, 0, 500, 0, 998), (0, 1, 102, 1000, 1202), (1, 0, 500, 1, 999), (1, 1, 101, 1001, 1201)]


def test_tenants_are_scoped_on_their_own_id(spark):
    """Every scoped table shows one tenant's rows only; ``tenants`` by its id."""
    for name, column in schemas.SCOPED.items():
        rows = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], f"{column} string, other string")
        assert [r[0] for r in tenancy.TenantScope("a").named(name, rows).collect()] == ["a"]
    assert schemas.SCOPED["tenants"] == "id" and set(schemas.SCOPED.values()) == {"id", "tenant_id"}


@pytest.mark.parametrize("given,strict,status", [("good", True, 0), ("bad", True, 1), ("bad", False, 0), ("none", True, 1), ("malformed", False, 2)])
def test_exit_codes(spark, tmp_path, monkeypatch, given, strict, status):
    lines = [] if given == "none" else [{"booklet_id": "b", "page_no": 1, "line_index": i, "text": f"hold and wait {i}"} for i in range(3)]
    (tmp_path / "transcriptions.jsonl").write_text("\n".join(map(json.dumps, lines)) if given != "malformed" else "{")
    (tmp_path / "marks.jsonl").write_text("")
    (tmp_path / "p.json").write_text(json.dumps({"transcriptions": {f"b:1:{i}": f"hold and wait {i}" if given == "good" else "nothing alike" for i in range(3)}, "marks": {}}))
    monkeypatch.setattr("assayer.session.session", lambda *a, **k: spark)
    assert golden.main(["--golden", str(tmp_path), "--predictions", str(tmp_path / "p.json"), *(["--strict"] if strict else [])]) == status


def test_a_database_table_in_ranges(spark, tmp_path):
    """Derby comes with Spark: rows written to it come back typed, in ranges of ids."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    log = spark.createDataFrame([(i, "t", f"a{i}") for i in range(50)], "id long, tenant_id string, action string")
    for name in schemas.TABLES["audit_log"].fieldNames():
        if name not in log.columns:
            log = log.withColumn(name, F.lit(None).cast(schemas.TABLES["audit_log"][name].dataType))
    log.select(*schemas.TABLES["audit_log"].fieldNames()).write.jdbc(url, "audit_log", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    back = tables.read_jdbc(spark, "audit_log", url, "id", (0, 50), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 4 and sorted((r["id"], r["action"]) for r in back.collect()) == [(i, f"a{i}") for i in range(50)]


@pytest.mark.parametrize("form", exports.FORMATS)
def test_exports_come_back_and_are_audited(spark, tmp_path, form):
    rows = [(i, f'name "{i}",\nline', i / 2 if i % 3 else None, i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "script int, name string, total double, finalised boolean")
    columns, path = {"STUDENT": "name", "MARK": "total"}, str(tmp_path / form)
    (audited,) = exports.export(df, path, columns, "a.m", form, F.col("finalised")).collect()
    back = spark.read.format(form).options(**({"header": "true", "escape": '"', "multiLine": "true"} if form == "csv" else {})).load(path)
    assert set(back.columns) <= {"STUDENT", "MARK"} and {(r.STUDENT, None if r.MARK is None else float(r.MARK)) for r in back.collect()} == {(n, t) for _, n, t, f in rows if f}
    assert (audited.action, audited.actor_id, audited.entity_id) == ("results.export", "a.m", path) and json.loads(audited.after) == {"columns": ["STUDENT", "MARK"], "format": form, "rows": 10}
    assert audit.actor_violations(spark.createDataFrame([audited])).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        exports.export(df, path, columns, "a.m", form)
    assert [tuple(r) for r in exports.preview(df, columns, ["script"], F.col("script") > 9).collect()] == [(n, t) for i, n, t, _ in rows if 9 < i < 15]


def test_exports_refuse_unknown_formats_and_nobody(spark, tmp_path):
    for actor, form in (("a", "xls"), ("", "csv")):
        with pytest.raises(ValueError):
            exports.export(spark.range(1), str(tmp_path / "x"), {"id": "id"}, actor, form)


def test_calls_pay_once_they_succeed(spark):
    rows = [("k", 1, False), ("k", 2, True), ("k", 3, True), ("j", 4, False), ("l", 5, True)]
    found = recognition.read_through(spark.createDataFrame(rows, "key string, nth int, good boolean").withColumn("price", F.lit(2.0)), "key", "nth", "price", F.col("good"))
    assert {r.nth: (r.cost, r.from_cache) for r in found.collect()} == {1: (0.0, False), 2: (2.0, False), 3: (0.0, True), 4: (0.0, False), 5: (2.0, False)}


def test_reasons_are_counted(spark):
    df = spark.createDataFrame([(["R_DPI", "W_SKEW"],), (["R_DPI"],), ([],)], "why array<string>")
    assert {r.reason: (r.n, r.pages) for r in capture.reason_counts(df, F.col("why")).collect()} == {"R_DPI": (2, 3), "W_SKEW": (1, 3)}
