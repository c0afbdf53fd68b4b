from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import pixels
from assayer.operators import alignment, audit, booklet, capture, recognition, reconcile, results, rubric, rules, states, tenancy
from assayer.streaming import windows


def log(spark, n=4):
    rows = [("t1", i, f"act{i}", None if i else "u") for i in range(n)]
    df = spark.createDataFrame(rows, "tenant_id string, id long, action string, actor_id string")
    return audit.append(df.withColumn("payload", audit.canonical(df.columns)))


def test_canonical_text_and_chain(spark):
    got = log(spark).orderBy("id").collect()
    assert got[0].payload == '{"action":"act0","actor_id":"u","after":null,"at":null,"before":null,"entity_id":null,"entity_type":null,"reason":null,"tenant_id":"t1"}'
    prev = audit.GENESIS
    for r in got:
        assert r.prev_hash == prev
        prev = hashlib.sha256(f"{prev}\x1f{r.payload}".encode()).hexdigest()
        assert r.row_hash == prev


@pytest.mark.parametrize("change,position", [("none", None), ("edit", 1), ("delete", 1), ("swap", 1), ("rehash", 2)])
def test_tampering_is_placed(spark, change, position):
    rows = [r.asDict() for r in log(spark).orderBy("id").collect()]
    if change == "edit":
        rows[1]["payload"] += " "
    elif change == "delete":
        del rows[1]
    elif change == "swap":
        rows[1]["id"], rows[2]["id"] = 2, 1
    elif change == "rehash":
        rows[1]["payload"] += " "
        rows[1]["row_hash"] = hashlib.sha256(f"{rows[1]['prev_hash']}\x1f{rows[1]['payload']}".encode()).hexdigest()
    for chunk in (100_000, 3, 2, 1):
        got = audit.verify(spark.createDataFrame(rows), F.col("payload"), chunk=chunk).first()
        assert (got.first_break, got.n_rows) == (position, len(rows))


def test_states(spark):
    pairs = list(itertools.product(states.MOVES, states.MOVES))
    bad = states.illegal(spark.createDataFrame(pairs, "src string, dst string"))
    assert len(pairs) == 256 and bad.count() == 224
    assert bad.filter("src = 'FINALISED'").select("allowed").distinct().first().allowed == "none"
    assert states.reachable(spark).count() == 16
    assert states.reachable(spark, without=("FAILED",)).filter("state = 'FINALISED'").count() == 1


def test_meter_and_breaker_against_models(spark):
    random.seed(3)
    calls = [(t, i, random.choice([1.0, 3.0, 9.0]), 12.0, float(i * random.randint(1, 3)), random.random() < 0.6) for t in range(3) for i in range(60)]
    df = spark.createDataFrame(calls, "tenant long, seq long, price double, cap double, at double, failed boolean")
    got = {(r.tenant, r.seq): r for r in recognition.cost_meter(df).collect()}
    seen = {(r.provider, r.seq): r for r in recognition.circuit_breaker(df.withColumnRenamed("tenant", "provider"), 3, 10.0).collect()}
    for t in range(3):
        spent, failures, opened = 0.0, 0, None
        for _, i, price, cap, at, failed in [c for c in calls if c[0] == t]:
            ok = spent + price <= cap
            spent += price * ok
            assert (got[t, i].admitted, got[t, i].spent) == (ok, spent)
            blocked = opened is not None and at - opened < 10
            if not blocked:
                failures = failures + 1 if failed else 0
                opened = at if failed and failures >= 3 else None
            assert (seen[t, i].blocked, seen[t, i].failures, seen[t, i].open) == (blocked, failures, opened is not None)


def test_cache_key(spark):
    row = spark.range(1).select(recognition.cache_key(F.lit(b"img"), F.lit("v"), F.lit("en"), F.array(F.lit("b"), F.lit("a"))).alias("k")).first()
    assert row.k == hashlib.sha256(b"img\x1fv\x1fen\x1fa\x1eb").hexdigest()


def test_gate_bands(spark):
    rows = [(50.0, 4), (119.9, 4), (120.0, 4), (149.0, 4), (200.0, 4), (200.0, 3), (None, 4)]
    df = spark.createDataFrame(rows, "dpi double, m int").coalesce(1)
    reasons = capture.gate_reasons(F.col("dpi"), F.lit(200.0), F.lit(128.0), F.lit(0.0), F.lit(1.0), F.lit(0.95), F.col("m"))
    got = [r.v for r in df.select(capture.gate_verdict(reasons).alias("v")).collect()]
    assert got == ["REJECT", "REJECT", "WARN", "WARN", "ACCEPT", "REJECT", "REJECT"]


@pytest.mark.parametrize("raw,valid", [("", False), ("MA1:short:short:1:2", False), (f"MA1:{'a' * 32}:{'b' * 32}:1:4", True), (f"  MA1:{'a' * 32}:{'b' * 32}:4:4 ", True), (f"MA1:{'a' * 32}:{'b' * 32}:5:4", False), (f"MA1:{'a' * 32}:{'b' * 32}:0:4", False), (f"MA0:{'a' * 32}:{'b' * 32}:1:4", False), (f"MA1:{'A' * 32}:{'b' * 32}:1:4", False), (f"MA1:{'a' * 32}:{'b' * 32}:1:4:9", False), (f"MA1:{'a' * 32}:{'b' * 32}:x:4", False), (f"MA1:{'a' * 32}:{'b' * 32}:{'9' * 30}:4", False)])
def test_payload(spark, raw, valid):
    got = spark.createDataFrame([(raw,)], "raw string").select(booklet.decode_payload(F.col("raw")).alias("p")).first().p
    assert got.valid == valid and (got.page_total == 4) == valid


def test_marks_text(spark):
    got = [r.s for r in spark.sql("SELECT explode(array(6, 10, 100, 2.5, 5.0, 0.5)) m").select(booklet.format_marks(F.col("m").cast("decimal(10,2)")).alias("s")).collect()]
    assert got == ["6", "10", "100", "2.5", "5", "0.5"]


def test_tenancy(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, id int")
    assert tenancy.TenantScope("a").table(df).count() == 1
    assert tenancy.TenantScope(None).table(df).count() == 0
    assert tenancy.TenantScope("a").violations(df).count() == 2
    for key in (2, 9):
        with pytest.raises(tenancy.NotFound):
            tenancy.TenantScope("a").require(df, "id", key)


def test_pixels(spark):
    flat, noisy = bytes([200] * 64), bytes([0, 255] * 32)
    df = spark.createDataFrame([(0, bytearray(flat)), (1, bytearray(noisy)), (2, bytearray(b"x"))], "i int, image binary")
    got = df.select("i", pixels.measure(F.col("image"), F.lit(8), F.lit(8)).alias("m")).orderBy("i").collect()
    assert got[0].m.sharpness == 0 and got[0].m.brightness == 200 and got[1].m.clipped_fraction == 0.5 and got[2].m.sharpness is None
    assert np.allclose(pixels.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[0, 0], [2, 0], [2, 2], [0, 2]])), np.diag([2, 2, 1]))


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 5), (5, 5), (4, 6)):
        cost = rng.integers(0, 20, (n, m)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        at = alignment.solve(cost)
        assert len(set(at)) == n and sum(cost[i, j] for i, j in enumerate(at)) == best


def test_rules(spark):
    cols = "script int, question int, code string, max_marks double, verdict string, confidence double, group_id int, group_max int, requires string, negative double"
    rows = [(1, 1, "a", 2.0, "ENTAILED", 0.9, None, None, None, 0.0), (1, 1, "b", 2.0, "ENTAILED", 0.5, None, None, None, 0.0), (1, 1, "c", 1.5, "PARTIAL", 0.9, None, None, "b", 0.0), (1, 1, "d", 1.0, "ENTAILED", 0.85, 7, 1, None, 0.0), (1, 1, "e", 1.0, "ENTAILED", 0.95, 7, 1, None, 0.0), (1, 1, "f", 1.0, "ENTAILED", 0.95, None, None, "c", 0.0)]
    points = rules.group_caps(rules.dependencies(rules.awards(spark.createDataFrame(rows, cols))))
    got = {r.code: (r.rule, r.marks) for r in points.collect()}
    assert got == {"a": ("R-ENTAIL-FULL", 2.0), "b": ("R-ENTAIL-WITHHELD", 0.0), "c": ("R-DEPENDENCY", 0.0), "d": ("R-GROUP-CAP", 0.0), "e": ("R-ENTAIL-FULL", 1.0), "f": ("R-DEPENDENCY", 0.0)}
    assert rules.question_scores(points).first().marks == 3.0


def test_rubric(spark):
    long = "It is " + "very " * 29
    rows = [
        ("q", "a", "The lock is held and the queue increases", 1.0, ["x", "y"], None, None, "b", [1.0, 0.0]), ("q", "b", "The lock is held and counted", 1.0, ["x", "y"], None, None, "a", [2.0, 0.1]), ("q", "c", "A mutex", 1.0, ["x"], 1, 2, "z", None),
        ("q", "d", "Which lock is held", 1.0, ["x", "y"], 2, 1, None, [0.0, 1.0]), ("q", "e", "The lock is never held", 5.0, ["x", "y"], None, None, "e", [0.0, 0.0]), ("q", "f", long, 1.0, None, None, None, None, [1.0, 2.0]), ("fine", "a", "The lock is held", 1.0, ["x", "y"], None, None, None, [1.0, 0.0]),
        ("fine", "b", "The lock and the queue are kept", 1.0, ["x", "y"], None, None, "a", [0.0, 1.0]), ("fine", "c", "It is kept", 1.0, ["x", "y"], None, None, "b", None),
    ]
    points = spark.createDataFrame(rows, "question string, code string, statement string, marks double, exemplars array<string>, group_id int, group_max int, requires string, vector array<double>")
    questions = spark.createDataFrame([("q", 11.0), ("empty", 16.0), ("fine", 3.0)], "question string, max_marks double")
    found = rubric.lint(points, questions)
    want = {("CONJOINED", "q", "a"), ("REQUIRES", "q", "a"), ("REQUIRES", "q", "b"), ("REQUIRES", "q", "c"), ("REQUIRES", "q", "e"), ("ALIKE", "q", "a b"), ("NOT_DECLARATIVE", "q", "c"), ("NOT_DECLARATIVE", "q", "d"), ("FEW_EXEMPLARS", "q", "c"), ("FEW_EXEMPLARS", "q", "f"), ("GROUP_CAP", "q", "1"), ("NEGATION", "q", "e"), ("HEAVY_POINT", "q", "e"), ("TOO_LONG", "q", "f"), ("MARKS_SUM", "q", None), ("MARKS_SUM", "empty", None), ("COARSE", "empty", None)}
    assert {(r.rule, r.question, r.code) for r in found.collect()} == want
    assert [r.question for r in rubric.freezable(found, questions).collect()] == ["fine"]


def test_requirements_in_cycles_against_reachability():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (4, 5), (8, 9), (12, 14), (30, 33), (30, 60)):
        for _ in range(40):
            pairs = [tuple(p) for p in rng.integers(0, n, (m, 2)).tolist()]
            reach = np.zeros((n, n), bool)
            reach[tuple(zip(*pairs))] = True
            for k in range(n):
                reach |= reach[:, [k]] & reach[[k], :]
            assert sorted(rubric.on_cycles(pairs)) == np.nonzero(reach.diagonal())[0].tolist()


def test_a_question_of_many_requirements(spark):
    """A ring of 4,000 points, a chain of 4,000 that leads into it, one that leads out of it, and one of no question that requires itself."""
    n = 4000
    rows = [("q", i, (i + 1) % n) for i in range(n)] + [("q", n + i, n + i + 1 if i < n - 1 else 0) for i in range(n)] + [("q", 5, 2 * n)] + [("q", 2 * n + i, 2 * n + i + 1) for i in range(n)] + [(None, 1, 1)]
    got = rubric.cycles(spark.createDataFrame(rows, "question string, code long, requires long")).collect()
    assert sorted((r.question or "", r.code) for r in got) == [("", 1), *(("q", i) for i in range(n))]


def test_alike_points_in_blocks_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5))
    rows = [(i % 2, i, (centres[i % 6] + rng.normal(scale=0.3, size=5)).tolist()) for i in range(120)]
    monkeypatch.setattr(rubric, "BLOCK_ROWS", 7)
    got = {(r.a, r.b) for r in rubric.alike(spark.createDataFrame(rows, "question int, code int, vector array<double>")).collect()}
    cosine = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    assert got == {(a, b) for (q, a, x), (r, b, y) in itertools.combinations(rows, 2) if q == r and cosine(x, y) > 0.9} and got


def test_alike_points_of_one_question_are_found_in_many_tasks(spark, monkeypatch):
    """All points of a question alike, the cosine of two of them at the limit and one code held twice."""
    monkeypatch.setattr(rubric, "BLOCK_ROWS", 16)
    monkeypatch.setattr(rubric, "MATRIX_ROWS", 4, raising=False)
    rows = [("q", f"c{i}", [3.0 * (i + 1), 4.0 * (i + 1)]) for i in range(150)] + [("q", "c7", [3.0, 4.0]), ("r", "a", [1.0, 0.0]), ("r", "b", [0.9, 0.19**0.5 * (1 + 1e-9)]), ("r", "c", [0.9, 0.19**0.5 * (1 - 1e-9)]), ("r", "d", [None, 1.0]), ("r", "e", [1.0]), ("r", "f", []), (None, "g", [1.0]), (None, "h", [1.0])]
    got = rubric.alike(spark.createDataFrame(rows, "question string, code string, vector array<double>")).withColumn("task", F.spark_partition_id()).collect()
    names = sorted(f"c{i}" for i in range(150))
    assert sorted((r.question, r.a, r.b) for r in got) == sorted([("q", *p) for p in itertools.combinations(names, 2)] + [("q", "c7", "c7"), ("r", "a", "c"), ("r", "b", "c")])
    assert len({r.task for r in got}) > 8


def test_rules_share_their_passes_over_the_points(spark, tmp_path):
    row = ("q", "a", "The lock is held", 1.0, ["x", "y"], 1, 1, "a", [1.0, 0.0])
    spark.createDataFrame([row], "question string, code string, statement string, marks double, exemplars array<string>, group_id int, group_max int, requires string, vector array<double>").write.parquet(f"{tmp_path}/points")
    found = rubric.lint(spark.read.parquet(f"{tmp_path}/points"), spark.createDataFrame([("q", 1.0)], "question string, max_marks double"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 11
    assert {(r.rule, r.code) for r in found.collect()} == {("REQUIRES", "a"), ("HEAVY_POINT", "a")}


def test_answer_types(spark):
    rows = [("g = 9.81 m/s^2", "MATCH"), ("Q2: 9.8 m/s²", "MATCH"), ("9.81 m / s^2", "UNIT"), ("981 cm/s^2", "UNIT"), ("9.81", "UNIT"), ("0.981e1 m/s^2.", "MATCH"), ("-9.81 m/s^2", "VALUE"), ("1.2e3 m/s^2", "VALUE"), ("7 m/s^2, no: 9.81 m/s^2 (2 of 3)", "MATCH"), ("see Q2", "ABSENT"), ("", "ABSENT"), (None, "ABSENT")]
    df = spark.createDataFrame(rows, "answer string, want string")
    got = df.select("answer", "want", rules.numeric_match(F.col("answer"), F.lit(9.81), F.lit("m/s^2"), F.lit(0.02))["rule"].alias("rule")).collect()
    assert [(r.answer, r.rule) for r in got] == [(r.answer, f"R-NUMERIC-{r.want}") for r in got]
    rows = [("bat", ["cat"], "NONE"), (" Dead  LOCK", ["dead lock"], "EXACT"), ("deadlook", ["deadlock"], "NEAR"), ("deadlog", ["deadlock"], "NONE"), ("affact it", ["affect it", "effect it"], "NEAR"), ("offect it", ["affect it", "effect it"], "AMBIGUOUS"), ("effect it", ["affect it", "effect it"], "EXACT"), ("mutual exclusoin", ["mutual exclusion"], "NEAR")]
    df = spark.createDataFrame(rows, "answer string, accepted array<string>, want string")
    got = df.select("answer", "want", rules.short_match(F.col("answer"), F.col("accepted"))["rule"].alias("rule")).collect()
    assert [(r.answer, r.rule) for r in got] == [(r.answer, f"R-SHORT-{r.want}") for r in got]


def test_routes(spark):
    rows = [(0.9, 0.9, None, None, None, None, None, 0.85), (0.84, 0.9, False, False, False, False, False, 0.85), (0.84, 0.9, False, False, False, False, False, 0.1), (0.79, 0.9, False, False, False, False, False, 0.1), (0.69, 0.9, None, None, None, None, None, 0.1), (0.9, 0.69, None, None, None, None, None, 0.85), (None, 0.9, None, None, None, None, None, 0.85)]
    rows += [(0.9, 0.9, *(i == k for i in range(5)), 0.85) for k in range(5)]
    df = spark.createDataFrame(rows, "overall double, ocr double, unverifiable boolean, degraded boolean, unmatched boolean, withheld boolean, contradicted boolean, auto double")
    got = [r.r for r in df.select(rules.route(*map(F.col, df.columns)).alias("r")).collect()]
    assert got == ["AUTO_SUGGEST", "MANUAL_REVIEW", "AUTO_SUGGEST", "MANUAL_REVIEW", "MANUAL_ONLY", "MANUAL_ONLY", "MANUAL_ONLY", "MANUAL_ONLY", "MANUAL_ONLY", "MANUAL_ONLY", "MANUAL_REVIEW", "MANUAL_REVIEW"]


def test_trace_of_every_phase(spark):
    cols = "script int, question int, code string, max_marks double, verdict string, confidence double, group_id string, group_max int, requires string, negative double, question_max double"
    rows = [(1, 1, "a", 2.0, "ENTAILED", 0.91, None, None, None, 0.0, 4.0), (1, 1, "b", 1.0, "PARTIAL", 0.74, None, None, "a", 0.0, 4.0), (1, 1, "c", 1.0, "ENTAILED", 0.6, None, None, None, 0.0, 4.0), (1, 1, "d", 1.0, "ENTAILED", 0.9, None, None, "c", 0.0, 4.0)]
    rows += [(1, 1, f"g{i}", 1.0, "ENTAILED", 0.8 + i / 100, "G1", 2, None, 0.0, 4.0) for i in range(3)] + [(2, 1, "n", 1.0, "CONTRADICTED", 0.9, None, None, None, 0.75, 4.0)]
    points = rules.group_caps(rules.dependencies(rules.awards(spark.createDataFrame(rows, cols), penalise=True)))
    found = {r.script: r for r in rules.decision_trace(points).collect()}
    steps = [(t.step, t.phase, t.rule, t.point, t.grp, t.awarded, t.cap, t.dropped, t.before, t.after) for t in found[1].trace]
    first = [("a", "R-ENTAIL-FULL", 2.0), ("b", "R-PARTIAL-HALF", 0.5), ("c", "R-ENTAIL-WITHHELD", 0.0), ("d", "R-ENTAIL-FULL", 1.0), ("g0", "R-ENTAIL-FULL", 1.0), ("g1", "R-ENTAIL-FULL", 1.0), ("g2", "R-ENTAIL-FULL", 1.0)]
    want = [(i + 1, 1, rule, p, None, None, None, None, None, after) for i, (p, rule, after) in enumerate(first)]
    want += [(8, 2, "R-DEPENDENCY", "d", None, None, None, None, 1.0, 0.0), (9, 3, "R-GROUP-CAP", None, "G1", 3, 2.0, ["g0"], None, None), (10, 4, "R-QUESTION-CAP", None, None, None, 4.0, None, 4.5, 4.0), (11, 4, "R-ROUNDING", None, None, None, None, None, 4.0, 4.0)]
    assert steps == want
    assert found[1].caps == ["GROUP_G1_MAX_2_AWARDS"] and [tuple(w) for w in found[1].withheld] == [("c", "CONFIDENCE_BELOW_FLOOR", 1.0)]
    assert [(t.rule, t.before, t.after) for t in found[2].trace[1:]] == [("R-QUESTION-CAP", -0.75, -0.75), ("R-NEGATIVE-FLOOR", -0.75, 0.0), ("R-ROUNDING", 0.0, 0.0)]
    sure = {r.script: round(r.confidence, 6) for r in rules.question_scores(points).collect()}
    assert sure == {1: round(1 - 1 / 7 - 0.05, 6), 2: 0.9}


def test_near_misses_against_all_pairs(spark):
    random.seed(1)
    words = {"".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in range(150)}
    tokens, terms = sorted(words)[::2], sorted(words)[1::2]
    from test_scoring import distance

    got = {(r.token, r.term) for r in reconcile.near_misses(spark.createDataFrame([(1, t) for t in tokens], "line int, token string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(a, b) for a in tokens for b in terms if 1 <= distance(a, b) <= 2}


def test_reconcile_and_sentences(spark):
    rows = [("Same text", "same  text"), ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyx"), ("abcdefghij", "abcdefgxyz"), ("abc", "xyz"), ("abc", "UNREADABLE"), ("abc", None)]
    got = [r.r.source for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(reconcile.reconcile(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == ["ARBITRATED", "TIER2", "BOTH", "UNRESOLVED", "UNRESOLVED", "UNRESOLVED"]
    text = "A dead-\nlock needs four things. No.\nMutual exclusion is the first of them\n- hold and wait is one"
    got = [r.sentence for r in reconcile.sentences(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string"), "k").orderBy("nth").collect()]
    assert got == ["A deadlock needs four things.", "No. Mutual exclusion is the first of them", "- hold and wait is one"]


def test_versions_and_pages(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 9)], "id int, superseded_by int")
    assert sorted(r.id for r in results.latest_versions(df, "id", "superseded_by").collect()) == [3, 4]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = windows.tumbling(spark.readStream.schema(schema).parquet(src), "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    want = windows.tumbling(spark.read.parquet(src), "ts", ["event_type"])
    assert sorted(spark.table("tumbled").collect()) == sorted(want.collect())
