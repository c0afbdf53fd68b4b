from __future__ import annotations

import json
import random
import statistics
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import stats, text
from assayer.operators import evaluation
from assayer.sources import golden


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


PAIRS = [("osmotic drift", "osmofic drlft"), ("", ""), ("", "some ink"), ("Larva", "larva"), ("then, it melts", "then it melts"), ("q r s", "q  r\ts"), ("fête", "fe\u0302te"), ("ﬂow", "flow"), ("sediment", "unsettled"), ("mud " * 40, "dum " * 40)]


def test_character_errors(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, a string, b string")
    a, b = text.normalise(F.col("a")), text.normalise(F.col("b"))
    got = df.select("i", text.char_errors(a, b).alias("e"), F.length(a).alias("n"), text.rate(text.char_errors(a, b), F.length(a)).alias("r")).orderBy("i").collect()
    norm = lambda s: " ".join(unicodedata.normalize("NFKC", s).lower().split())
    want = [(distance(norm(x), norm(y)), len(norm(x))) for x, y in PAIRS]
    assert [(r.e, r.n) for r in got] == want and want[6][0] == want[7][0] == 0
    assert got[1].r == 0.0 and got[2].r == 1.0
    strict = df.filter("i = 3").select(text.char_errors(text.normalise(F.col("a"), lower=False), text.normalise(F.col("b"), lower=False)).alias("e")).first()
    assert strict.e == 1


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab é -.", max_size=12), st.text("ab é -.", max_size=12)), min_size=1, max_size=30))
def test_errors_against_a_plain_model(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    plain = df.select("i", text.normalise(F.col("a")).alias("a"), text.normalise(F.col("b")).alias("b"))
    plain = plain.select("i", text.char_errors(F.col("a"), F.col("b")).alias("c"), text.tokens(F.col("a")).alias("a"), text.tokens(F.col("b")).alias("b"))
    got = plain.select("i", "c", text.word_errors(F.col("a"), F.col("b")).alias("w")).orderBy("i").collect()
    norm = lambda s: " ".join(unicodedata.normalize("NFKC", s).lower().split())
    assert [(r.c, r.w) for r in got] == [(distance(norm(x), norm(y)), distance(norm(x).split(), norm(y).split())) for x, y in pairs]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abcd", max_size=40), st.integers(0, 3))
def test_edits_of_any_sequences(a, b, copies):
    """Single letters, and words of which there are more than single characters could stand for."""
    a, b = a + "xy" * copies, b + "xy" * copies
    assert text.edits(a, b) == text.edits(b, a) == distance(a, b)
    assert text.edits([f"w{c}" for c in a], [f"w{c}" for c in b]) == distance(a, b)


def test_edits_of_long_and_many_worded_texts():
    long = [str(i) for i in range(40_000)]
    assert text.edits(long, [*long[:50], "x", *long[51:39_990], "y", *long[39_991:]]) == 2 and text.edits("a" * 3000, "b" * 2000) == 3000 and text.edits("", "") == 0


def kappa(spark, a, b):
    return spark.createDataFrame(list(zip(map(float, a), map(float, b))), "a double, b double").agg(stats.kappa(F.col("a"), F.col("b")).alias("k")).first().k


def plain_kappa(a, b):
    """One less the observed over the expected squared differences, all pairs of ratings counted."""
    seen = sum((x - y) ** 2 for x, y in zip(a, b)) / len(a)
    chance = sum((x - y) ** 2 for x in a for y in b) / len(a) ** 2
    return 1 - seen / chance if chance else float(not seen)


def test_kappa(spark):
    """Against all pairs of ratings, for markers who agree, hardly agree, turn the scale round, or know one mark only."""
    rng = random.Random(12)
    one = [rng.randint(0, 12) for _ in range(40)]
    for other in (one, [x + rng.choice([-1, 0, 0, 1]) for x in one], [12 - x for x in one], [rng.randint(0, 12) for _ in one], rng.sample(one, 40), [6] * 40):
        assert kappa(spark, one, other) == pytest.approx(plain_kappa(one, other))
    for n, other in ((5, 7), (7, 7)):
        assert kappa(spark, [n] * 3, [other] * 3) == plain_kappa([n] * 3, [other] * 3)


@pytest.mark.parametrize("seed", range(8))
def test_line_confidence(spark, seed):
    rng = random.Random(seed)
    words = [round(rng.betavariate(8, 1 + seed), 3) for _ in range(seed * (seed - 1) // 2)] + [0.05] * (seed == 5)
    got = spark.createDataFrame([(w,) for w in words], "w double").agg(stats.line_confidence(F.col("w")).alias("c")).first().c
    want = 0.0 if not words else max(0.0, min(1.0, statistics.fmean(words), 1 - 2 * (statistics.stdev(words) if len(words) > 1 else 0)))
    assert got == pytest.approx(want)


def test_golden_set_end_to_end(spark, tmp_path):
    lines = [{"booklet_id": "b", "page_no": 1, "line_index": i, "text": t, "illegible": i == 3} for i, t in enumerate(["glacial erosion", "ice and snow", "slow moraines", "???"])]
    (tmp_path / "transcriptions.jsonl").write_text("// first\n\n" + "\n".join(map(json.dumps, lines)))
    marks = [{"booklet_id": "b", "question_number": str(i), "max_marks": 10, "marker_a": i, "marker_b": i + 1, "adjudicated": None} for i in range(6)]
    (tmp_path / "marks.jsonl").write_text("\n".join(map(json.dumps, marks)))
    (tmp_path / "p.json").write_text(json.dumps({"transcriptions": {"b:1:0": "glacial erosiom", "b:1:1": "ice and snow"}, "marks": {f"b:{i}": i for i in range(5)} | {"z:1": 3}}))
    l, m = golden.load(spark, str(tmp_path))
    pl, pm = golden.load_predictions(spark, str(tmp_path / "p.json"))
    t = evaluation.score_transcriptions(l, pl, ["booklet_id", "page_no", "line_index"]).first()
    assert (t.measured, t.skipped, t.missing, t.char_errors, t.chars, t.word_errors, t.words) == (2, 1, 1, 1, 27, 1, 5)
    assert t.tier1 == "PASS" and t.wer > t.cer
    s = evaluation.score_marks(m, pm, ["booklet_id", "question_number"]).first()
    assert s.matched == 5 and s.scale == 10 and s.verdict == "PASS"
    out, status = golden.report(l, m, pl, pm)
    assert status == 0 and "1 booklets" in out


@pytest.mark.parametrize("body", ['{"booklet_id": "b"', '{"booklet_id": "b", "page_no": 1, "line_index": 0}', '{"booklet_id": "b", "page_no": "x", "line_index": 0, "text": "t"}'])
def test_malformed_lines_are_named(spark, tmp_path, body):
    (tmp_path / "transcriptions.jsonl").write_text("// c\n" + body)
    with pytest.raises(golden.MalformedGoldenSet, match=r"transcriptions\.jsonl:2"):
        golden.load(spark, str(tmp_path))


def test_duplicates_and_missing_files(spark, tmp_path):
    row = '{"booklet_id": "b", "page_no": 1, "line_index": 0, "text": "t"}'
    (tmp_path / "transcriptions.jsonl").write_text(f"{row}\n{row}")
    with pytest.raises(golden.MalformedGoldenSet, match="twice"):
        golden.load(spark, str(tmp_path))
    assert golden.read_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
