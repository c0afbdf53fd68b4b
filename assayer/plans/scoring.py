"""Scoring, agreement and confidence on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import stats, text
from assayer.operators import evaluation
from assayer.session import small_batches, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as reference lines, and a reading of them with some letters mistaken."""
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("ref"))
    rows = rows.withColumn("hyp", F.translate("ref", "mnrv", "nmnu"))
    return rows.select("conv_id", "turn", "role", *(text.normalise(F.col(c)).alias(c) for c in ("ref", "hyp")))


#: DuckDB's distance counts bytes, so a row's characters become single bytes; NFKC changes nothing in these tables.
_TURNS = r"""turns AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS ref, trim(regexp_replace(lower(translate(text, 'mnrv', 'nmnu')), '\s+', ' ', 'g')) AS hyp FROM conversations)"""
_CODED = """coded AS (SELECT *, levenshtein(array_to_string(list_transform(string_split(ref, ''), lambda c: chr((32 + list_position(cs, c))::INTEGER)), ''), array_to_string(list_transform(string_split(hyp, ''), lambda c: chr((32 + list_position(cs, c))::INTEGER)), '')) AS e
  FROM (SELECT *, list_distinct(string_split(ref || hyp, '')) AS cs FROM turns))"""
_RATE = "CASE WHEN {l} = 0 THEN CASE WHEN {e} = 0 THEN 0.0 ELSE 1.0 END ELSE {e} / {l}::DOUBLE END"


def cer_by_role(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("role", text.char_errors(F.col("ref"), F.col("hyp")).alias("e"), F.length("ref").alias("l"))
    return _shown(evaluation.pooled(rows, ["role"], "e", "l"))


def _shown(rates):
    """Rounded for the comparison with SQL only."""
    return rates.withColumns({c: F.round(c, 6) for c in ("rate", "accuracy")})


def wer_by_role(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("role", text.tokens(F.col("ref")).alias("r"), text.tokens(F.col("hyp")).alias("h"))
    rows = rows.select("role", text.word_errors(F.col("r"), F.col("h")).alias("e"), F.size("r").alias("l"))
    return _shown(evaluation.pooled(rows, ["role"], "e", "l"))


def word_mismatches(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", text.tokens(F.col("ref")).alias("r"), text.tokens(F.col("hyp")).alias("h"))
    pairs = rows.select("conv_id", "turn", F.explode(F.arrays_zip("r", "h")).alias("p"))
    return pairs.groupBy("conv_id", "turn").agg(F.count_if(F.col("p.r") != F.col("p.h")).alias("wrong"), F.count("*").alias("words"))


def qwk_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.agg(F.count("*").alias("n"), F.round(stats.kappa(F.col("quality").cast("double"), F.col("toxic").cast("double")), 6).alias("kappa"))


_KAPPA = "CASE WHEN {x} = 0 THEN CASE WHEN sum((i-j)*(i-j)) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sum((i-j)*(i-j)) / {x} END".format(x="(sum(i*i) + sum(j*j) - 2 * sum(i) * sum(j) / count(*))")


def _raters(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    at = lambda c, lo, hi, step: stats.bucket(F.col(c), F.lit(lo), F.lit(hi), step)
    return lines.select("l_returnflag", "l_linestatus", at("l_quantity", 0.0, 50.0, 5.0).alias("i"), at("l_discount", 0.0, 0.1, 0.01).alias("j"))


_RATERS = "raters AS (SELECT l_returnflag, l_linestatus, least(greatest(round_even(l_quantity / 5.0, 0), 0.0), 10.0) AS i, least(greatest(round_even(l_discount / 0.01::DOUBLE, 0), 0.0), 10.0) AS j FROM lineitem)"


def qwk_by_flag(spark, sf_dir):
    return _raters(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(stats.kappa(F.col("i"), F.col("j")), 6).alias("kappa"))


def agreement_stats(spark, sf_dir):
    return evaluation.agreement(_raters(spark, sf_dir), ["l_returnflag", "l_linestatus"], "i", "j")


def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_raters(spark, sf_dir), "i", "j")


def _scored(spark, sf_dir):
    """Whole turns as a golden set, some illegible, and readings of most of them."""
    small_batches(spark)
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select("conv_id", "turn", "text", (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)) == 0).alias("illegible"))
    read = turns.filter(F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(5)) != 0).select("conv_id", "turn", F.translate("text", "mv", "nu").alias("text"))
    return evaluation.score_transcriptions(lines, read, ["conv_id", "turn"])


def score_lines(spark, sf_dir):
    return _scored(spark, sf_dir).select("measured", "skipped", "missing", "char_errors", "chars", F.round("cer", 6).alias("cer"), "tier1", "tier2")


def score_words(spark, sf_dir):
    return _scored(spark, sf_dir).select("measured", "word_errors", "words", "wer")


def legible_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("illegible", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)) == 0)
    return evaluation.legible(turns).select(evaluation.line_key(F.col("conv_id"), F.lit(1), F.col("turn")).alias("key"), evaluation.mark_key(F.col("conv_id"), F.col("role")).alias("mark"))


def _marks(spark, sf_dir):
    """Two markers' marks of an order's price, adjudicated where they differ much; the system is a third reading."""
    o = table(spark, sf_dir, "orders")
    most = 10.0
    a = F.pmod(F.floor(F.col("o_totalprice")), F.lit(21)) / 2
    b = F.least(F.greatest(a + (F.pmod(F.col("o_custkey"), F.lit(5)) - 2) / 2, F.lit(0.0)), F.lit(most))
    system = F.least(F.greatest(a + (F.pmod(F.col("o_orderkey"), F.lit(3)) - 1) / 2, F.lit(0.0)), F.lit(most))
    rows = o.select(F.col("o_custkey").alias("booklet_id"), F.col("o_orderkey").alias("question_number"), F.lit(most).alias("max_marks"), a.alias("marker_a"), b.alias("marker_b"), F.when(F.abs(a - b) >= 1, a).alias("adjudicated"), system.alias("mark"), "o_orderstatus")
    return rows.drop("mark", "o_orderstatus"), rows.filter("o_orderstatus <> 'P'").select("booklet_id", "question_number", "mark"), rows


_MARKS = """marks AS (SELECT o_custkey AS booklet_id, o_orderkey AS question_number, o_orderstatus, a AS marker_a, b AS marker_b, CASE WHEN abs(a - b) >= 1 THEN a END AS adjudicated,
    least(greatest(a + (o_orderkey % 3 - 1) / 2, 0.0), 10.0) AS mark
  FROM (SELECT *, least(greatest(a + (o_custkey % 5 - 2) / 2, 0.0), 10.0) AS b FROM (SELECT *, (CAST(floor(o_totalprice) AS BIGINT) % 21) / 2 AS a FROM orders)))"""


def score_marks(spark, sf_dir):
    marks, predicted, _ = _marks(spark, sf_dir)
    return evaluation.score_marks(marks, predicted, ["booklet_id", "question_number"])


def golden_summary(spark, sf_dir):
    marks, _, _ = _marks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("booklet_id"), (F.col("l_returnflag") == "R").alias("illegible"))
    return evaluation.golden_summary(lines, marks)


def golden_duplicates(spark, sf_dir):
    return evaluation.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def mark_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(9000.0).alias("max_marks"), F.col("c_acctbal").alias("marker_a"), (F.col("c_acctbal") + 100).alias("marker_b"))
    return evaluation.mark_violations(rows).select("c_custkey", "marker_a")


def routing_quality(spark, sf_dir):
    return evaluation.routing_quality(table(spark, sf_dir, "labels"), ["quality"], "toxic", "quality")


def line_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(stats.line_confidence(F.col("value") / 500), 6).alias("confidence"))


def page_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(stats.line_confidence(F.col("value") / 500).alias("c"))
    return lines.groupBy("day").agg(F.round(stats.page_confidence(F.col("c")), 6).alias("confidence"), F.count("*").alias("n"))


def semantic_confidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(F.round(stats.semantic_confidence(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_returnflag") == "N", F.col("l_tax")), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (cer_by_role, wer_by_role, word_mismatches, qwk_labels, qwk_by_flag, agreement_stats, confusion_matrix, score_lines, score_words, legible_lines, score_marks, golden_summary, golden_duplicates, mark_violations, routing_quality, line_confidence, page_confidence, semantic_confidence)}
_LINE = "coalesce(least(greatest(least(avg({v}), 1 - 2 * coalesce(stddev_samp({v}), 0.0)), 0.0), 1.0), 0.0)"
SQL = {
    "cer_by_role": f"""WITH {_TURNS}, {_CODED}, s AS (SELECT role, count(*) AS n, sum(e)::BIGINT AS errors, sum(length(ref))::BIGINT AS length FROM coded GROUP BY role)
SELECT *, round({_RATE.format(e='errors', l='length')}, 6) AS rate, round(greatest(0.0, 1 - {_RATE.format(e='errors', l='length')}), 6) AS accuracy FROM s""",
    "word_mismatches": rf"""WITH {_TURNS}, w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(ref, '\s+'), lambda t: t <> '')) AS r, unnest(list_filter(regexp_split_to_array(hyp, '\s+'), lambda t: t <> '')) AS h FROM turns)
SELECT conv_id, turn, count(*) FILTER (r <> h) AS wrong, count(*) AS words FROM w GROUP BY ALL""",
    "qwk_labels": f"SELECT count(*) AS n, round({_KAPPA}, 6) AS kappa FROM (SELECT quality::DOUBLE AS i, toxic::DOUBLE AS j FROM labels)",
    "qwk_by_flag": f"WITH {_RATERS} SELECT l_returnflag, count(*) AS n, round({_KAPPA}, 6) AS kappa FROM raters GROUP BY 1",
    "agreement_stats": f"WITH {_RATERS} SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((i = j)::INT), 6) AS exact, round(avg((abs(i - j) <= 1)::INT), 6) AS within_one, round(avg(abs(i - j)), 6) AS mae, count(*) FILTER (i <> j) AS disagreements FROM raters GROUP BY 1, 2",
    "confusion_matrix": f"WITH {_RATERS} SELECT i AS a, j AS b, count(*) AS n FROM raters GROUP BY 1, 2",
    "score_lines": f"""WITH {_TURNS.replace("translate(text, 'mnrv', 'nmnu')", "translate(text, 'mv', 'nu')")}, {_CODED}, s AS (SELECT e, length(ref) AS l, (conv_id + turn) % 9 = 0 AS bad, (conv_id * 3 + turn) % 5 <> 0 AS found FROM coded),
t AS (SELECT count(*) FILTER (found AND NOT bad) AS measured, count(*) FILTER (bad) AS skipped, count(*) FILTER (NOT bad AND NOT found) AS missing, coalesce(sum(e) FILTER (found AND NOT bad), 0)::BIGINT AS char_errors, coalesce(sum(l) FILTER (found AND NOT bad), 0)::BIGINT AS chars FROM s)
SELECT *, round({_RATE.format(e='char_errors', l='chars')}, 6) AS cer, CASE WHEN {_RATE.format(e='char_errors', l='chars')} <= 0.08::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS tier1, CASE WHEN {_RATE.format(e='char_errors', l='chars')} <= 0.06::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS tier2 FROM t""",
    "legible_lines": "SELECT conv_id || ':1:' || turn AS key, conv_id || ':' || role AS mark FROM conversations WHERE (conv_id + turn) % 9 <> 0",
    "score_marks": f"""WITH {_MARKS}, r AS (SELECT least(round_even(mark / 0.5, 0), 20.0) AS s, least(round_even(coalesce(adjudicated, (marker_a + marker_b) / 2) / 0.5, 0), 20.0) AS t, least(round_even(marker_a / 0.5, 0), 20.0) AS a, least(round_even(marker_b / 0.5, 0), 20.0) AS b FROM marks WHERE o_orderstatus <> 'P'),
k AS (SELECT count(*) AS matched, 10.0::DOUBLE AS scale, round({_KAPPA.replace('(i-j)', '(s-t)').replace('i*i', 's*s').replace('j*j', 't*t').replace('sum(i)', 'sum(s)').replace('sum(j)', 'sum(t)')}, 6) AS kappa_system, round({_KAPPA.replace('(i-j)', '(a-b)').replace('i*i', 'a*a').replace('j*j', 'b*b').replace('sum(i)', 'sum(a)').replace('sum(j)', 'sum(b)')}, 6) AS kappa_markers FROM r)
SELECT *, kappa_system >= kappa_markers AS at_parity, CASE WHEN kappa_system >= 0.70 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM k""",
    "golden_summary": f"""WITH {_MARKS} SELECT (SELECT count(DISTINCT b) FROM (SELECT l_suppkey AS b FROM lineitem UNION ALL SELECT o_custkey FROM orders)) AS booklets, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS illegible, count(*) AS marks, count(*) FILTER (marker_a <> marker_b) AS disagreements FROM marks""",
    "golden_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "mark_violations": "SELECT c_custkey, c_acctbal AS marker_a FROM customer WHERE c_acctbal IS NULL OR NOT (c_acctbal BETWEEN 0 AND 9000 AND c_acctbal + 100 BETWEEN 0 AND 9000)",
    "routing_quality": """SELECT quality, round(count(*) FILTER (quality > 0 AND toxic <= 0) / nullif(count(*) FILTER (toxic <= 0), 0), 6) AS false_award, round(count(*) FILTER (quality <= 0 AND toxic > 0) / nullif(count(*) FILTER (toxic > 0), 0), 6) AS false_omission,
  round(count(*) FILTER (toxic > 0 AND quality > 0) / nullif(count(*) FILTER (quality > 0), 0), 6) AS precision, round(count(*) FILTER (quality > 0 AND toxic > 0) / nullif(count(*) FILTER (toxic > 0), 0), 6) AS recall FROM labels GROUP BY quality""",
    "line_confidence": f"SELECT user_id, count(*) AS n, round({_LINE.format(v='value / 500')}, 6) AS confidence FROM events GROUP BY user_id",
    "page_confidence": f"SELECT day, round(least(greatest(avg(c), 0.0), 1.0), 6) AS confidence, count(*) AS n FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, {_LINE.format(v='value / 500')} AS c FROM events GROUP BY ALL) GROUP BY day",
    "semantic_confidence": "SELECT l_suppkey, round(0.45::DOUBLE * avg(1 - l_discount) + 0.30::DOUBLE * avg(1 - l_tax) + 0.15::DOUBLE * (1 - avg((l_returnflag = 'N')::INT)) + 0.10::DOUBLE * (1 - max(l_tax)), 6) AS confidence FROM lineitem GROUP BY 1",
}
