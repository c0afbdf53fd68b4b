"""Calibration by group, corrections, rate limits and batched inserts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import calibration, corrections, limits, tenancy
from assayer.session import table

GROUP = ["rubric_version", "answer_type"]


def _scores(spark, sf_dir):
    """Labelled documents as scored marking points: ids give the rubric's version and the part, sources the answer's type."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    part = F.when(F.pmod("doc_id", F.lit(5)) < 3, "train").when(F.pmod("doc_id", F.lit(5)) == 3, "validate").otherwise("test")
    return joined.select(F.pmod("doc_id", F.lit(2)).alias("rubric_version"), F.coalesce("source", F.lit("none")).alias("answer_type"), (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), "quality", part.alias("part"))


def calibration_blocks(spark, sf_dir):
    return calibration.fit(_scores(spark, sf_dir).filter("part = 'train'"), GROUP, "score", "quality").select(*GROUP, "lo", "hi", "n", "good", F.round("value", 9).alias("value"))


def calibration_report(spark, sf_dir):
    report, _ = calibration.calibrate(_scores(spark, sf_dir), GROUP, "score", "quality", part="part")
    return report.withColumns({c: F.round(c, 9) for c in ("threshold", "brier")})


def rate_limits(spark, sf_dir):
    """Events as requests of their users, at most 2, 3 or 4 of a kind in 12 hours."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = limits.rate_limit(e.withColumn("at", (F.col("at") / 1_000_000).cast("double")), {"click": 2, "view": 3, "error": 4, "purchase": 2}, 43_200.0)
    return found.select("caller", "kind", "seq", "allowed", "used", F.round("retry_after", 3).alias("retry_after"))


def insert_batches(spark, sf_dir):
    """Suppliers' parts as requests to issue booklets: batches of 40 rows, and the audit row of each."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("request"), F.col("l_orderkey").alias("id")).distinct()
    return tenancy.batch_audit(tenancy.in_batches(rows, "request", "id", 40), "request", "id")


def correction_proposals(spark, sf_dir):
    """Embeddings as answers to their label's point, overridden the more rarely the greater the label."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(1).alias("question"), F.col("label").alias("point"), F.col("vec_id").alias("answer"), F.col("embedding").alias("vector"), (F.pmod(F.col("vec_id") * 7, F.col("label") + 2) == 0).alias("overridden"))
    return corrections.proposals(e).withColumns({"rate": F.round("rate", 6), "nearness": F.round("nearness", 6)})


def marker_consistency(spark, sf_dir):
    """Suppliers as markers of the same lines."""
    li = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(20)).alias("marker"), F.pmod("l_orderkey", F.lit(5000)).alias("script"), F.col("l_linenumber").alias("question"), F.col("l_quantity").alias("mark"))
    found = corrections.marker_consistency(li, 5.0)
    return found.select("marker", "n", *(F.round(c, 6).alias(c) for c in ("exact", "bias", "spread")))


QUERIES = {f.__name__: f for f in (calibration_blocks, calibration_report, rate_limits, insert_batches, correction_proposals, marker_consistency)}
_FIT = """s AS (SELECT doc_id % 2 AS v, coalesce(source, 'none') AS a, least(greatest(round_even(n_chars / (n_chars + 2000)::DOUBLE * 10000, 0), 0), 10000)::INT AS bin, quality, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'validate' ELSE 'test' END AS part FROM labels JOIN documents USING (doc_id)),
pt AS MATERIALIZED (SELECT v, a, bin, count(*) AS n, sum(quality)::BIGINT AS good, row_number() OVER (PARTITION BY v, a ORDER BY bin) AS i, sum(count(*)) OVER w AS cn, sum(sum(quality)) OVER w AS cg FROM s WHERE part = 'train' AND n_ok GROUP BY v, a, bin WINDOW w AS (PARTITION BY v, a ORDER BY bin)),
av AS (SELECT x.v, x.a, x.i AS f, y.i AS t, (y.cg - x.cg + x.good) / (y.cn - x.cn + x.n)::DOUBLE AS m FROM pt x JOIN pt y ON x.v = y.v AND x.a = y.a AND y.i >= x.i),
mn AS (SELECT v, a, f, t, min(m) OVER (PARTITION BY v, a, f ORDER BY t DESC) AS m FROM av),
iso AS (SELECT v, a, t AS i, max(m) AS value FROM mn GROUP BY v, a, t),
bl AS MATERIALIZED (SELECT v, a, min(bin) AS lo, max(bin) AS hi, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good, value FROM pt JOIN iso USING (v, a, i) GROUP BY v, a, value)""".replace(" AND n_ok", "")
SQL = {
    "calibration_blocks": f"WITH {_FIT} SELECT v AS rubric_version, a AS answer_type, lo, hi, n, good, round(value, 9) AS value FROM bl",
    "calibration_report": f"""WITH {_FIT}, ln AS (SELECT *, lead(lo) OVER w AS nx, lead(value) OVER w AS av, lag(hi) OVER w AS pv FROM bl WINDOW w AS (PARTITION BY v, a ORDER BY lo)),
c AS (SELECT s.*, CASE WHEN bin <= hi OR nx IS NULL THEN value ELSE value + (av - value) * (bin - hi) / (nx - hi) END AS p FROM s LEFT JOIN ln ON ln.v = s.v AND ln.a = s.a AND (bin >= lo OR pv IS NULL) AND (bin < nx OR nx IS NULL)),
o AS (SELECT v, a, p, sum(quality) AS g, sum(1 - quality) AS b FROM c WHERE part = 'validate' AND p IS NOT NULL GROUP BY ALL),
k AS (SELECT v, a, p AS threshold, coalesce(sum(g) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 * sum(b) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cost FROM o WINDOW w AS (PARTITION BY v, a ORDER BY p) UNION ALL SELECT v, a, NULL, sum(g) FROM o GROUP BY v, a),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v, a ORDER BY cost, threshold DESC NULLS FIRST) AS nth FROM k) WHERE nth = 1)
SELECT c.v AS rubric_version, c.a AS answer_type, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'validate') AS n_validate, count(*) FILTER (part = 'test') AS n_test, round(any_value(threshold), 9) AS threshold, any_value(cost)::DOUBLE AS cost,
  count(*) FILTER (part = 'test' AND p >= threshold) AS awards, count(*) FILTER (part = 'test' AND p >= threshold AND quality = 0) AS false_awards, count(*) FILTER (part = 'test' AND coalesce(p < threshold, TRUE) AND quality = 1) AS false_omissions,
  round(avg((p - quality) * (p - quality)) FILTER (part = 'test'), 9) AS brier FROM c LEFT JOIN h USING (v, a) GROUP BY c.v, c.a""",
    "rate_limits": """WITH RECURSIVE e AS (SELECT user_id AS caller, event_type AS kind, event_id AS seq, epoch_us(ts) / 1000000 AS t0, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 END AS most FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')),
n AS (SELECT *, row_number() OVER (PARTITION BY caller, kind ORDER BY t0, seq) AS nth FROM e),
r AS (SELECT caller, kind, seq, nth, t0, TRUE AS allowed, [t0] AS passed FROM n WHERE nth = 1
  UNION ALL SELECT n.caller, n.kind, n.seq, n.nth, n.t0, len(list_filter(r.passed, lambda t: t > n.t0 - 43200)) < n.most, list_filter(r.passed, lambda t: t > n.t0 - 43200) || CASE WHEN len(list_filter(r.passed, lambda t: t > n.t0 - 43200)) < n.most THEN [n.t0] ELSE [] END FROM r JOIN n ON n.caller = r.caller AND n.kind = r.kind AND n.nth = r.nth + 1)
SELECT caller, kind, seq, allowed, len(passed)::BIGINT AS used, CASE WHEN NOT allowed THEN round(passed[1] + 43200 - t0, 3) END AS retry_after FROM r""",
    "insert_batches": """WITH d AS (SELECT DISTINCT l_suppkey AS request, l_orderkey AS id FROM lineitem), b AS (SELECT *, (row_number() OVER (PARTITION BY request ORDER BY id) - 1) // 40 AS batch FROM d)
SELECT request, batch::BIGINT AS batch, 'booklets.issue' AS action, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY 1, 2""",
    "correction_proposals": """WITH m AS (SELECT label AS point, vec_id AS answer, embedding::DOUBLE[] AS x, (vec_id * 7) % (label + 2) = 0 AS wrong FROM embeddings), r AS (SELECT point, count(*) AS n, avg(wrong::INT) AS rate FROM m GROUP BY 1 HAVING avg(wrong::INT) > 0.15::DOUBLE),
c AS (SELECT m.point, answer, x, i - 1 AS i, x[i] AS y FROM m JOIN r USING (point), range(1, 2000) t(i) WHERE wrong AND i <= len(x)),
d AS (SELECT point, answer, p, sum(y * ((i * 7 + p * 13 + i * i * (p + 1)) % 11 - 5)) >= 0 AS up FROM c, range(4) q(p) GROUP BY point, answer, p),
k AS (SELECT point, answer, string_agg(CASE WHEN up THEN '1' ELSE '0' END, '' ORDER BY p) AS kind FROM d GROUP BY point, answer),
g AS (SELECT point, kind, count(*) AS members, row_number() OVER (PARTITION BY point ORDER BY count(*) DESC, kind DESC) AS nth FROM k GROUP BY point, kind),
o AS (SELECT point, answer, kind, members, x, sqrt(list_dot_product(x, x)) AS size FROM k JOIN g USING (point, kind) JOIN m USING (point, answer) WHERE nth = 1),
s AS (SELECT a.point, a.kind, a.members, a.answer, sum(list_dot_product(a.x, b.x) / a.size / b.size) AS near FROM o a JOIN o b USING (point) GROUP BY a.point, a.kind, a.members, a.answer),
z AS (SELECT point, sqrt(sum(near)) AS whole FROM s GROUP BY 1),
w AS (SELECT s.*, row_number() OVER (PARTITION BY point ORDER BY round(near / whole, 9) DESC, answer) AS nth, near / whole AS nearness FROM s JOIN z USING (point))
SELECT 1 AS question, point, n, round(rate, 6) AS rate, kind, members, answer AS exemplar, round(nearness, 6) AS nearness FROM w JOIN r USING (point) WHERE nth = 1""",
    "marker_consistency": """WITH m AS (SELECT l_suppkey % 20 AS marker, l_orderkey % 5000 AS script, l_linenumber AS question, l_quantity AS mark FROM lineitem), g AS (SELECT marker, mark - (sum(mark) OVER w - mark) / (count(*) OVER w - 1) AS gap, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY script, question))
SELECT marker, count(*) AS n, round(avg((abs(gap) <= 5)::INT), 6) AS exact, round(avg(gap), 6) AS bias, round(stddev_samp(gap), 6) AS spread FROM g WHERE c > 1 GROUP BY 1""",
}
