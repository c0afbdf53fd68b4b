"""Rule engine, rubric checks, answer types and injections on the driver's tables. The SQL states the rules in its own terms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators import booklet, reconcile as rec, results, rubric, rules
from assayer.plans import marking
from assayer.session import table


def _verdicts(spark, sf_dir):
    """Line items as verdicts on marking points: an order is a script, a supplier's rest a question."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    rest = F.when(F.pmod("l_suppkey", F.lit(3)) == 0, "NOT_FOUND").when(F.pmod("l_suppkey", F.lit(2)) == 0, "CONTRADICTED").otherwise("UNVERIFIABLE")
    verdict = F.when(F.col("f") == "A", "ENTAILED").when(F.col("f") == "N", F.when(F.col("s") == "O", "PARTIAL").otherwise("ENTAILED")).otherwise(rest)
    question = F.pmod("l_suppkey", F.lit(2))
    return li.select(
        F.col("l_orderkey").alias("script"), question.alias("question"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("code"), F.floor(F.col("q") / 10 + 1).cast("double").alias("max_marks"),
        verdict.alias("verdict"), F.round(1 - F.col("d") * 5, 4).alias("confidence"), F.when(F.pmod("l_linenumber", F.lit(3)) == 0, F.lit(1)).alias("group_id"), F.lit(1).alias("group_max"), (question == 1).alias("group_exclusive"),
        F.when(F.pmod("l_linenumber", F.lit(2)) == 0, 0.5).otherwise(0.0).alias("negative"), F.when(question == 0, 3.5).otherwise(6.0).alias("question_max"),
        F.when(F.pmod("l_linenumber", F.lit(4)) == 0, "NUMERIC").when(F.pmod("l_linenumber", F.lit(4)) == 1, "SHORT").otherwise("PROSE").alias("answer_type"),
    )


def _awards(verdicts):
    """With the policy of each point's answer type; contradictions cost marks in question 0."""
    kind = F.col("answer_type")
    return rules.awards(verdicts, rules.policy_of(kind, "entail_confidence_floor"), rules.policy_of(kind, "partial_credit_fraction"), F.col("question") == 0)


def rule_awards(spark, sf_dir):
    return _awards(_verdicts(spark, sf_dir)).groupBy("rule", "verdict", "answer_type").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"), F.sum("would_be").alias("would_be"))


def group_caps(spark, sf_dir):
    return rules.group_caps(_awards(_verdicts(spark, sf_dir))).groupBy("rule").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"))


def rule_engine(spark, sf_dir):
    scored = rules.question_scores(rules.group_caps(_awards(_verdicts(spark, sf_dir))))
    trace = F.array_join(F.transform("trace", lambda t: F.concat_ws(" ", t["code"], t["rule"], t["marks"])), ", ")
    return scored.select("script", "question", "raw", "max_marks", F.round("confidence", 6).alias("confidence"), "marks", trace.alias("trace"))


def dependency_zeroing(spark, sf_dir):
    """Every line needs the one before it in its order."""
    p = _verdicts(spark, sf_dir)
    firsts = p.groupBy("script", (F.floor(F.col("code") / 100000)).alias("line")).agg(F.max("max_marks").alias("max_marks"), F.min("verdict").alias("verdict"), F.max("confidence").alias("confidence"))
    rows = firsts.select("script", F.lit(1).alias("question"), F.col("line").alias("code"), "max_marks", "verdict", "confidence", F.lit(0.0).alias("negative"), F.when(F.col("line") > 1, F.col("line") - 1).alias("requires"))
    return rules.dependencies(rules.awards(rows)).groupBy("code", "rule").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"))


def _decided(spark, sf_dir):
    """All phases; a point needs the one before it in its question."""
    before = W.partitionBy("script", "question").orderBy("code")
    return rules.group_caps(rules.dependencies(_awards(_verdicts(spark, sf_dir).withColumn("requires", F.lag("code").over(before)))))


def decision_trace(spark, sf_dir):
    found = rules.decision_trace(_decided(spark, sf_dir)).select("script", "question", F.explode("trace").alias("t"))
    return found.select("script", "question", "t.step", "t.phase", "t.rule", "t.point", "t.grp", "t.verdict", "t.confidence", "t.awarded", "t.cap", F.array_join("t.dropped", " ").alias("dropped"), "t.before", "t.after")


def decision_records(spark, sf_dir):
    """What a question's record lists beside its trace: awards withheld and caps that held."""
    found = rules.decision_trace(_decided(spark, sf_dir))
    withheld = F.array_join(F.transform("withheld", lambda w: F.concat_ws(" ", w["point"], w["reason"], w["would_have_been"])), ", ")
    return found.select("script", "question", withheld.alias("withheld"), F.array_join("caps", ", ").alias("caps")).filter("withheld <> '' or caps <> ''")


def policy_overrides(spark, sf_dir):
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("answer_type")).agg((F.avg("p_size") / 32).alias("auto_suggest_threshold"), (F.avg("p_size") / 50).alias("entail_confidence_floor"))
    over = table(spark, sf_dir, "part").filter("p_size > 45").groupBy(F.col("p_brand").alias("answer_type")).agg(F.lit(0.6).alias("auto_suggest_threshold"), F.when(F.max("p_size") > 48, 0.3).alias("entail_confidence_floor"))
    return rules.policies(parts, over).select("answer_type", F.round("auto_suggest_threshold", 6).alias("auto_suggest_threshold"), F.round("entail_confidence_floor", 6).alias("entail_confidence_floor"))


def overall_routing(spark, sf_dir):
    from assayer.functions import stats

    li = table(spark, sf_dir, "lineitem")
    overall = stats.overall_confidence(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_quantity") / 50 + 0.4, F.lit(0.97))
    row = lambda n, r: F.pmod("l_partkey", F.lit(n)) == r
    rows = li.select(overall.alias("overall"), (1 - F.col("l_tax") * 4).alias("ocr"), row(11, 1).alias("unverifiable"), row(13, 2).alias("degraded"), row(17, 3).alias("unmatched"), row(7, 4).alias("withheld"), F.when(row(5, 0), F.lit(True)).alias("contradicted"), F.when(row(3, 0), 0.5).otherwise(0.85).alias("auto"))
    route = rules.route(*(F.col(c) for c in ("overall", "ocr", "unverifiable", "degraded", "unmatched", "withheld", "contradicted", "auto")))
    return rows.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.min("overall"), 6).alias("least"))


def answer_matches(spark, sf_dir):
    """Parts as answers: prices as numbers with units in several shapes, names with edits."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    given = F.round(F.col("p_retailprice") + F.pmod(k, F.lit(11)), 2).cast("string")
    shapes = [F.concat(F.lit("about "), given, F.lit(" m/s^2")), F.concat(given, F.lit("m/s²")), F.concat(F.lit("Q2: g = "), given, F.lit(" m/s^2, so 3 times as much")), F.concat(given, F.lit(" cm")), F.concat(F.lit("-"), given, F.lit("e0 m/s^2")), F.lit("none of them, see Q7")]
    numeric = rules.numeric_match(F.element_at(F.array(*shapes), (F.pmod(k, F.lit(6)) + 1).cast("int")), F.col("p_retailprice"), F.lit("m/s^2"), F.lit(0.005))["rule"]
    name = F.col("p_name")
    answers = [F.upper(F.concat(F.lit(" "), name)), F.concat(name, F.lit("x")), F.concat(name, F.lit("xxx")), F.concat(name, F.lit("c")), F.concat(F.lit("q"), F.substr(name, F.lit(2)))]
    accepted = F.when(F.pmod(k, F.lit(5)) == 3, F.array(F.concat(name, F.lit("a")), F.concat(name, F.lit("b")))).otherwise(F.array(name, F.lit("ring")))
    short = rules.short_match(F.element_at(F.array(*answers), (F.pmod(k, F.lit(5)) + 1).cast("int")), accepted)["rule"]
    listed = rules.list_match(F.split("p_type", " "), F.split(F.lit("ECONOMY BRASS STEEL PROMO SMALL"), " "))
    return p.groupBy(numeric.alias("numeric"), short.alias("short")).agg(F.sum(listed).alias("listed"), F.count("*").alias("n"))


def _rubric(spark, sf_dir):
    """(points, questions): embeddings as points of their label's question, every tenth twice; each supplier is a question of one point."""
    base = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "part").hint("merge"), F.col("vec_id") == F.col("p_partkey"))
    base = base.withColumn("again", F.explode(F.when(F.pmod("vec_id", F.lit(10)) == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    v, own, again = F.col("vec_id"), F.concat(F.lit("c"), F.col("vec_id")), F.col("again")
    shapes = [
        F.concat(F.lit("The "), "p_name", F.lit(" is grey and the "), "p_type", F.lit(" holds it")), F.concat(F.lit("Is the "), "p_name", F.lit(" an "), "p_type", F.lit("?")), F.concat(F.lit("The "), "p_name", F.lit(" and the "), "p_type"), F.concat(F.lit("The list is "), F.repeat(F.concat("p_name", F.lit(" ")), 15)),
        F.concat(F.lit("The "), "p_name", F.lit(" does not bend")), F.concat(F.lit("What is the "), "p_name"), F.lit(None).cast("string"),
    ]
    statement = F.coalesce(*(F.when(F.pmod(v, F.lit(12)) == i, s) for i, s in enumerate(shapes)), F.when(F.pmod(v, F.lit(12)) > 6, F.concat(F.lit("The "), "p_name", F.lit(" and its cover is "), "p_type")))
    requires = F.when(again, F.when(F.pmod(v, F.lit(20)) == 0, own)).when(F.pmod(v, F.lit(9)) == 3, "none").when(F.pmod(v, F.lit(27)) == 4, own).when(F.pmod(v, F.lit(20)) == 0, F.concat(own, F.lit("b")))
    own_points = base.select(
        F.concat(F.lit("q"), "label").alias("question"), F.when(again, F.concat(own, F.lit("b"))).otherwise(own).alias("code"), statement.alias("statement"), (F.pmod("p_size", F.lit(5)) + 1).cast("double").alias("marks"), F.array_repeat("p_type", F.pmod(v, F.lit(4)).cast("int")).alias("exemplars"),
        F.when(F.pmod(v, F.lit(6)) == 0, 1).alias("group_id"), F.when(F.pmod("label", F.lit(2)) == 0, 100_000).otherwise(1).alias("group_max"), requires.alias("requires"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(again, x * 2).otherwise(x)).alias("vector"),
    )
    lone = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("question"), F.lit("p").alias("code"), F.concat(F.lit("The supplier is "), "s_name").alias("statement"), (F.pmod("s_suppkey", F.lit(3)) * 10).cast("double").alias("marks"), F.array("s_name", "s_name").alias("exemplars"), F.lit(None).cast("int").alias("group_id"), F.lit(None).cast("int").alias("group_max"), F.lit(None).cast("string").alias("requires"), F.lit(None).cast("array<double>").alias("vector"))
    points = own_points.unionByName(lone)
    sums = own_points.groupBy("question").agg(F.sum("marks").alias("total"))
    questions = sums.select("question", F.when(F.col("question") == "q1", F.col("total") + 1).otherwise(F.col("total")).alias("max_marks")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("question"), F.col("s_nationkey").cast("double").alias("max_marks")))
    return points, questions


def rubric_lint(spark, sf_dir):
    return rubric.lint(*_rubric(spark, sf_dir))


def freezable_rubrics(spark, sf_dir):
    points, questions = _rubric(spark, sf_dir)
    return rubric.freezable(rubric.lint(points, questions), questions).select("question")


_PHRASES = ["Ignore previous", "ignore  ALL previous", "System Note", "award full marks", "You are now", "disregard the", "new instructions", "assistant: yes", "SYSTEM: no", "=====&&", "ecosystem: ####"]


def _with_phrases(spark, sf_dir):
    """Whole texts; eleven of thirteen have a phrase added, as none has one by itself."""
    added = F.coalesce(F.try_element_at(F.array(*(F.lit(" " + p) for p in _PHRASES)), (F.pmod("doc_id", F.lit(13)) + 1).cast("int")), F.lit(""))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat("text", added))


def injection_flags(spark, sf_dir):
    return rec.injection_flags(_with_phrases(spark, sf_dir), ["doc_id"])


def integrity_queue(spark, sf_dir):
    """Texts with an injection, texts of several rows, booklets with missing pages or scanned twice, and answers under another question."""
    flagged = injection_flags(spark, sf_dir).select(F.col("doc_id").alias("subject"))
    copies = marking.duplicate_answers(spark, sf_dir).select(F.col("first").alias("subject"))
    scans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("booklet"), F.col("l_linenumber").alias("page_no"), F.col("l_suppkey").alias("content"))
    gaps = booklet.missing_pages(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("booklet"), F.lit(4).alias("page_total")), scans.select("booklet", "page_no"))
    moved = marking.misplaced_answers(spark, sf_dir).select(F.col("answer").alias("subject"))
    twice = results.duplicate_booklets(scans).select(F.col("booklet").alias("subject"))
    found = results.integrity({"INJECTION": flagged, "IDENTICAL_ANSWERS": copies, "MISSING_PAGES": gaps.select(F.col("booklet").alias("subject")).distinct(), "MISPLACED_ANSWER": moved, "DUPLICATE_BOOKLET": twice})
    return found.groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rule_awards, group_caps, rule_engine, dependency_zeroing, decision_trace, decision_records, policy_overrides, overall_routing, answer_matches, rubric_lint, freezable_rubrics, injection_flags, integrity_queue)}

_RULED = """CASE WHEN verdict = 'ENTAILED' THEN CASE WHEN confidence >= {floor} THEN 'R-ENTAIL-FULL' ELSE 'R-ENTAIL-WITHHELD' END WHEN verdict = 'PARTIAL' THEN CASE WHEN confidence >= {floor} THEN 'R-PARTIAL-HALF' ELSE 'R-PARTIAL-WITHHELD' END
    WHEN verdict = 'CONTRADICTED' THEN CASE WHEN {penalised} THEN 'R-CONTRADICTION-PENALTY' ELSE 'R-CONTRADICTED-ZERO' END WHEN verdict = 'UNVERIFIABLE' THEN 'R-UNVERIFIABLE-HOLD' ELSE 'R-NOT-FOUND-ZERO' END"""
_POINTS = f"""points AS (SELECT l_orderkey AS script, l_suppkey % 2 AS question, (l_linenumber * 100000 + l_suppkey)::BIGINT AS code, l_linenumber AS line, floor(q / 10 + 1)::DOUBLE AS max_marks, round(1 - d * 5, 4) AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN 1 END AS group_id, CASE l_linenumber % 4 WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'SHORT' ELSE 'PROSE' END AS answer_type,
    CASE WHEN f = 'A' THEN 'ENTAILED' WHEN f = 'N' THEN CASE WHEN s = 'O' THEN 'PARTIAL' ELSE 'ENTAILED' END WHEN l_suppkey % 3 = 0 THEN 'NOT_FOUND' WHEN l_suppkey % 2 = 0 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS verdict
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, max(l_quantity) AS q, max(l_discount) AS d, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL)),
ruled AS (SELECT *, {_RULED.format(floor="CASE answer_type WHEN 'NUMERIC' THEN 0.90 ELSE 0.65 END::DOUBLE", penalised="question = 0 AND line % 2 = 0")} AS rule, max_marks * CASE answer_type WHEN 'SHORT' THEN 0.0 ELSE 0.5 END::DOUBLE AS half FROM points),
marked AS (SELECT *, CASE rule WHEN 'R-ENTAIL-FULL' THEN max_marks WHEN 'R-PARTIAL-HALF' THEN half WHEN 'R-CONTRADICTION-PENALTY' THEN -0.5 ELSE 0.0 END::DOUBLE AS marks, CASE rule WHEN 'R-ENTAIL-WITHHELD' THEN max_marks WHEN 'R-PARTIAL-WITHHELD' THEN half END::DOUBLE AS would_be FROM ruled)"""
_OVER = "group_id IS NOT NULL AND marks > 0 AND row_number() OVER (PARTITION BY script, question, group_id, marks > 0 ORDER BY confidence DESC, code) > 1"
_CAP = "CASE question WHEN 1 THEN 'R-GROUP-EXCLUSIVE' ELSE 'R-GROUP-CAP' END"
_CAPPED = f"capped AS (SELECT * EXCLUDE (marks, rule), CASE WHEN over THEN 0.0 ELSE marks END::DOUBLE AS marks, CASE WHEN over THEN {_CAP} ELSE rule END AS rule FROM (SELECT *, {_OVER} AS over FROM marked))"
_TRACE = f"""{_POINTS}, chained AS (SELECT *, marks > 0 AND coalesce(sum((marks > 0)::INT) OVER before, 0) < row_number() OVER (PARTITION BY script, question ORDER BY code) - 1 AS lost, marks AS first, rule AS first_rule FROM marked WINDOW before AS (PARTITION BY script, question ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
left_over AS (SELECT * EXCLUDE (marks), CASE WHEN lost THEN 0.0 ELSE marks END::DOUBLE AS marks FROM chained), judged AS (SELECT *, {_OVER} AS over FROM left_over),
totals AS (SELECT *, CASE WHEN question = 0 THEN 3.5 ELSE 6.0 END::DOUBLE AS most FROM (SELECT script, question, sum(CASE WHEN over THEN 0.0 ELSE marks END) AS raw FROM judged GROUP BY ALL)),
steps AS (
  SELECT script, question, 1 AS phase, code AS nth, first_rule AS rule, code::VARCHAR AS point, NULL AS grp, verdict, confidence, NULL AS awarded, NULL AS cap, NULL AS dropped, NULL AS before, first AS after FROM judged
  UNION ALL SELECT script, question, 2, code, 'R-DEPENDENCY', code::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, first, 0.0 FROM judged WHERE lost
  UNION ALL SELECT script, question, 3, group_id, any_value({_CAP}), NULL, group_id::VARCHAR, NULL, NULL, count(*) FILTER (marks > 0)::INT, 1.0, string_agg(code::VARCHAR, ' ' ORDER BY code) FILTER (over), NULL, NULL FROM judged GROUP BY script, question, group_id HAVING bool_or(over)
  UNION ALL SELECT script, question, 4, 1, 'R-QUESTION-CAP', NULL, NULL, NULL, NULL, NULL, most, NULL, raw, least(raw, most) FROM totals
  UNION ALL SELECT script, question, 4, 2, 'R-NEGATIVE-FLOOR', NULL, NULL, NULL, NULL, NULL, NULL, NULL, raw, 0.0 FROM totals WHERE raw < 0
  UNION ALL SELECT script, question, 4, 3, 'R-ROUNDING', NULL, NULL, NULL, NULL, NULL, NULL, NULL, greatest(least(raw, most), 0.0), least(floor(greatest(least(raw, most), 0.0) / 0.5 + 0.5) * 0.5, most) FROM totals)"""
_LINT = """e AS (SELECT 'q' || label AS question, 'c' || vec_id AS code, vec_id AS v, label, p_size, p_type, list_transform(embedding, lambda x: x::DOUBLE) AS vector, CASE WHEN vec_id % 9 = 3 THEN 'none' WHEN vec_id % 27 = 4 THEN 'c' || vec_id WHEN vec_id % 20 = 0 THEN 'c' || vec_id || 'b' END AS requires FROM embeddings JOIN part ON vec_id = p_partkey),
pts AS (SELECT question, code, v, label, p_size % 5 + 1 AS marks, requires, vector FROM e UNION ALL SELECT question, code || 'b', v, label, p_size % 5 + 1, CASE WHEN v % 20 = 0 THEN code END, vector FROM e WHERE v % 10 = 0),
per AS (SELECT question, sum(marks) AS total, count(*) AS n FROM pts GROUP BY 1), sup AS (SELECT 's' || s_suppkey AS question, s_suppkey % 3 * 10 AS marks, s_nationkey AS most FROM supplier),
reach AS (SELECT question, code, requires AS needs FROM pts WHERE requires IS NOT NULL UNION SELECT r.question, r.code, p.requires FROM reach r JOIN pts p ON p.question = r.question AND p.code = r.needs WHERE p.requires IS NOT NULL),
found AS (
  SELECT 'CONJOINED' AS rule, 'BLOCK' AS severity, question, code FROM pts WHERE v % 12 = 0
  UNION ALL SELECT 'NOT_DECLARATIVE', 'BLOCK', question, code FROM pts WHERE v % 12 IN (1, 2, 5, 6)
  UNION ALL SELECT 'TOO_LONG', 'BLOCK', question, code FROM pts WHERE v % 12 = 3
  UNION ALL SELECT 'FEW_EXEMPLARS', 'BLOCK', question, code FROM pts WHERE v % 4 < 2
  UNION ALL SELECT 'MARKS_SUM', 'BLOCK', 'q1', NULL WHERE EXISTS (SELECT 1 FROM per WHERE question = 'q1') UNION ALL SELECT 'MARKS_SUM', 'BLOCK', question, NULL FROM sup WHERE marks <> most
  UNION ALL SELECT 'REQUIRES', 'BLOCK', question, code FROM pts WHERE requires = 'none' UNION ALL SELECT DISTINCT 'REQUIRES', 'BLOCK', question, code FROM reach WHERE code = needs
  UNION ALL SELECT 'GROUP_CAP', 'BLOCK', question, '1' FROM pts WHERE v % 6 = 0 AND label % 2 = 0 GROUP BY question HAVING count(*) < 100000
  UNION ALL SELECT 'ALIKE', 'BLOCK', a.question, least(a.code, b.code) || ' ' || greatest(a.code, b.code) FROM pts a JOIN pts b ON a.question = b.question AND a.code < b.code WHERE list_cosine_similarity(a.vector, b.vector) > 0.9::DOUBLE
  UNION ALL SELECT 'NEGATION', 'WARN', question, code FROM pts WHERE v % 12 = 4
  UNION ALL SELECT 'HEAVY_POINT', 'WARN', question, 'p' FROM sup WHERE marks > most * 0.4::DOUBLE UNION ALL SELECT 'HEAVY_POINT', 'WARN', question, code FROM pts JOIN per USING (question) WHERE marks > (total + (question = 'q1')::INT) * 0.4::DOUBLE
  UNION ALL SELECT 'COARSE', 'WARN', question, NULL FROM sup WHERE most > 15 UNION ALL SELECT 'COARSE', 'WARN', question, NULL FROM per WHERE n < 5 AND total + (question = 'q1')::INT > 15)"""
_HITS = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in (r"(?i)ignore\s+(all\s+)?previous", r"(?i)system\s+note", r"(?i)award\s+full\s+marks", r"(?i)you\s+are\s+now", r"(?i)disregard\s+the\b", r"(?i)new\s+instructions", r"(?i)\b(assistant|system):", r"[#=*%$&<>{}|~^@\\]{6,}"))
_INJECTED = f"""SELECT doc_id, hits::INTEGER AS hits FROM (SELECT doc_id, {_HITS} AS hits FROM (SELECT doc_id, text || CASE doc_id % 13 {" ".join(f"WHEN {i} THEN ' {p}'" for i, p in enumerate(_PHRASES))} ELSE '' END AS t FROM documents)) WHERE hits > 0"""
SQL = {
    "rule_awards": f"WITH {_POINTS} SELECT rule, verdict, answer_type, count(*) AS n, sum(marks) AS marks, sum(would_be) AS would_be FROM marked GROUP BY 1, 2, 3",
    "group_caps": f"WITH {_POINTS}, {_CAPPED} SELECT rule, count(*) AS n, sum(marks) AS marks FROM capped GROUP BY 1",
    "rule_engine": f"""WITH {_POINTS}, {_CAPPED}, scored AS (SELECT script, question, sum(marks) AS raw, CASE WHEN question = 0 THEN 3.5 ELSE 6.0 END::DOUBLE AS max_marks, string_agg(code || ' ' || rule || ' ' || marks::VARCHAR, ', ' ORDER BY code) AS trace,
  round(greatest(1 - count(*) FILTER (would_be IS NOT NULL) / count(*) - 0.10::DOUBLE * count(*) FILTER (verdict = 'CONTRADICTED') - 0.05::DOUBLE * count(DISTINCT CASE WHEN over THEN group_id END), 0.0), 6) AS confidence FROM capped GROUP BY script, question)
SELECT *, least(floor(greatest(least(raw, max_marks), 0.0) / 0.5 + 0.5) * 0.5, max_marks) AS marks FROM scored""",
    "dependency_zeroing": f"""WITH {_POINTS}, f AS (SELECT script, line, max(max_marks) AS max_marks, min(verdict) AS verdict, max(confidence) AS confidence FROM points GROUP BY ALL), a AS (SELECT *, {_RULED.format(floor="0.65::DOUBLE", penalised="FALSE")} AS rule FROM f),
b AS (SELECT *, CASE rule WHEN 'R-ENTAIL-FULL' THEN max_marks WHEN 'R-PARTIAL-HALF' THEN max_marks * 0.5 ELSE 0.0 END::DOUBLE AS marks FROM a),
c AS (SELECT *, marks > 0 AND coalesce(sum((marks > 0)::INT) OVER (PARTITION BY script ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < line - 1 AS lost FROM b)
SELECT line::BIGINT AS code, CASE WHEN lost THEN 'R-DEPENDENCY' ELSE rule END AS rule, count(*) AS n, sum(CASE WHEN lost THEN 0.0 ELSE marks END)::DOUBLE AS marks FROM c GROUP BY 1, 2""",
    "decision_trace": f"WITH {_TRACE} SELECT script, question, row_number() OVER (PARTITION BY script, question ORDER BY phase, nth)::INTEGER AS step, phase, rule, point, grp, verdict, confidence, awarded, cap::DOUBLE AS cap, dropped, before::DOUBLE AS before, after::DOUBLE AS after FROM steps",
    "decision_records": f"""WITH {_TRACE} SELECT * FROM (SELECT script, question, coalesce(string_agg(code || ' CONFIDENCE_BELOW_FLOOR ' || would_be::VARCHAR, ', ' ORDER BY code) FILTER (first_rule LIKE '%WITHHELD'), '') AS withheld,
  CASE WHEN bool_or(over) THEN 'GROUP_1_MAX_1_AWARDS' ELSE '' END AS caps FROM judged GROUP BY 1, 2) WHERE withheld <> '' OR caps <> ''""",
    "policy_overrides": "SELECT p_brand AS answer_type, CASE WHEN max(p_size) > 45 THEN 0.8 ELSE round(greatest(avg(p_size) / 32, 0.8), 6) END::DOUBLE AS auto_suggest_threshold, CASE WHEN max(p_size) > 48 THEN 0.3 ELSE round(avg(p_size) / 50, 6) END::DOUBLE AS entail_confidence_floor FROM part GROUP BY 1",
    "overall_routing": """WITH r AS (SELECT least(1 - l_discount, 1 - l_tax, l_quantity / 50 + 0.4::DOUBLE, 0.97::DOUBLE) AS overall, 1 - l_tax * 4 AS ocr, l_partkey AS k FROM lineitem)
SELECT CASE WHEN k % 11 = 1 OR k % 13 = 2 OR k % 17 = 3 OR ocr < 0.70::DOUBLE OR overall < 0.70::DOUBLE THEN 'MANUAL_ONLY' WHEN k % 7 = 4 OR k % 5 = 0 OR overall < CASE WHEN k % 3 = 0 THEN 0.80 ELSE 0.85 END::DOUBLE THEN 'MANUAL_REVIEW' ELSE 'AUTO_SUGGEST' END AS route, count(*) AS n, round(min(overall), 6) AS least FROM r GROUP BY 1""",
    "answer_matches": """WITH a AS (SELECT p_partkey AS k, p_type, p_retailprice AS v, round(p_retailprice + p_partkey % 11, 2) AS given, lower(p_name) AS name FROM part),
b AS (SELECT *, CASE k % 6 WHEN 3 THEN 'R-NUMERIC-UNIT' WHEN 5 THEN 'R-NUMERIC-ABSENT' ELSE CASE WHEN abs(CASE k % 6 WHEN 4 THEN -given ELSE given END - v) <= 0.005::DOUBLE * v THEN 'R-NUMERIC-MATCH' ELSE 'R-NUMERIC-VALUE' END END AS numeric,
  CASE k % 5 WHEN 0 THEN 'R-SHORT-EXACT' WHEN 1 THEN CASE WHEN length(name) >= 8 THEN 'R-SHORT-NEAR' ELSE 'R-SHORT-NONE' END WHEN 2 THEN CASE WHEN length(name) >= 24 THEN 'R-SHORT-NEAR' ELSE 'R-SHORT-NONE' END
    WHEN 3 THEN CASE WHEN length(name) >= 7 THEN 'R-SHORT-AMBIGUOUS' ELSE 'R-SHORT-NONE' END ELSE CASE WHEN length(name) >= 8 THEN 'R-SHORT-NEAR' ELSE 'R-SHORT-NONE' END END AS short FROM a)
SELECT numeric, short, sum(len(list_intersect(string_split(p_type, ' '), string_split('ECONOMY BRASS STEEL PROMO SMALL', ' '))))::BIGINT AS listed, count(*) AS n FROM b GROUP BY 1, 2""",
    "rubric_lint": f"WITH RECURSIVE {_LINT} SELECT rule, severity, question, code FROM found",
    "freezable_rubrics": f"WITH RECURSIVE {_LINT} SELECT question FROM (SELECT question FROM per UNION ALL SELECT question FROM sup) WHERE question NOT IN (SELECT question FROM found WHERE severity = 'BLOCK')",
    "injection_flags": _INJECTED,
    "integrity_queue": f"""SELECT 'INJECTION' AS kind, count(*) AS n FROM ({_INJECTED}) UNION ALL SELECT 'IDENTICAL_ANSWERS', count(*) FROM ({marking.SQL["duplicate_answers"]})
UNION ALL SELECT 'MISSING_PAGES', count(DISTINCT o_orderkey) FROM (SELECT o_orderkey, unnest(range(1, 5)) AS page_no FROM orders) WHERE (o_orderkey, page_no) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem)
UNION ALL SELECT 'MISPLACED_ANSWER', count(*) FROM ({marking.SQL["misplaced_answers"]}) UNION ALL SELECT 'DUPLICATE_BOOKLET', count(*) FROM (SELECT l_orderkey FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_suppkey) > 1) GROUP BY 1)""",
}
