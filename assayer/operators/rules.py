"""Marks from verdicts: awards, dependencies, caps, rounding, routing and the trace. Policy is data with defaults.

Verdicts (script, question, code, max_marks, verdict, confidence, group_id, group_max, requires, negative) have one of five
values. Rounding is half-up, once, and may not pass the question's maximum. What a policy sets may be a value or a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The default policy, what an answer's type sets otherwise, and the platform's floor.
POLICY = {"entail_confidence_floor": 0.65, "partial_credit_fraction": 0.5, "round_to": 0.5, "auto_suggest_threshold": 0.85, "manual_only_threshold": 0.70, "contradiction_penalty_enabled": False}
BY_ANSWER_TYPE = {"NUMERIC": {"entail_confidence_floor": 0.90, "round_to": 1.0}, "SHORT": {"partial_credit_fraction": 0.0}}
PLATFORM_AUTO_SUGGEST = 0.80
#: Answers that are shown to a person and never scored.
UNSCORED = ("DIAGRAM", "MATH", "CODE")
#: What a contradicted point, and a group that drops awards, take from the confidence in a question's marks. The size is this library's choice.
CONTRADICTION_PENALTY, CAP_PENALTY = 0.10, 0.05
WITHHELD = ("R-ENTAIL-WITHHELD", "R-PARTIAL-WITHHELD")
CAPPED = ("R-GROUP-CAP", "R-GROUP-EXCLUSIVE")
Value = Column | float | bool


def policy_of(answer_type: Column, name: str) -> Column:
    """A setting by the answer's type, else its default."""
    own = [F.when(answer_type == kind, F.lit(settings[name])) for kind, settings in BY_ANSWER_TYPE.items() if name in settings]
    return F.coalesce(*own, F.lit(POLICY[name]))


def policies(defaults: DataFrame, overrides: DataFrame, key: str = "answer_type") -> DataFrame:
    """Policy per key: an override where it is set, else the default; suggestions never below the platform's threshold."""
    names = [c for c in defaults.columns if c != key]
    other = overrides.select(key, *(F.col(c).alias(f"o_{c}") for c in names))
    out = defaults.join(other, key, "left").select(key, *(F.coalesce(f"o_{c}", c).alias(c) for c in names))
    bounded = F.greatest("auto_suggest_threshold", F.lit(PLATFORM_AUTO_SUGGEST))
    return out.withColumn("auto_suggest_threshold", bounded) if "auto_suggest_threshold" in names else out


def as_column(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def awards(verdicts: DataFrame, floor: Value = POLICY["entail_confidence_floor"], partial_share: Value = POLICY["partial_credit_fraction"], penalise: Value = POLICY["contradiction_penalty_enabled"]) -> DataFrame:
    """``marks`` and ``rule`` of each point, and the same as ``first_marks`` and ``first_rule`` for the trace.

    Below the floor, or without a confidence, an entailed or partial point is withheld. A contradicted point costs ``negative``
    marks where penalties are enabled and it has some.
    """
    sure = F.col("confidence") >= as_column(floor)
    v = F.col("verdict")
    rule = (
        F.when((v == "ENTAILED") & sure, "R-ENTAIL-FULL")
        .when(v == "ENTAILED", "R-ENTAIL-WITHHELD")
        .when((v == "PARTIAL") & sure, "R-PARTIAL-HALF")
        .when(v == "PARTIAL", "R-PARTIAL-WITHHELD")
        .when((v == "CONTRADICTED") & as_column(penalise) & (F.col("negative") > 0), "R-CONTRADICTION-PENALTY")
        .when(v == "CONTRADICTED", "R-CONTRADICTED-ZERO")
        .when(v == "UNVERIFIABLE", "R-UNVERIFIABLE-HOLD")
        .otherwise("R-NOT-FOUND-ZERO")
    )
    out = verdicts.withColumn("rule", rule)
    part = F.col("max_marks") * as_column(partial_share)
    marks = F.when(F.col("rule") == "R-ENTAIL-FULL", F.col("max_marks")).when(F.col("rule") == "R-PARTIAL-HALF", part).when(F.col("rule") == "R-CONTRADICTION-PENALTY", -F.col("negative")).otherwise(0.0)
    lost = F.when(F.col("rule") == "R-ENTAIL-WITHHELD", F.col("max_marks")).when(F.col("rule") == "R-PARTIAL-WITHHELD", part)
    return out.withColumns({"marks": marks.cast("double"), "would_be": lost.cast("double")}).withColumns({"first_rule": F.col("rule"), "first_marks": F.col("marks")})


def dependencies(points: DataFrame) -> DataFrame:
    """Points whose required point, or any that this one requires in turn, has no marks lose theirs.

    A question's points, a rubric's number, meet in one row, and each follows its chain to the end, in time that grows with the cube of
    that number; a code used twice counts
    by its greatest marks. A required code that no point has counts as no marks; a cycle ends where it began.
    """
    rows = points.groupBy("script", "question").agg(F.collect_list(F.struct(*points.columns)).alias("ps"))
    earned = lambda code: F.aggregate("ps", F.struct(F.lit(None).cast(points.schema["requires"].dataType).alias("next"), F.lit(0.0).alias("marks")), lambda acc, q: F.when((q["code"] == code) & (q["marks"] > acc["marks"]), F.struct(q["requires"].alias("next"), q["marks"].cast("double").alias("marks"))).otherwise(acc))

    def follow(acc: Column, _: Column) -> Column:
        found = earned(acc["at"])
        return F.when(acc["at"].isNull() | ~acc["paid"], acc).otherwise(F.struct(F.when(found["marks"] > 0, found["next"]).alias("at"), (found["marks"] > 0).alias("paid")))

    def judged(p: Column) -> Column:
        paid = F.aggregate(F.sequence(F.lit(1), F.size("ps")), F.struct(p["requires"].alias("at"), F.lit(True).alias("paid")), follow)["paid"]
        return F.struct(p.alias("p"), (~paid & (p["marks"] > 0)).alias("lost"))

    out = rows.select(F.explode(F.transform("ps", judged)).alias("x")).select("x.p.*", F.col("x.lost").alias("__lost"))
    return out.withColumn("rule", F.when(F.col("__lost"), "R-DEPENDENCY").otherwise(F.col("rule"))).withColumn("marks", F.when(F.col("__lost"), 0.0).otherwise(F.col("marks"))).drop("__lost")


def group_caps(points: DataFrame) -> DataFrame:
    """The most confident awards of a group stay, up to its cap, ties by code. A group without a cap, or one whose points
    are marked ``group_exclusive``, keeps one."""
    by = W.partitionBy("script", "question", "group_id", F.col("marks") > 0).orderBy(F.col("confidence").desc(), "code")
    exclusive = F.coalesce("group_exclusive", F.lit(False)) if "group_exclusive" in points.columns else F.lit(False)
    cap = F.when(exclusive, 1).otherwise(F.coalesce("group_max", F.lit(1)))
    over = F.col("group_id").isNotNull() & (F.col("marks") > 0) & (F.row_number().over(by) > cap)
    rule = F.when(F.col("__over"), F.when(exclusive, "R-GROUP-EXCLUSIVE").otherwise("R-GROUP-CAP")).otherwise(F.col("rule"))
    return points.withColumn("__over", over).withColumn("rule", rule).withColumn("marks", F.when(F.col("__over"), 0.0).otherwise(F.col("marks"))).drop("__over")


def half_up(x: Column, step: float) -> Column:
    """To the nearest step, halves away from 0."""
    return F.signum(x) * F.floor(F.abs(x) / step + 0.5) * step


def question_scores(points: DataFrame, step: float = POLICY["round_to"], negative_allowed: bool = False) -> DataFrame:
    """(script, question, raw, max_marks, marks, confidence, withheld, trace): capped, rounded once, at the end.

    The cap is the question's own maximum, ``question_max``, which alternatives may exceed in sum; without that column it is the
    sum of the points' maxima. A total below 0 counts as 0 unless ``negative_allowed``. Confidence is 1 less the
    share of points withheld, less a penalty for each contradicted point and each group that dropped awards, 0 at least. ``trace`` lists
    every point's last rule and marks in the order of codes; ``decision_trace`` has the steps.
    """
    most = F.max("question_max") if "question_max" in points.columns else F.sum("max_marks")
    rule = F.col("rule")
    withheld = F.count_if(rule.isin(*WITHHELD))
    contradicted = F.count_if(rule.isin("R-CONTRADICTED-ZERO", "R-CONTRADICTION-PENALTY"))
    caps = F.count_distinct(F.when(rule.isin(*CAPPED), F.col("group_id"))) if "group_id" in points.columns else F.lit(0)
    sure = F.greatest(1 - withheld / F.count("*") - CONTRADICTION_PENALTY * contradicted - CAP_PENALTY * caps, F.lit(0.0))
    trace = F.array_sort(F.collect_list(F.struct("code", "rule", "marks")))  # a question's points: a rubric's size
    out = points.groupBy("script", "question").agg(F.sum("marks").alias("raw"), most.alias("max_marks"), sure.alias("confidence"), withheld.alias("withheld"), trace.alias("trace"))
    capped = F.least("raw", "max_marks")
    capped = capped if negative_allowed else F.greatest(capped, F.lit(0.0))
    return out.withColumn("marks", F.least(half_up(capped, step), F.col("max_marks")))


def decision_trace(points: DataFrame, step: float = POLICY["round_to"], negative_allowed: bool = False) -> DataFrame:
    """(script, question, trace, withheld, caps): every step of every phase that decided a question's marks, in order.

    Points come from ``awards``, ``dependencies`` and ``group_caps``. Steps are (step, phase, rule, point, group, verdict, confidence,
    awarded, cap, dropped, before, after), what a step doesn't have being null: each point's award by code, points that lost
    theirs to a dependency, groups that dropped awards, the question's cap, the floor at 0 where it held, and rounding. ``withheld`` has
    (point, reason, would_have_been), ``caps`` the names of caps that held.
    """
    kind = "struct<phase:int,rule:string,point:string,grp:string,verdict:string,confidence:double,awarded:int,cap:double,dropped:array<string>,before:double,after:double>"
    none = F.lit(None)

    def entry(phase: int, rule: Value, point=none, group=none, verdict=none, confidence=none, awarded=none, cap=none, dropped=none, before=none, after=none) -> Column:
        return F.struct(F.lit(phase), as_column(rule), point, group, verdict, confidence, awarded, cap, dropped, before, after).cast(kind)

    wanted = ["code", "max_marks", "verdict", "confidence", "first_rule", "first_marks", "would_be", "rule", "marks"]
    grouped = [F.col(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in ("group_id", "group_max")]
    most = F.max("question_max") if "question_max" in points.columns else F.sum("max_marks")
    rows = points.groupBy("script", "question").agg(F.array_sort(F.collect_list(F.struct(*wanted, *grouped))).alias("ps"), F.sum("marks").alias("raw"), most.alias("most"))  # a rubric's points
    lost = lambda p: p["rule"] == "R-DEPENDENCY"
    dropped = lambda p: p["rule"].isin(*CAPPED)
    ids = F.array_sort(F.array_distinct(F.transform(F.filter("ps", dropped), lambda p: p["group_id"])))

    def of_group(g: Column) -> Column:
        own = F.filter("ps", lambda p: (p["group_id"] == g) & ((p["marks"] > 0) | dropped(p)))
        out = F.filter(own, dropped)
        cap = F.when(out[0]["rule"] == "R-GROUP-EXCLUSIVE", F.lit(1.0)).otherwise(F.coalesce(out[0]["group_max"].cast("double"), F.lit(1.0)))
        return entry(3, out[0]["rule"], group=g.cast("string"), awarded=F.size(own), cap=cap, dropped=F.transform(out, lambda p: p["code"].cast("string")))

    top = F.least("raw", "most")
    end = top if negative_allowed else F.greatest(top, F.lit(0.0))
    floor = F.array().cast(f"array<{kind}>") if negative_allowed else F.when(top < 0, F.array(entry(4, "R-NEGATIVE-FLOOR", before=top, after=F.lit(0.0)))).otherwise(F.array().cast(f"array<{kind}>"))
    steps = F.concat(
        F.transform("ps", lambda p: entry(1, p["first_rule"], p["code"], verdict=p["verdict"], confidence=p["confidence"], after=p["first_marks"])),
        F.transform(F.filter("ps", lost), lambda p: entry(2, p["rule"], p["code"], before=p["first_marks"], after=F.lit(0.0))),
        F.transform(ids, of_group),
        F.array(entry(4, "R-QUESTION-CAP", cap=F.col("most"), before=F.col("raw"), after=top)),
        floor,
        F.array(entry(4, "R-ROUNDING", before=end, after=F.least(half_up(end, step), F.col("most")))),
    )
    numbered = F.transform(steps, lambda x, i: F.struct((i + 1).alias("step"), *(x[c].alias(c) for c in ("phase", "rule", "point", "grp", "verdict", "confidence", "awarded", "cap", "dropped", "before", "after"))))
    withheld = F.transform(F.filter("ps", lambda p: p["first_rule"].isin(*WITHHELD)), lambda p: F.struct(p["code"].alias("point"), F.lit("CONFIDENCE_BELOW_FLOOR").alias("reason"), p["would_be"].alias("would_have_been")))
    caps = F.transform(F.filter("trace", lambda x: x["phase"] == 3), lambda x: F.concat(F.lit("GROUP_"), x["grp"], F.lit("_MAX_"), x["cap"].cast("int").cast("string"), F.lit("_AWARDS")))
    return rows.select("script", "question", numbered.alias("trace"), withheld.alias("withheld")).withColumn("caps", caps)


def route(overall: Column, ocr: Column, unverifiable: Value = False, degraded: Value = False, unmatched: Value = False, withheld: Value = False, contradicted: Value = False, auto: Value = POLICY["auto_suggest_threshold"], manual: Value = POLICY["manual_only_threshold"]) -> Column:
    """Who sees the marks, and how: nobody before marking by hand, with a confirmation for each point, or as a suggestion.

    By hand: any unverifiable point, a degraded image, unmatched content, or a reading or an overall confidence below
    ``manual`` or missing. Confirmed: below ``auto``, which never is below the platform's, withheld awards or contradictions.
    """
    yes = lambda x: F.coalesce(as_column(x), F.lit(False))
    by_hand = yes(unverifiable) | yes(degraded) | yes(unmatched) | ~yes(ocr >= as_column(manual)) | ~yes(overall >= as_column(manual))
    review = (overall < F.greatest(as_column(auto), F.lit(PLATFORM_AUTO_SUGGEST))) | yes(withheld) | yes(contradicted)
    return F.when(by_hand, "MANUAL_ONLY").when(review, "MANUAL_REVIEW").otherwise("AUTO_SUGGEST")


#: A number that no letter, digit or point comes before (so not the 2 of "Q2"), with an exponent if it has one, and the unit after it.
NUMBER = r"(?:^|[^A-Za-z0-9_.])([-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\x20*([A-Za-z°%µμΩ][A-Za-z0-9°%µμΩ/^*·²³-]*)?"


def plain_unit(unit: Column) -> Column:
    """One spelling of a unit: no blanks, the micro sign, and powers behind a caret."""
    spaced = F.regexp_replace(F.coalesce(unit, F.lit("")), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(F.translate(spaced, "μ·", "µ*"), "²", "^2"), "³", "^3")


def numeric_match(answer: Column, value: Column, unit: Column, tolerance: Column) -> Column:
    """(rule, matched): an answer's number against ``value`` within a relative tolerance, and its unit.

    The number is the last one that has the unit asked for, else the last one. R-NUMERIC-UNIT: another unit, or none;
    R-NUMERIC-VALUE: outside the tolerance; R-NUMERIC-ABSENT: no number. Without a unit asked for, what follows the number doesn't matter.
    """
    found = F.zip_with(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(2)), lambda n, u: F.struct(n.cast("double").alias("n"), plain_unit(u).alias("u")))
    wanted = plain_unit(unit)
    fits = F.filter(found, lambda x: (wanted == "") | (x["u"] == wanted))
    given = F.try_element_at(F.when(F.size(fits) > 0, fits).otherwise(found), F.lit(-1))
    rule = F.when(given.isNull(), "R-NUMERIC-ABSENT").when((wanted != "") & (given["u"] != wanted), "R-NUMERIC-UNIT").when(F.abs(given["n"] - value) <= tolerance * F.abs(value), "R-NUMERIC-MATCH").otherwise("R-NUMERIC-VALUE")
    return F.struct(rule.alias("rule"), (rule == "R-NUMERIC-MATCH").alias("matched"))


def short_match(answer: Column, accepted: Column) -> Column:
    """(rule, matched): an answer against a list of accepted ones, whatever the case and blanks.

    One edit for each full eight characters of an accepted answer passes as a misreading, unless another accepted answer is as near.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    own, options = plain(answer), F.array_distinct(F.transform(accepted, plain))
    near = F.filter(options, lambda e: F.levenshtein(own, e) <= F.floor(F.length(e) / 8))
    rule = F.when(F.array_contains(options, own), "R-SHORT-EXACT").when(F.size(near) == 1, "R-SHORT-NEAR").when(F.size(near) > 1, "R-SHORT-AMBIGUOUS").otherwise("R-SHORT-NONE")
    return F.struct(rule.alias("rule"), rule.isin("R-SHORT-EXACT", "R-SHORT-NEAR").alias("matched"))


def list_match(given: Column, expected: Column) -> Column:
    """How many of the expected items were named."""
    return F.size(F.array_intersect(given, expected))
