"""Reconciliation, alignment and results on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import alignment, reconcile as rec, results
from assayer.session import table
from assayer.streaming import windows


def tier2_trigger(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select(F.col("conv_id").alias("page"), F.col("turn").alias("line"), "text", (F.lit(0.8) + F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(20)) / 100).alias("confidence"), (F.pmod("conv_id", F.lit(5)) / 10).alias("spread"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) == 0).alias("near_miss"), (F.col("role") == "system").alias("struck"))
    return rec.tier2(lines).groupBy(F.concat_ws(",", "red").alias("red"), "sent").agg(F.count("*").alias("n"))


def reconcile(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("turn", "conv_id", F.col("text").alias("a"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    b = F.when(kind == 0, F.replace(F.col("a"), F.lit(" "), F.lit("  "))).when(kind == 1, F.translate("a", "q,", "g.")).when(kind == 2, F.translate("a", "aeh", "oui")).when(kind == 3, F.reverse("a")).otherwise("unreadable ")
    rows = turns.select(rec.reconcile(F.col("a"), b).alias("r"))
    return rows.groupBy("r.source", "r.flag").agg(F.count("*").alias("n"), F.round(F.sum("r.confidence"), 6).alias("confidence"), F.sum(F.coalesce(F.length("r.text"), F.lit(0))).alias("chars"))


def rebuilt_lines(spark, sf_dir):
    """Words of benchmark items, laid out ten to a line with a slight slant."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("i", "word"))
    placed = words.select("page", "word", (F.pmod("i", F.lit(10)) * 40).alias("x"), (F.floor(F.col("i") / 10) * 30 + F.pmod("i", F.lit(10)) * 0.25).alias("y"), F.lit(30).alias("w"), F.lit(20.0).alias("h"))
    return rec.rebuild_lines(placed)


def lexicon_misses(spark, sf_dir):
    """Words of benchmark items one or two edits from a region's or nation's name."""
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.explode(F.split(F.lower("p_type"), " ")).alias("token"))
    terms = table(spark, sf_dir, "part").select(F.explode(F.split(F.translate(F.lower("p_type"), "ao", "ue"), " ")).alias("term")).distinct()
    return rec.near_misses(tokens, terms).groupBy("token", "term").agg(F.count("*").alias("n"))


def sentence_segments(spark, sf_dir):
    return rec.sentences(table(spark, sf_dir, "documents"), "doc_id", most=None).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size(F.split("sentence", " "))).alias("tokens"))


def _units(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    points = alignment.unit_mean(e.select(F.col("label").cast("long").alias("question"), F.pmod("vec_id", F.lit(3)).alias("point"), "embedding"), ["question", "point"], "embedding")
    return e.select(F.col("label").cast("long").alias("question"), F.col("vec_id").alias("sentence"), F.col("embedding").alias("vector")), points


def topk_cosine(spark, sf_dir):
    return alignment.candidates(*_units(spark, sf_dir)).select("question", "point", "sentence", "place")


def assignment(spark, sf_dir):
    """Each question's three points against their best sentences; the total is unique where the pairs aren't."""
    found = alignment.candidates(*_units(spark, sf_dir))
    return alignment.assign(found.select(F.col("question").alias("grp"), "point", "sentence", F.col("cosine").alias("score"))).groupBy("grp").agg(F.count("*").alias("pairs"), F.round(F.sum("score"), 5).alias("total"))


def unmatched_content(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("sentence"), (1 - F.pmod("turn", F.lit(4)) / 10).alias("confidence"))
    matched = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn")
    return alignment.unmatched(turns, matched, ["conv_id", "turn"]).select("conv_id", "turn")


def entailment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = alignment.decide(1 - F.col("l_discount") * 2, F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")))
    return li.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


def results_pivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("script"), F.col("l_linenumber").alias("question"), F.col("l_quantity").alias("marks"))
    wide = results.results_pivot(li, [1, 2, 3, 4, 5, 6, 7])
    return wide.select("script", *(F.col(str(i)).alias(f"q{i}") for i in range(1, 8)), "total")


def result_statistics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("most", F.lit(50.0))
    return results.statistics(li, ["l_linenumber"], "l_quantity", "most")


def discrimination(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").alias("item"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("total"))
    return results.discrimination(li, ["l_linenumber"], "item", "total")


def histogram(spark, sf_dir):
    return results.histogram(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 10)


def calibration_bins(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = labels.select((F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), "quality")
    return results.calibration_bins(scored, "score", "quality")


def calibration_threshold(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return results.best_threshold(labels.select((F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), "quality"), "score", "quality")


def data_split(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(results.split_of(F.col("doc_id")).alias("part")).agg(F.count("*").alias("n"))


def calibrated_scores(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = labels.select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), "quality")
    return results.isotonic(rows, "score", "quality").select("doc_id", "score", "calibrated")


def override_rates(spark, sf_dir):
    return results.override_rates(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", 0.25)


def override_drift(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return results.drift(li, "l_suppkey", F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("l_returnflag") == "R")


def moderation(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("total"), (F.col("o_orderstatus") == "P").alias("overridden"))
    return results.moderation(scores, "o_orderkey", [40.0, 70.0, 100.0], 2.0, 10).select("o_orderkey", "why")


def marker_differences(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 100).alias("a"), F.rint(F.col("s_acctbal") / 150).alias("b"))
    return results.largest_differences(s, "a", "b", ["s_suppkey"])


def latest_versions(spark, sf_dir):
    """Each order supersedes its customer's next one, where there is one."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    o = o.withColumn("superseded_by", F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return results.latest_versions(o, "o_orderkey", "superseded_by").select("o_orderkey", "o_custkey")


def script_timeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("script"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("note"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("script"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("note"))
    return results.timeline({"received": o, "marked": li})


def duplicate_answers(spark, sf_dir):
    return results.identical_answers(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def worker_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("depth")).withColumn("workers", results.workers(F.col("depth") / 10))


def retention(spark, sf_dir):
    return results.retention(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("2001-06-01").cast("date"))


def usage(spark, sf_dir):
    return results.usage(table(spark, sf_dir, "events"), ["event_type"], "value")


def event_windows(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def struck_lines(spark, sf_dir):
    """Line items as horizontal runs in boxes of 40 by 30 pixels."""
    li = table(spark, sf_dir, "lineitem")
    box = F.struct(F.lit(10).alias("x"), F.lit(100).alias("y"), F.lit(40).alias("w"), F.lit(30).alias("h"))
    struck = rec.struck_through(F.pmod("l_partkey", F.lit(20)), 100 + F.pmod("l_suppkey", F.lit(30)), F.col("l_quantity"), F.col("l_linenumber"), box)
    return li.groupBy("l_linenumber").agg(F.count_if(struck).alias("struck"), F.count("*").alias("n"))


def joined_answers(spark, sf_dir):
    """Turns of a conversation as an answer's lines; what the system says is struck out."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line"), "text", (F.col("role") == "system").alias("struck"))
    return rec.joined_lines(lines, "conv_id")


def expanded_words(spark, sf_dir):
    words = rec.expand(F.split(F.lower("p_type"), " "), F.create_map(*(F.lit(x) for x in ("promo", "promotional", "std", "standard", "economy", "low cost"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


def pair_evidence(spark, sf_dir):
    """Consecutive sentences as evidence beside single ones."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("long").alias("question"), F.col("label").alias("answer"), F.col("vec_id").alias("nth"), F.col("vec_id").alias("sentence"), F.col("embedding").alias("vector"))
    pairs = alignment.neighbours(rows).select("question", F.col("first").alias("sentence"), "vector")
    return alignment.candidates(pairs, _units(spark, sf_dir)[1], k=3).select("question", "point", "sentence", "place")


def shared_assignment(spark, sf_dir):
    """As ``assignment``, but a question's first point shares its evidence."""
    found = alignment.candidates(*_units(spark, sf_dir))
    scores = found.select(F.col("question").alias("grp"), "point", "sentence", F.col("cosine").alias("score"), (F.col("point") == 0).alias("shared"))
    return alignment.assign(scores).filter("point = 0").select("grp", "sentence")


def misplaced_answers(spark, sf_dir):
    """Embeddings as answers to their label's question, against all prompts."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("question"), "embedding")
    prompts = alignment.unit_mean(e, ["question"], "embedding").select(F.col("question").alias("prompt"), F.col("vector").alias("p"))
    from assayer.functions import stats

    both = e.crossJoin(F.broadcast(prompts))  # an exam's prompts, one for each label
    scored = both.select(F.col("vec_id").alias("answer"), "question", "prompt", stats.dot(F.col("embedding"), F.col("p")).alias("similarity"))
    return results.misplaced(scored).select("answer", "question", "best")


def platt_scores(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return results.platt(labels.select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"), "quality"), "score", "quality").select("doc_id", "score", "quality", "calibrated")


def sampled_scripts(spark, sf_dir):
    return results.sampled(table(spark, sf_dir, "orders"), "o_orderkey", 10).select("o_orderkey")


def dashboard_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return results.where(o, {"o_orderstatus": ["F", "O"]}, {"o_totalprice": (1000.0, 50000.0), "o_orderkey": (10, None)}).select("o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (tier2_trigger, reconcile, rebuilt_lines, lexicon_misses, sentence_segments, topk_cosine, assignment, unmatched_content, entailment, results_pivot, result_statistics, discrimination, histogram, calibration_bins, calibration_threshold, data_split, calibrated_scores, override_rates, override_drift, moderation, marker_differences, latest_versions, script_timeline, duplicate_answers, worker_count, retention, usage, event_windows, event_sessions, struck_lines, joined_answers, expanded_words, pair_evidence, shared_assignment, misplaced_answers, platt_scores, sampled_scripts, dashboard_filter)
}
_SCORE = "scored AS (SELECT quality, doc_id, n_chars / (n_chars + 2000)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
SQL = {
    "tier2_trigger": r"""WITH l AS (SELECT conv_id AS page, turn AS line, 0.8::DOUBLE + ((turn * 7 + conv_id) % 20) / 100 AS confidence, list_filter([CASE WHEN 0.8::DOUBLE + ((turn * 7 + conv_id) % 20) / 100 < 0.88::DOUBLE THEN 'LOW' END, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'LEXICON' END, CASE WHEN regexp_matches(text, '[0-9]|[%°µ=+<>]') THEN 'NUMERAL' END, CASE WHEN role = 'system' THEN 'STRUCK' END, CASE WHEN (conv_id % 5) / 10 > 0.25::DOUBLE THEN 'SPREAD' END,
    CASE WHEN regexp_matches(text, '(?i)ignore\s+(all\s+)?previous|system\s+note|award\s+full\s+marks|you\s+are\s+now|disregard\s+the\b|new\s+instructions|\b(assistant|system):|[#=*%$&<>{}|~^@\\]{6,}') THEN 'INJECTION' END], lambda r: r IS NOT NULL) AS red FROM conversations)
SELECT array_to_string(red, ',') AS red, len(red) > 0 AND nth <= 30 AS sent, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page, len(red) > 0 ORDER BY confidence, line) AS nth FROM l) GROUP BY 1, 2""",
    "rebuilt_lines": r"""SELECT page, line::BIGINT AS line, string_agg(word, ' ' ORDER BY x, word) AS text, count(*)::INTEGER AS n_words FROM (SELECT item_id AS page, unnest(ws) AS word, (unnest(range(0, len(ws))) // 10) AS line, unnest(range(0, len(ws))) % 10 AS x FROM (SELECT item_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS ws FROM benchmark)) GROUP BY 1, 2""",
    "lexicon_misses": """WITH t AS (SELECT unnest(string_split(lower(p_type), ' ')) AS token FROM part), l AS (SELECT DISTINCT unnest(string_split(translate(lower(p_type), 'ao', 'ue'), ' ')) AS term FROM part), c AS (SELECT p_partkey, token FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_type), ' ')) AS token FROM part))
SELECT token, term, count(*) AS n FROM c JOIN l ON levenshtein(token, term) BETWEEN 1 AND 2 WHERE token NOT IN (SELECT term FROM l) GROUP BY 1, 2""",
    "unmatched_content": r"SELECT conv_id, turn FROM conversations WHERE role <> 'user' AND 1 - (turn % 4) / 10 > 0.8::DOUBLE AND len(regexp_split_to_array(trim(text), '\s+')) > 12",
    "entailment": "SELECT CASE WHEN 1 - l_discount * 2 >= 0.85::DOUBLE THEN l_returnflag WHEN l_linestatus = 'O' THEN 'O' ELSE 'UNVERIFIABLE' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1",
    "topk_cosine": """WITH cells AS (SELECT label, vec_id % 3 AS point, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, point, i, avg(x) AS x FROM cells GROUP BY ALL), p AS (SELECT label, point, list(x ORDER BY i) AS v FROM m GROUP BY ALL),
s AS (SELECT e.label::BIGINT AS question, p.point, e.vec_id AS sentence, list_cosine_similarity(e.embedding::DOUBLE[], p.v) AS cosine FROM embeddings e JOIN p USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY question, point ORDER BY cosine DESC, sentence)::INTEGER AS place FROM s WHERE cosine >= 0.25)
SELECT question, point, sentence, place FROM r WHERE place <= 5""",
    "results_pivot": "SELECT l_orderkey AS script, " + ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {i}) AS q{i}" for i in range(1, 8)) + ", sum(l_quantity) AS total FROM lineitem GROUP BY 1",
    "result_statistics": "SELECT l_linenumber, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(avg(l_quantity / 50), 6) AS difficulty, round(avg((l_quantity >= 25)::INT), 6) AS pass_rate FROM lineitem GROUP BY 1",
    "discrimination": "SELECT l_linenumber, round(corr(l_quantity, l_quantity + l_discount * 100 - l_quantity), 6) AS discrimination FROM lineitem GROUP BY 1",
    "histogram": "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 11 ELSE floor(value / 50) + 1 END::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1",
    "calibration_bins": f"WITH {_SCORE} SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(quality), 6) AS actual FROM scored GROUP BY 1",
    "calibration_threshold": f"""WITH {_SCORE}, r AS (SELECT score AS threshold, sum(quality) AS good, sum(1 - quality) AS bad FROM scored GROUP BY 1)
SELECT threshold, (coalesce(sum(good) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 * sum(bad) OVER (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS cost FROM r ORDER BY cost, threshold LIMIT 1""",
    "override_rates": "SELECT l_suppkey, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS rate, avg((l_returnflag = 'R')::INT) > 0.25 AS too_many FROM lineitem GROUP BY 1",
    "override_drift": """SELECT l_suppkey, round(b, 6) AS baseline, round(l, 6) AS latest, coalesce(l > b * 1.5, FALSE) AS drifted FROM (SELECT l_suppkey, avg((l_returnflag = 'R')::INT) FILTER (l_shipdate < '1996-01-01') AS b, avg((l_returnflag = 'R')::INT) FILTER (l_shipdate >= '1996-01-01') AS l FROM lineitem GROUP BY 1)""",
    "marker_differences": "SELECT s_suppkey, a, b, abs(a - b) AS difference FROM (SELECT s_suppkey, round(s_acctbal / 100) AS a, round_even(s_acctbal / 150, 0) AS b FROM supplier) WHERE a <> b",
    "latest_versions": "SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey",
    "script_timeline": "SELECT o_orderkey AS script, o_orderdate AS at, 'received' AS kind, o_orderstatus AS note FROM orders UNION ALL SELECT l_orderkey, l_shipdate, 'marked', l_linenumber::VARCHAR FROM lineitem",
    "duplicate_answers": r"SELECT md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "worker_count": "SELECT event_type, count(*) AS depth, least(greatest(ceil(count(*) / 10 / 40), 1), 20)::BIGINT AS workers FROM events GROUP BY 1",
    "retention": "SELECT CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2001-06-01') > 2555 THEN 'PURGE_MARKS' WHEN date_diff('day', o_orderdate::DATE, DATE '2001-06-01') > 180 THEN 'PURGE_IMAGES' ELSE 'KEEP' END AS action, count(*) AS n FROM orders GROUP BY 1",
    "usage": "SELECT event_type, count(*) AS calls, round(sum(value), 6) AS cost FROM events GROUP BY 1",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
}

_CELLS = "cells AS (SELECT label, vec_id % 3 AS point, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, point, i, avg(x) AS x FROM cells GROUP BY ALL), p AS (SELECT label, point, list(x ORDER BY i) AS v FROM m GROUP BY ALL)"
_FOLD = "trim(regexp_replace(translate(lower({c}), '‘’“”–—', chr(39) || chr(39) || '\"\"--'), '\\s+', ' ', 'g'))"
_CODE = "array_to_string(list_transform(string_split({c}, ''), lambda c: chr((32 + list_position(cs, c))::INTEGER)), '')"
SQL |= {
    "reconcile": f"""WITH t AS (SELECT text AS a, (conv_id + turn) % 5 AS kind FROM conversations), u AS (SELECT *, CASE kind WHEN 0 THEN replace(a, ' ', '  ') WHEN 1 THEN translate(a, 'q,', 'g.') WHEN 2 THEN translate(a, 'aeh', 'oui') WHEN 3 THEN array_to_string(list_reverse(string_split(a, '')), '') ELSE 'unreadable ' END AS b FROM t),
f AS (SELECT *, {_FOLD.format(c='a')} AS fa, {_FOLD.format(c='b')} AS fb FROM u), d AS (SELECT *, list_distinct(string_split(fa || fb, '')) AS cs FROM f),
e AS (SELECT *, levenshtein({_CODE.format(c='fa')}, {_CODE.format(c='fb')}) AS e, greatest(length(fa), length(fb)) AS longer FROM d),
s AS (SELECT *, CASE WHEN kind = 4 THEN 'UNRESOLVED' WHEN fa = fb THEN 'ARBITRATED' WHEN (longer - e) * 100 >= 92 * longer THEN 'TIER2' WHEN (longer - e) * 100 >= 70 * longer THEN 'BOTH' ELSE 'UNRESOLVED' END AS source FROM e)
SELECT source, CASE source WHEN 'UNRESOLVED' THEN 'NEEDS_HUMAN' WHEN 'BOTH' THEN 'AMBIGUOUS' END AS flag, count(*) AS n, round(sum(CASE source WHEN 'ARBITRATED' THEN 0.95 WHEN 'TIER2' THEN 0.88 WHEN 'BOTH' THEN 0.60 ELSE 0.0 END::DOUBLE), 6) AS confidence,
  sum(CASE source WHEN 'ARBITRATED' THEN length(a) WHEN 'TIER2' THEN length(b) WHEN 'BOTH' THEN length(a) + 3 + length(b) ELSE 0 END)::BIGINT AS chars FROM s GROUP BY 1, 2""",
    "struck_lines": """SELECT l_linenumber, count(*) FILTER ((least(x + w, 50) - greatest(x, 10)) * 10 >= 240 AND l_linenumber BETWEEN 1 AND 4 AND y * 10 BETWEEN 90 AND 210) AS struck, count(*) AS n FROM (SELECT l_linenumber, l_partkey % 20 AS x, l_suppkey % 30 AS y, l_quantity AS w FROM lineitem) GROUP BY 1""",
    "joined_answers": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role <> 'system' GROUP BY 1",
    "expanded_words": "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: CASE w WHEN 'promo' THEN 'promotional' WHEN 'std' THEN 'standard' WHEN 'economy' THEN 'low cost' ELSE w END), ' ') AS words FROM part",
    "pair_evidence": f"""WITH {_CELLS}, n AS (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
e AS (SELECT label, vec_id, list_transform(list_zip(embedding, w), lambda z: (z[1]::DOUBLE + z[2]::DOUBLE) / 2) AS v FROM n WHERE w IS NOT NULL),
s AS (SELECT e.label::BIGINT AS question, p.point, e.vec_id AS sentence, list_cosine_similarity(e.v, p.v) AS cosine FROM e JOIN p USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY question, point ORDER BY cosine DESC, sentence)::INTEGER AS place FROM s WHERE cosine >= 0.25) SELECT question, point, sentence, place FROM r WHERE place <= 3""",
    "shared_assignment": f"""WITH {_CELLS}, s AS (SELECT e.label::BIGINT AS grp, e.vec_id AS sentence, list_cosine_similarity(e.embedding::DOUBLE[], p.v) AS cosine FROM embeddings e JOIN p USING (label) WHERE p.point = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cosine DESC, sentence) AS place FROM s WHERE cosine >= 0.25) SELECT grp, sentence FROM r WHERE place = 1""",
    "misplaced_answers": """WITH cells AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY 1), p AS (SELECT m.label, list(x / size ORDER BY i) AS v FROM m JOIN z USING (label) GROUP BY 1),
s AS (SELECT e.vec_id AS answer, e.label AS question, p.label AS prompt, list_dot_product(e.embedding::DOUBLE[], p.v) AS sim FROM embeddings e, p),
o AS (SELECT answer, question, max(sim) FILTER (prompt = question) AS own, arg_max(prompt, sim) FILTER (prompt <> question) AS best, max(sim) FILTER (prompt <> question) AS other FROM s GROUP BY ALL)
SELECT answer, question::BIGINT AS question, best::BIGINT AS best FROM o WHERE other > own""",
    "dashboard_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey >= 10",
}
