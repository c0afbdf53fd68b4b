"""URL filters: rules on host and path first, then trust and distrust over the link graph of hosts.

DataFrame operations only. Links in a page's html make host edges, one row for each pair of hosts. Trusted
seeds are hosts by the share of their pages that an allow rule takes, blocked seeds by the share that a block
rule takes. Trust is personalised PageRank from the trusted seeds: a host passes the damped score on over its out-links, by their
numbers. Distrust is the same from the blocked seeds over reversed links. Such scores shrink with the number of a seed's
links, so each host has a threshold of its own: its score over links is measured in what they would bring if the hosts at
their other ends were full seeds that nothing else reaches, 1 at most. A host that links to blocked hosts only has a distrust of 1 however many others link
to them; further on, scores stay as PageRank splits them. A host's trust and distrust are the greater of its own seed and that measure. Rounds go on until no
measure changes by more than ``tolerance``, ``ROUNDS`` at most, after which 0.85 ** 48 = 0.04 per cent of any walk is left. A page without a rule is blocked if
its host's distrust exceeds its trust by ``threshold``, less ``SLACK``, so that a difference of just the threshold counts as one.

A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the scores of the
empty host, which has no seed and no links: it is allowed. Null html has no links. Repeated rows each count
and are each judged; other columns are ignored. Urls and html of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.places import kept

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 48
TOLERANCE = 1e-6
#: More than what rounds leave of a measure.
SLACK = 1e-3
CUT_EVERY = 4
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\s\"'>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path in one string; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [F.when(((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]), r[1] + r[2]) for r in longest]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*(F.when(rule == r[1] + r[2], r[0]) for r in rules), F.lit(None).cast("string"))


def judged_by_rule(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, rule_verdict)."""
    parts = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    named = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return named.withColumn("rule_verdict", verdict_of(F.col("rule"), rules))


def host_edges(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts; counted before the shuffle."""
    targets = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    links = df.select(host_of(F.col(url)).alias("src"), targets.alias("target"))
    links = links.select("src", F.translate("target", UPPER, LOWER).alias("dst"))
    return links.filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, links)."""
    out = edges.groupBy("src").agg(F.sum("links").alias("all")).withColumnRenamed("src", "origin")
    back = edges.groupBy("dst").agg(F.sum("links").alias("all")).withColumnRenamed("dst", "origin")
    # Shares of all links of the host that passes its score on.
    forth = edges.join(out, edges.src == out.origin).select(F.lit("trust").alias("kind"), "src", "dst", (F.col("links") / F.col("all")).alias("share"))
    against = edges.join(back, edges.dst == back.origin).select(F.lit("distrust"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("links") / F.col("all"))
    ways = kept(forth.union(against), "ways")
    hosts = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)"))
    ends = ways.select(F.explode(F.array("src", "dst")).alias("host"), "kind", F.lit(0.0).alias("seed"))
    full = ways.groupBy("kind", F.col("dst").alias("host")).agg((F.sum("share") * (damping * (1 - damping))).alias("full"))
    state = hosts.union(ends).groupBy("host", "kind").agg(F.sum("seed").alias("seed")).join(full, ["kind", "host"], "left")
    state = kept(state.select("host", "kind", "seed", "full", ((1 - damping) * F.col("seed")).alias("score"), F.lit(0.0).alias("part")), "hosts")
    moving, done = not ways.isEmpty(), 0
    while moving and done < rounds:
        for _ in range(min(CUT_EVERY, rounds - done)):
            sent = state.select("kind", F.col("host").alias("src"), "score").filter("score > 0").join(ways, ["kind", "src"])
            got = sent.groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("got"))
            part = F.least(F.coalesce(F.col("got") / F.col("full"), F.lit(0.0)), F.lit(1.0))
            score = (1 - damping) * F.col("seed") + F.coalesce("got", F.lit(0.0))
            state = state.join(got, ["kind", "host"], "left").select("host", "kind", "seed", "full", score.alias("score"), part.alias("part"), F.abs(part - F.col("part")).alias("change"))
            done += 1
        state = kept(state, "hosts")
        moving = state.filter(F.col("change") > tolerance).limit(1).count() > 0
    one = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.greatest("seed", "part"))), F.lit(0.0)).alias(kind)
    return state.groupBy("host").agg(one("trust"), one("distrust"))


def judge(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every row."""
    pages = judged_by_rule(df, key, url, rules)
    share = lambda v: F.avg((F.coalesce(F.col("rule_verdict"), F.lit("")) == v).cast("double"))
    seeds = pages.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(df, url, html))
    own = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold - SLACK, "block").otherwise("allow")
    return pages.join(scores, "host", "left").select(key, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "trust", "distrust")


def op9_hosts(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    steps = [
        f"s{k} AS MATERIALIZED (SELECT s.host, s.kind, s.seed, s.brings, {1 - DAMPING}::DOUBLE * s.seed + coalesce(got, 0.0) AS score, least(coalesce(got / s.brings, 0.0), 1.0) AS part FROM s{k - 1} s LEFT JOIN (SELECT w.kind, w.dst, sum(b.score * w.share) * {DAMPING}::DOUBLE AS got FROM ways w JOIN s{k - 1} b ON b.host = w.src AND b.kind = w.kind GROUP BY w.kind, w.dst) g ON g.dst = s.host AND g.kind = s.kind)"
        for k in range(1, ROUNDS + 1)
    ]
    return f"""
WITH parts AS (SELECT CAST(page_id AS BIGINT) AS page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts),
judged AS (SELECT *, CASE rule {verdicts} END AS rule_verdict FROM ruled),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?(?:https?:)?//([^/?#\\s"''>]+)', 1)), '{UPPER}', '{LOWER}') AS dst FROM judged),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> dst AND src <> '' GROUP BY ALL),
ways AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst, links / sum(links) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT host, avg((coalesce(rule_verdict, '') = 'allow')::INT) AS trust, avg((coalesce(rule_verdict, '') = 'block')::INT) AS distrust FROM judged WHERE host <> '' GROUP BY host),
s0 AS (SELECT host, kind, seed, brings, {1 - DAMPING}::DOUBLE * seed AS score, 0.0::DOUBLE AS part FROM (SELECT host, kind, sum(seed) AS seed FROM (
    SELECT host, 'trust' AS kind, trust AS seed FROM seeds UNION ALL SELECT host, 'distrust', distrust FROM seeds UNION ALL SELECT dst, kind, 0.0 FROM ways UNION ALL SELECT src, kind, 0.0 FROM ways) GROUP BY host, kind)
  LEFT JOIN (SELECT kind, dst AS host, sum(share) * {DAMPING * (1 - DAMPING)}::DOUBLE AS brings FROM ways GROUP BY ALL) USING (host, kind)),
{", ".join(steps)},
scores AS (SELECT host, coalesce(max(greatest(seed, part)) FILTER (kind = 'distrust'), 0.0) - coalesce(max(greatest(seed, part)) FILTER (kind = 'trust'), 0.0) AS gap FROM s{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN coalesce(gap, 0.0) >= {THRESHOLD - SLACK}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)"""


OP9_SQL = _sql()


