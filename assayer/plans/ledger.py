"""Audit chains, state histories, recognition calls and tenancy on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import audit, recognition, results, states, tenancy
from assayer.session import table


def _log(spark, sf_dir):
    """Events as an audit log: a user is a tenant, and each row has its canonical payload."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("tenant_id"), F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.lit("event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.col("props").alias("after"))
    return rows.withColumn("payload", audit.canonical(rows.columns))


_LOG = """log AS (SELECT user_id AS tenant_id, event_id AS id, '{"action":"' || event_type || '","actor_id":null,"after":' || props || ',"at":null,"before":null,"entity_id":"' || event_id || '","entity_type":"event","reason":null,"tenant_id":"' || user_id || '"}' AS payload FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY id) AS nth FROM log),
chain AS (
  SELECT tenant_id, nth, id, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || chr(31) || payload) AS row_hash FROM numbered WHERE nth = 1
  UNION ALL SELECT n.tenant_id, n.nth, n.id, n.payload, c.row_hash, sha256(c.row_hash || chr(31) || n.payload) FROM chain c JOIN numbered n ON n.tenant_id = c.tenant_id AND n.nth = c.nth + 1)"""


def chain_append(spark, sf_dir):
    return audit.append(_log(spark, sf_dir)).select("tenant_id", "id", "prev_hash", "row_hash")


def _tampered(spark, sf_dir):
    chained = audit.append(_log(spark, sf_dir))
    return chained.withColumn("payload", F.when(F.pmod(F.col("id"), F.lit(97)) == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))


def chain_verify(spark, sf_dir):
    return audit.verify(audit.append(_log(spark, sf_dir)), F.col("payload"))


def chain_tamper(spark, sf_dir):
    return audit.verify(_tampered(spark, sf_dir), F.col("payload"))


def chain_last_hash(spark, sf_dir):
    return audit.last_hash(audit.append(_log(spark, sf_dir)))


def human_actions(spark, sf_dir):
    """Purchases as confirmed marks; users divisible by seven act without a name."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "marks.confirm").when(F.col("event_type") == "signup", "identity.reveal").otherwise(F.col("event_type"))
    rows = e.select("event_id", kind.alias("action"), F.when(F.pmod(F.col("user_id"), F.lit(7)) != 0, F.col("user_id")).alias("actor_id"))
    return audit.actor_violations(rows).groupBy("action").agg(F.count("*").alias("n"))


def ip_validity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(".", F.pmod(F.col("user_id"), F.lit(300)), F.lit(1), F.pmod(F.col("event_id"), F.lit(256)), F.lit(9)).alias("raw"))
    return e.select("event_id", audit.safe_ip("raw").alias("ip"))


def failure_streaks(spark, sf_dir):
    return audit.lockouts(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type").isin("error", "view"))


def _scripts(spark, sf_dir):
    """Orders as scripts in a state each."""
    names = F.array(*(F.lit(s) for s in states.MOVES))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.pmod("o_orderkey", F.lit(len(states.MOVES))) + 1).cast("int")).alias("state"))


def state_edges(spark, sf_dir):
    """Scripts in each state, whether a machine, a person or nobody acts next, and what may."""
    moves = states.edges(spark).withColumnRenamed("src", "state").groupBy("state").agg(F.count("*").alias("moves"))
    known = states.states(spark).join(moves, "state", "left").na.fill(0, ["moves"])  # 16 states
    return _scripts(spark, sf_dir).groupBy("state").agg(F.count("*").alias("scripts")).join(F.broadcast(known), "state")


def _history(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in (("signup", "RECEIVED"), ("view", "PREPROCESSING"), ("click", "OCR_RUNNING"), ("error", "FAILED"), ("purchase", "OCR_AGREED")) for x in pair))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.element_at(names, F.col("event_type")).alias("state"))


def state_history(spark, sf_dir):
    moves = states.history_moves(_history(spark, sf_dir), "user_id", "event_id")
    return states.illegal(moves).groupBy("src", "dst", "allowed").agg(F.count("*").alias("n"))


def state_reachability(spark, sf_dir):
    """For scripts in each state: how many states they may still reach, the fewest moves to the end, and whether without a failure."""
    reach = states.distances(spark).groupBy("src").agg(F.count("*").alias("reach"), F.min(F.when(F.col("state") == "FINALISED", F.col("steps"))).alias("to_end"))
    whole = states.distances(spark, ("FAILED",)).groupBy("src").agg(F.max((F.col("state") == "FINALISED").cast("int")).cast("boolean").alias("unfailed"))
    known = F.broadcast(reach.join(whole, "src").withColumnRenamed("src", "state"))  # 16 states
    return _scripts(spark, sf_dir).groupBy("state").agg(F.count("*").alias("scripts")).join(known, "state")


def stage_attempts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("script_id"), F.col("l_linenumber").alias("stage"), F.col("l_returnflag").alias("pipeline_version"), "l_partkey", "l_suppkey")
    return states.once_only(li, F.struct("l_partkey", "l_suppkey"))


def cache_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = recognition.cache_key(F.encode("text", "UTF-8"), F.lit("v1"), F.col("lang"), F.array(F.lit("kernel"), F.lit("deadlock")))
    calls = docs.select("doc_id", key.alias("key"), F.lit(0.0015).alias("price"))
    return recognition.read_through(calls, "key", "doc_id", "price").select("doc_id", "key", "cost", "from_cache")


def cost_meter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), F.rint("value").alias("price"), F.lit(2000.0).alias("cap"))
    return recognition.cost_meter(calls).groupBy("tenant").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"), F.max("spent").alias("spent"), F.min("remaining").alias("remaining"))


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("provider"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_type").isin("error", "view").alias("failed"))


def circuit_breaker(spark, sf_dir):
    out = recognition.circuit_breaker(_calls(spark, sf_dir), threshold=2, reset=36000.0)
    return out.groupBy("provider").agg(F.count_if("blocked").alias("blocked"), F.count_if("open").alias("open"), F.max("failures").alias("failures"))


def tenant_scope(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    seen = tenancy.TenantScope(7).table(customers, "c_nationkey")
    return seen.join(tenancy.TenantScope(7).table(table(spark, sf_dir, "nation"), "n_nationkey"), seen.c_nationkey == F.col("n_nationkey")).select("c_custkey", "n_name")


def tenant_violations(spark, sf_dir):
    return tenancy.TenantScope(7).violations(table(spark, sf_dir, "customer"), "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def page_list(spark, sf_dir):
    return tenancy.page_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, 200).select("o_orderkey")


def page_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def key_violations(spark, sf_dir):
    return tenancy.key_violations(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber")).agg(F.count("*").alias("broken"), F.max("n").alias("most"))


def orphan_rows(spark, sf_dir):
    """Orders moved on by nine customers: those of the last ones have none."""
    moved = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 9).alias("owner"))
    return tenancy.orphans(moved, "owner", table(spark, sf_dir, "customer"), "c_custkey")


def user_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return tenancy.user_by_email(users, "CUSTOMER#000000042")


def login_failures(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.pmod("c_custkey", F.lit(7)).cast("int").alias("failed_logins"), F.lit(None).cast("timestamp").alias("locked_until"))
    return tenancy.after_failure(users, now=F.lit("2024-01-01 00:00:00").cast("timestamp")).select("id", "failed_logins", F.date_format("locked_until", "yyyy-MM-dd HH:mm").alias("locked_until"))


def fairness_cap(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return results.fair_queue(jobs, "user_id", ["ts", "event_id"], 50).select("user_id", "event_id", "turn")


def chain_read(spark, sf_dir):
    log = _log(spark, sf_dir)
    chained = audit.append(log).select("tenant_id", "id", "prev_hash", "row_hash")
    blank = {n: F.lit(None).cast("string") for n in ("actor_id", "before", "reason")}
    return audit.read_chain(log.withColumns(blank).join(chained, ["tenant_id", "id"]), 7).select("id", "action", "entity_id", "tenant_id", "prev_hash", "row_hash", F.col("at").isNull().alias("no_time"))


def login_success(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.pmod("c_custkey", F.lit(7)).alias("failed_logins"), F.lit("2024-01-01").cast("timestamp").alias("locked_until"), F.col("c_name").alias("password_hash"))
    return tenancy.after_success(users).select("id", "failed_logins", F.col("locked_until").isNull().alias("open"), "password_hash")


def active_user(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "ACTIVE").otherwise("DISABLED").alias("status"))
    return tenancy.user_by_id(users, 42).union(tenancy.user_by_id(users, 43))


def exam_lookup(spark, sf_dir):
    """One row of this tenant by its key, checked on its own."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    first = customers.orderBy("c_custkey").first()
    return tenancy.TenantScope(first.c_nationkey).require(customers, "c_custkey", first.c_custkey, "c_nationkey")


def scoped_exams(spark, sf_dir):
    """Orders as exams of their customer's tenant, through the scope that the schema names."""
    exams = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("tenant_id"))
    return tenancy.TenantScope(7).named("exams", tenancy.refuse_unscoped(exams))


def exam_questions(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.col("p_brand").alias("exam_id"), F.col("p_size").alias("position"), F.col("p_partkey").alias("number"))
    return tenancy.ordered_questions(q, "Brand#13")


def booklet_downloads(spark, sf_dir):
    """Orders as booklets, customers but every fifth as exams, a nation's suppliers as questions."""
    booklets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("exam_id"), F.col("o_orderstatus").alias("layout_version"))
    exams = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"))
    questions = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("exam_id"))
    return tenancy.downloads(booklets, exams, questions, "F")


def identity_reveal(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("booklet_id"), F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.col("o_custkey")).alias("enrolment_id"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("index_number"), F.col("c_name").alias("display_name"))
    shown, log = tenancy.reveal(ids, people, "examiner")
    return shown.join(log.select(F.col("entity_id").cast("long").alias("booklet_id"), "action", "actor_id"), "booklet_id")


def sealed_names(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    return table(spark, sf_dir, "customer").select("c_custkey", tenancy.unseal(tenancy.seal(F.concat(F.lit(" "), F.col("c_name")), key), key).alias("name"))


def _lines(spark, sf_dir):
    """Line items as read lines; some have a source, a flag or a confidence that there is not."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod("l_suppkey", F.lit(n)) + 1).cast("int"))
    box = F.struct(F.lit(0).alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_linenumber") - 2).alias("w"), F.lit(9).alias("h"))
    return li.select("l_orderkey", "l_linenumber", pick((*recognition.SOURCES, "GUESSED"), 6).alias("source"), F.array(pick((*recognition.FLAGS, "ODD"), 8)).alias("flags"), (F.col("l_quantity") / 40).alias("confidence"), box.alias("box"))


def readable_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir).filter(recognition.readable(F.col("flags"), F.col("source")))
    return rows.groupBy(recognition.needs_human(F.col("flags")).alias("human"), recognition.box_valid(F.col("box")).alias("boxed")).agg(F.count("*").alias("n"), F.sum(recognition.centre_y(F.col("box"))).alias("centre"))


def line_domains(spark, sf_dir):
    return recognition.domain_violations(_lines(spark, sf_dir)).groupBy(F.concat_ws(",", "why").alias("why")).agg(F.count("*").alias("n"))


def auto_markable(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("PROSE", "SHORT", "LIST", "NUMERIC", "DIAGRAM", "CODE", "MATH"))), F.col("l_linenumber").cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(recognition.auto_markable(kinds).alias("auto")).agg(F.count("*").alias("n"))


def call_outcomes(spark, sf_dir):
    """A user's events as the attempts of a call."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    result = F.when(F.col("event_type") == "purchase", "OK").when(F.col("event_type") == "signup", "REFUSED").otherwise("ERROR")
    rows = e.select(F.col("user_id").alias("call"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("attempt"), result.alias("result"))
    return recognition.call_outcomes(rows)


QUERIES = {f.__name__: f for f in (chain_append, chain_verify, chain_tamper, chain_last_hash, human_actions, ip_validity, failure_streaks, state_edges, state_history, state_reachability, stage_attempts, cache_dedup, cost_meter, circuit_breaker, tenant_scope, tenant_violations, page_list, page_count, key_violations, orphan_rows, user_lookup, login_failures, fairness_cap, chain_read, login_success, active_user, exam_lookup, scoped_exams, exam_questions, booklet_downloads, identity_reveal, sealed_names, readable_lines, line_domains, auto_markable, call_outcomes)}
_EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{d}')" for s, d in states.EDGES) + ") t(src, dst))"
_STATES = "states AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {not d}, {s in states.HUMAN}, {s in states.MACHINE}, '{', '.join(sorted(d)) or 'none'}')" for s, d in states.MOVES.items()) + ") t(state, terminal, human, machine, allowed))"
_SCRIPTS = "scripts AS (SELECT o_orderkey, ([" + ", ".join(f"'{s}'" for s in states.MOVES) + f"])[o_orderkey % {len(states.MOVES)} + 1] AS state FROM orders)"
_WALKS = "{n} AS (SELECT state AS src, state, 0 AS steps FROM states UNION SELECT w.src, e.dst, w.steps + 1 FROM {n} w JOIN edges e ON e.src = w.state WHERE w.steps < 16{more})"


SQL = {
    "chain_append": f"WITH RECURSIVE {_LOG} SELECT tenant_id, id, prev_hash, row_hash FROM chain",
    "chain_verify": "SELECT user_id AS tenant_id, count(*) AS n_rows, NULL::BIGINT AS first_break FROM events GROUP BY user_id",
    "chain_tamper": "SELECT user_id AS tenant_id, count(*) AS n_rows, min(nth - 1) FILTER (event_id % 97 = 0) AS first_break FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) GROUP BY user_id",
    "chain_last_hash": f"WITH RECURSIVE {_LOG} SELECT tenant_id, arg_max(row_hash, nth) AS last_hash FROM chain GROUP BY tenant_id",
    "human_actions": "SELECT CASE event_type WHEN 'purchase' THEN 'marks.confirm' ELSE 'identity.reveal' END AS action, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') AND user_id % 7 = 0 GROUP BY 1",
    "ip_validity": "SELECT event_id, CASE WHEN user_id % 300 <= 255 THEN (user_id % 300) || '.1.' || (event_id % 256) || '.9' END AS ip FROM events",
    "failure_streaks": """WITH s AS (SELECT *, event_type IN ('error', 'view') AS failed FROM events),
i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s),
c AS (SELECT *, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END AS nth FROM i)
SELECT user_id, count(*) FILTER (failed) AS n_failures, max(nth)::BIGINT AS longest_streak, count(*) FILTER (nth >= 5) AS locks FROM c GROUP BY user_id""",
    "state_edges": f"WITH {_STATES}, {_EDGES}, {_SCRIPTS} SELECT s.*, (SELECT count(*) FROM edges e WHERE e.src = s.state) AS moves, n.scripts FROM states s JOIN (SELECT state, count(*) AS scripts FROM scripts GROUP BY 1) n USING (state)",
    "state_history": f"""WITH {_EDGES}, {_STATES}, h AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'PREPROCESSING' WHEN 'click' THEN 'OCR_RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'OCR_AGREED' END AS dst FROM events),
m AS (SELECT *, lag(dst) OVER (PARTITION BY user_id ORDER BY event_id) AS src FROM h)
SELECT m.src, m.dst, s.allowed, count(*) AS n FROM m JOIN states s ON s.state = m.src WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = m.src AND e.dst = m.dst) GROUP BY ALL""",
    "state_reachability": f"""WITH RECURSIVE {_STATES}, {_EDGES}, {_SCRIPTS}, {_WALKS.format(n="a", more="")}, {_WALKS.format(n="b", more=" AND e.dst <> 'FAILED'")},
r AS (SELECT src, count(DISTINCT state) AS reach, min(steps) FILTER (state = 'FINALISED')::INTEGER AS to_end FROM a GROUP BY 1), u AS (SELECT src, bool_or(state = 'FINALISED') AS unfailed FROM b GROUP BY 1)
SELECT n.state, n.scripts, r.reach, r.to_end, u.unfailed FROM (SELECT state, count(*) AS scripts FROM scripts GROUP BY 1) n JOIN r ON r.src = n.state JOIN u ON u.src = n.state""",
    "stage_attempts": "SELECT l_orderkey AS script_id, l_linenumber AS stage, l_returnflag AS pipeline_version, min((l_partkey, l_suppkey))[1] AS l_partkey, min((l_partkey, l_suppkey))[2] AS l_suppkey FROM lineitem GROUP BY ALL",
    "cache_dedup": r"""WITH k AS (SELECT doc_id, sha256(text || chr(31) || 'v1' || chr(31) || lang || chr(31) || 'deadlock' || chr(30) || 'kernel') AS key FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth FROM k)
SELECT doc_id, key, CASE WHEN nth = 1 THEN 0.0015::DOUBLE ELSE 0.0::DOUBLE END AS cost, nth > 1 AS from_cache FROM f""",
    "cost_meter": """WITH RECURSIVE n AS (SELECT user_id, round_even(value, 0) AS price, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
w AS (SELECT user_id, nth, price <= 2000 AS admitted, CASE WHEN price <= 2000 THEN price ELSE 0.0 END::DOUBLE AS spent FROM n WHERE nth = 1
  UNION ALL SELECT n.user_id, n.nth, w.spent + n.price <= 2000, CASE WHEN w.spent + n.price <= 2000 THEN w.spent + n.price ELSE w.spent END FROM w JOIN n ON n.user_id = w.user_id AND n.nth = w.nth + 1)
SELECT user_id AS tenant, count(*) FILTER (admitted) AS admitted, count(*) FILTER (NOT admitted) AS refused, max(spent) AS spent, min(2000 - spent) AS remaining FROM w GROUP BY user_id""",
    "circuit_breaker": """WITH RECURSIVE n AS (SELECT user_id, floor(epoch(ts)) AS "at", event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
w AS (SELECT user_id, nth, FALSE AS blocked, CASE WHEN failed THEN 1 ELSE 0 END AS failures, NULL::DOUBLE AS opened FROM n WHERE nth = 1
  UNION ALL SELECT user_id, nth, blocked, CASE WHEN blocked THEN failures WHEN failed THEN failures + 1 ELSE 0 END, CASE WHEN blocked THEN opened WHEN failed AND failures + 1 >= 2 THEN "at" END
  FROM (SELECT n.user_id, n.nth, n.failed, n."at", w.failures, w.opened, w.opened IS NOT NULL AND n."at" - w.opened < 36000 AS blocked FROM w JOIN n ON n.user_id = w.user_id AND n.nth = w.nth + 1))
SELECT user_id AS provider, count(*) FILTER (blocked) AS blocked, count(*) FILTER (opened IS NOT NULL) AS open, max(failures)::BIGINT AS failures FROM w GROUP BY user_id""",
    "tenant_scope": "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = 7",
    "tenant_violations": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IS DISTINCT FROM 7 GROUP BY 1",
    "page_list": "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200",
    "page_count": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "key_violations": "SELECT count(*) AS broken, max(n) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "orphan_rows": "SELECT o_orderkey, o_custkey + 9 AS owner FROM orders WHERE o_custkey + 9 NOT IN (SELECT c_custkey FROM customer)",
    "user_lookup": "SELECT c_custkey AS id, c_name AS email FROM customer WHERE lower(c_name) = 'customer#000000042' ORDER BY 1 LIMIT 1",
    "login_failures": "SELECT c_custkey AS id, (c_custkey % 7 + 1)::INTEGER AS failed_logins, CASE WHEN c_custkey % 7 + 1 >= 5 THEN '2024-01-01 00:05' END AS locked_until FROM customer",
    "fairness_cap": "SELECT user_id, event_id, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) WHERE turn <= 50",
}
_LINES = "lines AS (SELECT *, (['TIER1', 'AGREED', 'ARBITRATED', 'HUMAN', 'UNRESOLVED', 'GUESSED'])[l_suppkey % 6 + 1] AS source, (['STRUCK_THROUGH', 'TIER2_DISAGREEMENT', 'NEEDS_HUMAN_TRANSCRIPTION', 'CONTAINS_NUMERALS', 'NEAR_RUBRIC_KEYWORD', 'HIGH_CONFIDENCE_VARIANCE', 'INJECTION_PATTERN', 'ODD'])[l_suppkey % 8 + 1] AS flag, l_quantity / 40 AS confidence FROM lineitem)"
SQL |= {
    "chain_read": f"WITH RECURSIVE {_LOG} SELECT c.id, e.event_type AS action, e.event_id::VARCHAR AS entity_id, c.tenant_id, c.prev_hash, c.row_hash, TRUE AS no_time FROM chain c JOIN events e ON e.event_id = c.id AND e.user_id = c.tenant_id WHERE c.tenant_id = 7",
    "login_success": "SELECT c_custkey AS id, 0 AS failed_logins, TRUE AS open, c_name AS password_hash FROM customer",
    "active_user": "SELECT c_custkey AS id, c_name AS email, 'ACTIVE' AS status FROM customer WHERE c_custkey IN (42, 43) AND c_custkey % 3 = 0",
    "exam_lookup": "SELECT c_custkey, c_nationkey, c_name FROM customer ORDER BY 1 LIMIT 1",
    "scoped_exams": "SELECT o_orderkey, o_custkey AS tenant_id FROM orders WHERE o_custkey = 7",
    "exam_questions": "SELECT p_brand AS exam_id, p_size AS position, p_partkey AS number FROM part WHERE p_brand = 'Brand#13'",
    "booklet_downloads": """SELECT o_orderkey AS booklet, o_custkey AS exam, (SELECT count(*) FROM supplier WHERE s_nationkey = o_custkey) AS n_questions,
  CASE WHEN o_custkey % 5 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'NOT_FOUND' WHEN o_orderstatus = 'F' THEN 'SERVED' ELSE 'STALE_LAYOUT' END AS status FROM orders""",
    "identity_reveal": "SELECT o_orderkey AS booklet_id, c_custkey::VARCHAR AS index_number, c_name AS display_name, 'identity.reveal' AS action, 'examiner' AS actor_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 <> 0",
    "sealed_names": "SELECT c_custkey, c_name AS name FROM customer",
    "readable_lines": f"WITH {_LINES} SELECT flag = 'NEEDS_HUMAN_TRANSCRIPTION' AS human, l_linenumber > 2 AS boxed, count(*) AS n, sum(l_linenumber + 4.5::DOUBLE) AS centre FROM lines WHERE flag <> 'STRUCK_THROUGH' AND source <> 'UNRESOLVED' GROUP BY 1, 2",
    "line_domains": f"WITH {_LINES}, w AS (SELECT array_to_string(list_filter([CASE WHEN source = 'GUESSED' THEN 'SOURCE' END, CASE WHEN flag = 'ODD' THEN 'FLAG' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'CONFIDENCE' END], lambda x: x IS NOT NULL), ',') AS why FROM lines) SELECT why, count(*) AS n FROM w WHERE why <> '' GROUP BY 1",
    "auto_markable": "SELECT l_linenumber <= 2 AS auto, count(*) AS n FROM lineitem GROUP BY 1",
    "call_outcomes": """WITH n AS (SELECT user_id AS call, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'signup' THEN 'REFUSED' ELSE 'ERROR' END AS result FROM events),
m AS (SELECT *, least(3, coalesce(min(attempt) FILTER (result <> 'ERROR') OVER (PARTITION BY call), 3)) AS last FROM n)
SELECT call, count(*) AS made, count(*) FILTER (result <> 'OK') AS failures, arg_max(result, attempt) AS outcome FROM m WHERE attempt <= last GROUP BY 1""",
}
