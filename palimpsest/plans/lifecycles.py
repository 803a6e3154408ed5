"""Queries over life cycles: plans, prompts, sketches, approvals, decisions, lessons, goals and runs, with orders and line items in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import consolidation as C
from palimpsest.operators import lifecycles as Y
from palimpsest.operators import relational as R
from palimpsest.operators import writing as W
from palimpsest.plans.graphs import _COS
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles

_NOW = "2001-12-31"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _pick(c, *values):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _sql_pick(c: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[({c} % {len(values)} + 1)::INT]"


_PLAN_STATUS = ("proposed", "approved", "executing", "completed")
_TASK_STATUS = ("completed", "running", "pending", "pending", "failed", "dispatched", "pending")
_PLANS = f"pl AS (SELECT o_orderkey AS id, o_custkey AS goal_id, {_sql_pick('o_orderkey', *_PLAN_STATUS)} AS status FROM orders)"
_TASKS = f"ta AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS plan_id, l_linenumber AS ordinal, {_sql_pick('(l_orderkey + l_linenumber * 3)', *_TASK_STATUS)} AS status, min(l_partkey) % 3 AS attempt, 2 AS max_attempts FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _plans(spark, d):
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("goal_id"), _pick(F.col("o_orderkey"), *_PLAN_STATUS).alias("status"))


def _tasks(spark, d):
    x = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("ordinal"), _pick(F.col("l_orderkey") + F.col("l_linenumber") * 3, *_TASK_STATUS).alias("status"), (F.col("l_partkey") % 3).alias("attempt"), F.lit(2).alias("max_attempts"))


@query(f"WITH {_PLANS} SELECT id, CASE WHEN id % 3 = 0 AND status = 'proposed' THEN 'approved' ELSE status END AS status FROM pl")
def approved_plans(spark, d):
    p = _plans(spark, d)
    return Y.approve(p, p.where("id % 3 = 0"))[0].select("id", "status")


@query(f"WITH {_PLANS} SELECT CASE WHEN s IS NULL THEN 'plan_missing' WHEN s <> 'proposed' THEN 'not_proposed' END AS error, count(*) AS n FROM (SELECT q.id, pl.status AS s FROM (SELECT id FROM pl WHERE id % 3 = 0 UNION SELECT -id FROM pl WHERE id % 5 = 0) q LEFT JOIN pl USING (id)) GROUP BY 1")
def approval_errors(spark, d):
    p = _plans(spark, d)
    asked = p.where("id % 3 = 0").select("id").unionByName(p.where("id % 5 = 0").select((-F.col("id")).alias("id")))
    return Y.approve(p, asked)[1].groupBy("error").agg(F.count("*").alias("n"))


@query(f"WITH {_PLANS}, {_TASKS} SELECT plan_id, arg_min(ta.id, ordinal * 100000000 + ta.id) FILTER (WHERE ta.status = 'pending') AS id FROM ta JOIN pl ON pl.id = plan_id WHERE pl.status IN ('approved', 'executing') GROUP BY 1 HAVING count(*) FILTER (WHERE ta.status IN ('dispatched', 'running', 'failed')) = 0 AND count(*) FILTER (WHERE ta.status = 'pending') > 0")
def next_tasks(spark, d):
    """The task that each plan runs next."""
    return Y.next_tasks(_plans(spark, d), _tasks(spark, d))


@query(f"""WITH {_TASKS}, v AS (SELECT *, CASE WHEN id % 2 = 0 THEN id % 3 = 0 END AS passed FROM ta), s AS (SELECT id, plan_id, passed, CASE WHEN passed IS NULL OR status NOT IN ('dispatched', 'running') THEN status WHEN passed THEN 'completed' WHEN attempt < max_attempts THEN 'running' ELSE 'failed' END AS status,
  attempt + CASE WHEN status IN ('dispatched', 'running') AND NOT passed AND attempt < max_attempts THEN 1 ELSE 0 END AS attempt FROM v), b AS (SELECT DISTINCT plan_id FROM s WHERE NOT passed AND status = 'failed')
SELECT id, CASE WHEN status = 'pending' AND plan_id IN (SELECT plan_id FROM b) THEN 'skipped' ELSE status END AS status, attempt::BIGINT AS attempt FROM s""")
def settled_tasks(spark, d):
    """Tasks after their verdicts: completed, tried again, failed, or skipped because an earlier one has failed."""
    t = _tasks(spark, d)
    return Y.settle(t, t.where("id % 2 = 0").select("id", (F.col("id") % 3 == 0).alias("passed"))).select("id", "status", F.col("attempt").cast("long").alias("attempt"))


@query(f"WITH {_TASKS} SELECT plan_id AS goal_id, bool_and(status = 'completed') AS verified FROM ta WHERE plan_id % 2 = 0 AND ordinal < 3 GROUP BY 1")
def verified_goals(spark, d):
    return Y.verify_goals(_tasks(spark, d).where("plan_id % 2 = 0 and ordinal < 3").withColumnRenamed("plan_id", "goal_id"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_array' WHEN 2 THEN 'bad_step_count' WHEN 3 THEN 'unknown_tool' WHEN 4 THEN 'writes' WHEN 5 THEN 'first_tool' WHEN 6 THEN 'missing_tool' ELSE 'bad_step_count' END AS verdict FROM orders""")
def scored_plans(spark, d):
    """What is wrong with plans that are written as JSON."""
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey") % 8
    plan = _pick(F.col("o_orderkey"), '[{"tool": "look", "args": {}}, {"tool": "note"}]', "no plan", "[]", '[{"tool": "fly"}]', '[{"tool": "look"}, {"tool": "save"}]', '[{"tool": "note"}]', '[{"tool": "look"}]', '[{"tool": "look"}, {"tool": "look"}, {"tool": "look"}, {"tool": "look"}]')
    known, writing = F.array(*map(F.lit, ("look", "note", "save"))), F.array(F.lit("save"))
    verdict = Y.score_plan(plan, known, writing, 3, k == 4, F.when(k == 5, "look"), F.when(k == 6, "note"))
    return o.select(F.col("o_orderkey").alias("id"), verdict.alias("verdict"))


@query("WITH r AS (SELECT o_orderpriority AS name, round(avg((o_orderstatus = 'F')::INT), 6) AS pass_rate FROM orders GROUP BY 1), a AS (SELECT o_orderpriority AS name, round(avg((o_custkey % 2)::INT), 6) AS baseline FROM orders WHERE o_orderpriority < '4' GROUP BY 1) SELECT name, pass_rate, baseline, CASE WHEN pass_rate >= 0.3 AND coalesce(pass_rate >= baseline, true) THEN 'pass' ELSE 'held' END AS verdict FROM r LEFT JOIN a USING (name)")
def prompt_gate(spark, d):
    """Candidates against a threshold and against what is active."""
    o = read_table(spark, d, "orders")
    active = o.where("o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("name")).agg(F.round(F.avg((F.col("o_custkey") % 2).cast("int")), 6).alias("pass_rate"))
    return Y.pass_rate_gate(o.select(F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "F").alias("passed")), active, 0.3)


_VERSIONS = "ve AS (SELECT o_custkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey AS content, o_orderstatus FROM orders), vs AS (SELECT name, version, content, CASE WHEN version = 1 THEN 'active' WHEN content % 7 = 0 THEN 'held' ELSE 'candidate' END AS status FROM ve)"


def _versions(spark, d):
    v = R.top_per_key(read_table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], 1 << 30)
    status = F.when(F.col("rank") == 1, "active").when(F.col("o_orderkey") % 7 == 0, "held").otherwise("candidate")
    return v.select(F.col("o_custkey").alias("name"), F.col("rank").alias("version"), F.col("o_orderkey").alias("content"), status.alias("status"))


@query(f"""WITH {_VERSIONS}, q AS (SELECT name, version, CASE WHEN content % 2 = 0 THEN 'pass' ELSE 'held' END AS verdict, CASE WHEN content % 5 <> 0 THEN 'granted' END AS state, status FROM vs WHERE version % 2 = 0),
c AS (SELECT name, max(version) AS v FROM q WHERE status = 'candidate' AND verdict = 'pass' AND state = 'granted' GROUP BY 1)
SELECT name, version, CASE WHEN version = v THEN 'active' WHEN v IS NOT NULL AND status = 'active' THEN 'retired' ELSE status END AS status FROM vs LEFT JOIN c USING (name)""")
def activated_prompts(spark, d):
    """Versions after what has passed and is granted became active, and what was active retired."""
    v = _versions(spark, d)
    asked = v.where("version % 2 = 0")
    gates = asked.select("name", "version", F.when(F.col("content") % 2 == 0, "pass").otherwise("held").alias("verdict"))
    approvals = asked.where("content % 5 <> 0").select("name", "version", F.lit("granted").alias("state"))
    return Y.activate(v, asked, gates, approvals)[0].select("name", "version", "status")


@query(f"""WITH {_VERSIONS} SELECT CASE WHEN status <> 'candidate' THEN 'not_candidate' WHEN content % 2 = 1 THEN 'gate_not_passed' WHEN content % 5 = 0 THEN 'not_approved' END AS error, count(*) AS n FROM vs WHERE version % 2 = 0 GROUP BY 1""")
def activation_errors(spark, d):
    v = _versions(spark, d)
    asked = v.where("version % 2 = 0")
    gates = asked.select("name", "version", F.when(F.col("content") % 2 == 0, "pass").otherwise("held").alias("verdict"))
    approvals = asked.where("content % 5 <> 0").select("name", "version", F.lit("granted").alias("state"))
    return Y.activate(v, asked, gates, approvals)[1].groupBy("error").agg(F.count("*").alias("n"))


@query(f"WITH {_VERSIONS}, m AS (SELECT name, max(version) AS v FROM vs GROUP BY 1) SELECT name, version, status FROM vs UNION ALL SELECT c, coalesce(v, 0) + k, 'candidate' FROM (SELECT c_custkey AS c, unnest([1, 2]) AS k FROM customer WHERE c_custkey % 4 = 0) LEFT JOIN m ON name = c")
def proposed_prompts(spark, d):
    """Two new candidates for some names, numbered on."""
    new = read_table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("name"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("content"))
    return Y.propose(_versions(spark, d), new).select("name", "version", "status")


_SKETCH = ("seed", "conjecture", "hypothesis")
_TO = ("conjecture", "hypothesis", "seed", "conjecture")


@query(f"WITH s AS (SELECT p_partkey AS id, {_sql_pick('p_partkey', *_SKETCH)} AS status, {_sql_pick('p_partkey', *_TO)} AS wanted FROM part) SELECT id, CASE WHEN id % 5 <> 0 AND (status, wanted) IN (('seed', 'conjecture'), ('conjecture', 'hypothesis')) THEN wanted ELSE status END AS status FROM s")
def advanced_sketches(spark, d):
    p, k = read_table(spark, d, "part"), F.col("p_partkey")
    sketches = p.select(k.alias("id"), _pick(k, *_SKETCH).alias("status"))
    return Y.advance(sketches, p.where("p_partkey % 5 <> 0").select(k.alias("id"), _pick(k, *_TO).alias("to")))[0].select("id", "status")


@query(f"WITH s AS (SELECT p_partkey AS id, {_sql_pick('p_partkey', *_SKETCH)} AS status, {_sql_pick('p_partkey', *_TO)} AS wanted FROM part) SELECT CASE WHEN (status, wanted) IN (('seed', 'conjecture'), ('conjecture', 'hypothesis')) THEN NULL ELSE 'transition_not_allowed' END AS error, count(*) AS n FROM s GROUP BY 1")
def sketch_errors(spark, d):
    p, k = read_table(spark, d, "part"), F.col("p_partkey")
    return Y.advance(p.select(k.alias("id"), _pick(k, *_SKETCH).alias("status")), p.select(k.alias("id"), _pick(k, *_TO).alias("to")))[1].groupBy("error").agg(F.count("*").alias("n"))


_APPROVALS = "ap AS (SELECT o_orderkey AS id, o_custkey % 9 AS scope, CASE WHEN o_orderkey % 4 = 0 THEN 'granted' ELSE 'pending' END AS state, o_orderdate + INTERVAL 2000 DAY AS expires_at FROM orders)"


def _approvals(spark, d):
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).alias("scope"), F.when(F.col("o_orderkey") % 4 == 0, "granted").otherwise("pending").alias("state"), F.expr("o_orderdate + interval 2000 days").alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("decided_at"))


def _asked(a):
    first = a.where("id % 3 = 0").select("id", F.lit("granted").alias("verdict"), F.lit(1).alias("n"))
    return first.unionByName(a.where("id % 6 = 0").select("id", F.lit("denied").alias("verdict"), F.lit(2).alias("n")))


@query(f"WITH {_APPROVALS} SELECT CASE WHEN state = 'pending' AND expires_at > TIMESTAMP '{_NOW}' AND id % 3 = 0 THEN 'granted' ELSE state END AS state, count(*) AS n, count(*) FILTER (WHERE state = 'pending' AND expires_at > TIMESTAMP '{_NOW}' AND id % 3 = 0) AS decided FROM ap GROUP BY 1")
def decided_approvals(spark, d):
    """Approvals after decisions; each is decided once, and only in time."""
    a = _approvals(spark, d)
    return Y.decide(a, _asked(a), _now())[0].groupBy("state").agg(F.count("*").alias("n"), F.count("decided_at").alias("decided"))


@query(f"WITH {_APPROVALS}, q AS (SELECT *, 1 AS n FROM ap WHERE id % 3 = 0 UNION ALL SELECT *, 2 FROM ap WHERE id % 6 = 0) SELECT CASE WHEN state <> 'pending' THEN 'already_decided' WHEN expires_at <= TIMESTAMP '{_NOW}' THEN 'expired' WHEN n = 2 THEN 'already_decided' END AS error, count(*) AS n FROM q GROUP BY 1")
def decision_errors(spark, d):
    a = _approvals(spark, d)
    return Y.decide(a, _asked(a), _now())[1].groupBy("error").agg(F.count("*").alias("n"))


@query(f"WITH {_APPROVALS} SELECT scope, count(*) AS n_pending, min(expires_at) AS next_expiry FROM ap WHERE state = 'pending' AND expires_at > TIMESTAMP '{_NOW}' GROUP BY 1")
def approvals_queue(spark, d):
    return Y.queue(_approvals(spark, d), _now())


# Decisions, lessons, goals ------------------------------------------------------------------------------------------

_DECISIONS = "de AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS confidence, o_orderdate AS review_at FROM orders), oc AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS decision_id, l_returnflag = 'R' AS matched FROM lineitem WHERE l_linenumber < 3)"


def _decided(spark, d):
    o, x = read_table(spark, d, "orders"), read_table(spark, d, "lineitem").where("l_linenumber < 3")
    decisions = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("confidence"), F.col("o_orderdate").alias("review_at"))
    # Some ids come twice: the row that stands first in the files counts, as an aggregate in their order has it.
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    outcomes = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("decision_id"), (F.col("l_returnflag") == "R").alias("matched"), place)
    return Y.record_outcomes(decisions, outcomes, _now(), ["place"])


_FIRST = "fo AS (SELECT decision_id, min(id) AS outcome_id, arg_min(matched, id) AS matched FROM oc GROUP BY 1), rec AS (SELECT de.id, outcome_id, round(pow(confidence - matched::INT, 2), 6) AS surprise, review_at FROM de LEFT JOIN fo ON decision_id = de.id)"


@query(f"WITH {_DECISIONS}, {_FIRST} SELECT id, outcome_id, surprise, outcome_id IS NOT NULL AS reviewed FROM rec")
def recorded_outcomes(spark, d):
    return _decided(spark, d).select("id", "outcome_id", "surprise", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query(f"WITH {_DECISIONS}, {_FIRST} SELECT id, surprise FROM rec WHERE surprise >= 0.5 ORDER BY 2 DESC, 1 LIMIT 100")
def surprising_decisions(spark, d):
    return Y.surprising(_decided(spark, d), 0.5).select("id", "surprise").limit(100)


@query(f"WITH {_DECISIONS}, {_FIRST} SELECT id FROM rec WHERE outcome_id IS NULL AND review_at <= TIMESTAMP '2000-01-01'")
def decisions_due(spark, d):
    return Y.decisions_due(_decided(spark, d), F.lit("2000-01-01").cast("timestamp_ntz")).select("id")


@query(f"""WITH n AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS id, round({_COS.format(a='a', b='b')}, 9) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a', b='b')}, 9) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0) WHERE k = 1 AND c >= 0.3), s AS (SELECT id, count(*) AS n FROM n GROUP BY 1)
SELECT vec_id AS id, 1 + coalesce(n, 0) AS support_count, round(least(1, 0.5 + 0.1 * coalesce(n, 0))::DOUBLE, 6) AS confidence, CASE WHEN coalesce(n, 0) >= 2 THEN 'validated' ELSE 'provisional' END AS status FROM embeddings LEFT JOIN s ON s.id = vec_id WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 1, 0.5, 'provisional' FROM embeddings WHERE vec_id % 2 = 1 AND vec_id NOT IN (SELECT q FROM n)""")
def learnt_lessons(spark, d):
    """New statements confirm the lesson that they are near to, or become one."""
    v = read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    old = v.where("id % 2 = 0").select("id", "embedding", F.lit(1).cast("long").alias("support_count"), F.lit(0.5).alias("confidence"), F.lit("provisional").alias("status"))
    return Y.learn(old, v.where("id % 2 = 1").select("id", "embedding"), tau=0.3).drop("embedding")


@query("SELECT DISTINCT o_orderkey AS lesson, e AS entity FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey]) AS e FROM orders) JOIN customer ON c_custkey = e WHERE c_nationkey < 12 AND NOT (o_orderkey % 2 = 0 AND e % 2 = 0)")
def lesson_edges(spark, d):
    """Edges from lessons to what they apply to, as far as it exists and isn't tied yet."""
    o = read_table(spark, d, "orders")
    lessons = o.select(F.col("o_orderkey").alias("id"), F.array("o_custkey", F.col("o_custkey") + 1, "o_custkey").alias("applies_to"))
    known = lessons.select(F.col("id").alias("lesson"), F.explode("applies_to").alias("entity")).where("lesson % 2 = 0 and entity % 2 = 0")
    return Y.mirror_lessons(lessons, read_table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("id")), known)


@query("SELECT o_custkey AS scope, count(*) AS n, string_agg('- ' || o_orderpriority || ' ' || o_orderkey, chr(10) ORDER BY k) AS context FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k <= 3 GROUP BY 1")
def model_context(spark, d):
    """What is held true, as lines of a prompt: the most certain three of each scope."""
    o = read_table(spark, d, "orders").where("o_orderstatus = 'O'").withColumnRenamed("o_custkey", "scope")
    return Y.context_lines(o, "scope", F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("WITH g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 5 * 5 END AS parent_id, o_orderstatus AS status, o_totalprice / 500000 AS progress FROM orders WHERE o_orderkey % 11 <> 0), c AS (SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS done, round(avg(progress), 4) AS p FROM g WHERE parent_id IS NOT NULL GROUP BY 1) SELECT id, coalesce(n, 0) AS n_children, coalesce(done, 0) AS n_done, p AS mean_progress FROM g LEFT JOIN c ON c.parent_id = id")
def goal_tree(spark, d):
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey")
    goals = o.select(k.alias("id"), F.when(k % 5 != 0, k - k % 5).alias("parent_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), (F.col("o_totalprice") / 500000).alias("progress"), F.when(k % 11 == 0, _now()).alias("valid_to"))
    return Y.goal_tree(goals)


@query(f"WITH {_TASKS} SELECT o_orderkey AS id, count(ta.id) AS n_tasks, count(*) FILTER (WHERE status = 'completed') AS n_done, count(*) FILTER (WHERE status = 'failed') AS n_failed, arg_max(status, ta.id) AS last_status FROM orders LEFT JOIN ta ON plan_id = o_orderkey GROUP BY 1")
def goals_overview(spark, d):
    goals = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return Y.overview(goals, _tasks(spark, d).withColumnRenamed("plan_id", "goal_id"))


@query("""SELECT o_custkey AS run, count(*) AS n_calls, count(*) FILTER (WHERE l_returnflag <> 'N') AS n_observed, string_agg(l_linestatus || CASE WHEN l_returnflag <> 'N' THEN '=' || l_returnflag ELSE '' END, '>' ORDER BY l_orderkey * 10 + l_linenumber) AS trace FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey < 8 GROUP BY 1""")
def run_traces(spark, d):
    """Runs with their calls in order and what each saw: calls, actions, runs and observations together."""
    x = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_returnflag").alias("l_returnflag"))
    o = read_table(spark, d, "orders")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id")
    calls = x.select(line, line.alias("ordinal"), F.col("l_linestatus").alias("tool"))
    actions = x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(line.alias("id"), F.col("o_custkey").alias("run_id"))
    seen = x.where("l_returnflag <> 'N'").select(line, F.col("l_returnflag").alias("result"))
    return Y.run_traces(calls, actions, read_table(spark, d, "customer").where("c_nationkey < 8").select(F.col("c_custkey").alias("id")), seen)


@query("SELECT id, job, p FROM (SELECT event_id AS id, c_name AS job, row_number() OVER (ORDER BY (event_id % 3 = 0) DESC, ts DESC, event_id) AS p FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0 WHERE event_type = 'error') WHERE p <= 40")
def inbox_items(spark, d):
    """What has come in, with the job that it is from, unread first."""
    e = roles.events(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("read_at"), F.col("ts").alias("created_at"))
    jobs = read_table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = Y.inbox(e, jobs).limit(40).withColumn("all", F.lit(1))
    return R.top_per_key(rows, ["all"], [F.col("read_at").isNull().desc(), F.desc("created_at"), F.asc("id")], 40).select("id", "job", F.col("rank").alias("p"))


@query("SELECT event_type, count(*) FILTER (WHERE value < 100) AS hits, count(*) FILTER (WHERE value >= 100) AS misses, round(count(*) FILTER (WHERE value < 100) / count(*), 4) AS hit_rate FROM events GROUP BY 1")
def cache_hits(spark, d):
    return Y.hit_rate(roles.events(spark, d), "event_type", F.col("value") < 100)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agreed, round(count(*) FILTER (WHERE quality = toxic) / count(*), 4) AS share FROM labels")
def label_agreement(spark, d):
    return Y.agreement(read_table(spark, d, "labels"), "quality", "toxic")[0]


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE substr(o_orderpriority, 3, 1) <> o_orderstatus GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 12")
def confused_pairs(spark, d):
    return Y.agreement(read_table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")[1]


@query("SELECT o_orderpriority AS source, count(*) AS n, count(*) FILTER (WHERE c >= 0.5) AS kept, count(*) FILTER (WHERE c IS NULL OR c < 0.5) AS dropped, count(DISTINCT o_custkey) FILTER (WHERE c >= 0.5) AS subjects, count(DISTINCT o_orderstatus) FILTER (WHERE c >= 0.5) AS predicates FROM (SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 500000 END AS c FROM orders) GROUP BY 1")
def triple_statistics(spark, d):
    o = read_table(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 500000).alias("confidence"))
    return Y.import_statistics(rows, "source")


@query("SELECT user_id AS id, 'base' AS a, CASE WHEN user_id % 2 = 0 THEN 'fork' ELSE 'b' || user_id END AS b, 'new' AS c FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0)")
def forked_runs(spark, d):
    """Runs with other parameters: what the fork sets wins."""
    u = roles.events(spark, d).select("user_id").distinct()
    runs = u.select(F.col("user_id").alias("id"), F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.concat(F.lit("b"), F.col("user_id").cast("string"))).alias("params"))
    two = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("fork"), F.lit("c"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("new")))
    out = Y.fork(runs, u.where("user_id % 3 <> 0").select(F.col("user_id").alias("id"), two.alias("params")))
    return out.select("id", *[F.element_at("params", k).alias(k) for k in "abc"])


@query("SELECT CASE WHEN n = 0 THEN 'recorded' ELSE 'empty_content' END AS what, count(*) AS rows FROM (SELECT (o_orderkey % 4 = 0)::INT AS n FROM orders) GROUP BY 1")
def recorded_episodes(spark, d):
    """What is recorded, and what is nothing but scaffolding."""
    o = read_table(spark, d, "orders")
    content = F.when(F.col("o_orderkey") % 8 == 0, "<system-reminder>be brief</system-reminder>").when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(F.col("o_orderpriority"))
    good, bad, _ = W.record(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), content.alias("content")))
    return good.select(F.lit("recorded").alias("what")).unionByName(bad.select(F.col("reason").alias("what"))).groupBy("what").agg(F.count("*").alias("rows"))


@query("""SELECT o_orderkey AS id, CASE WHEN hit THEN '[redacted]' ELSE o_orderpriority END AS statement, hit AS redacted FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AS hit FROM orders)""")
def forgotten_facts(spark, d):
    """Hard forgetting: only what an approval is granted for loses its words."""
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey")
    facts = o.select(k.alias("id"), F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("statement"), F.lower("o_orderpriority").alias("statement_key"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    asked = o.where("o_orderkey % 3 = 0").select(k.alias("memory_id"), F.col("o_custkey").alias("scope"), k.alias("approval_id"))
    approvals = o.select(k.alias("id"), F.col("o_custkey").alias("scope"), F.lit("memory_forget_hard").alias("action_class"), F.when(k % 5 == 0, "denied").otherwise("granted").alias("state"), F.lit("2030-01-01").cast("timestamp_ntz").alias("expires_at"))
    out, _ = C.forget(facts, asked, approvals, _now())
    return out.select("id", "statement", F.col("statement_key").isNull().alias("redacted"))


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND count(*) > 1 THEN min(turn) + 1 END AS broken_at FROM conversations GROUP BY 1".replace("min(turn) + 1", "list_sort(list(turn))[2]"))
def tampered_chains(spark, d):
    """Where chains of hashes break: here the second turn of every other conversation has other words than when it was chained."""
    t = read_table(spark, d, "conversations")
    chain = R.hash_chain(t, ["conv_id"], "turn", F.col("text")).withColumnRenamed("turn", "at")
    second = R.top_per_key(t, ["conv_id"], ["turn"], 2).where("rank = 2 and conv_id % 2 = 0").select(F.col("conv_id").alias("c"), F.col("turn").alias("n"), F.lit("x").alias("extra"))
    now = t.join(second, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("n")), "left").select("conv_id", F.col("turn").alias("at"), F.concat("text", F.coalesce("extra", F.lit(""))).alias("text"))
    return R.first_break(chain.join(now, ["conv_id", "at"]), ["conv_id"], "at", F.col("text"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS n_facts, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS facts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def facts_of_episodes(spark, d):
    """Each episode with its facts."""
    facts = read_table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("fact"))
    return R.children(read_table(spark, d, "customer").select(F.col("c_custkey").alias("id")), facts, "episode", "fact").select("id", F.size("children").cast("long").alias("n_facts"), F.array_join("children", ",").alias("facts"))
