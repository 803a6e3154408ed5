"""Queries over bi-temporal facts and keyed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators import relational as R
from palimpsest.operators import temporal as T
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import FACTS

AT = "1998-01-01"


def at(text: str = AT):
    return F.lit(text).cast("timestamp_ntz")


@query(f"WITH {FACTS} SELECT id, scope, statement_key, status, valid_from, valid_to FROM facts WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def as_of_facts(spark, d):
    return T.as_of(roles.facts(spark, d), at()).select("id", "scope", "statement_key", "status", "valid_from", "valid_to")


@query(f"WITH {FACTS} SELECT status, count(*) AS n, count(DISTINCT scope) AS scopes, count(superseded_by) AS later FROM facts WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}') GROUP BY status")
def current_by_status(spark, d):
    rows = T.as_of(roles.facts(spark, d), at())
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"), F.count("superseded_by").alias("later"))


@query(f"WITH {FACTS} SELECT CASE WHEN valid_to IS NULL THEN 'current' ELSE 'superseded' END AS validity, count(*) AS n FROM facts GROUP BY 1")
def validity_counts(spark, d):
    rows = roles.facts(spark, d)
    parts = [T.validity(rows, w).agg(F.count("*").alias("n")).select(F.lit(w).alias("validity"), "n") for w in ("current", "superseded")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {FACTS} SELECT id, last_value(id) OVER (PARTITION BY scope, statement_key ORDER BY valid_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current FROM facts")
def supersede_chain(spark, d):
    return T.last_of_chain(roles.facts(spark, d))


@query(f"WITH {FACTS} SELECT f.id, f.status, p.id AS before_id, n.status AS next_status FROM facts f LEFT JOIN facts p ON p.superseded_by = f.id LEFT JOIN facts n ON n.id = f.superseded_by")
def fact_with_both_neighbours(spark, d):
    f = roles.facts(spark, d)
    before = f.select(F.col("superseded_by").alias("__b"), F.col("id").alias("before_id")).where("__b is not null")
    after = f.select(F.col("id").alias("__n"), F.col("status").alias("next_status"))
    return f.join(before, F.col("id") == F.col("__b"), "left").join(after, F.col("superseded_by") == F.col("__n"), "left").select("id", "status", "before_id", "next_status")


@query("SELECT id, keeper FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents) WHERE id <> keeper")
def dedup_keep_oldest(spark, d):
    # Copies may be a third of all rows: the least id per text comes from partial sums, and meets the rows by a join that splits skewed keys.
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("k"))
    least = docs.groupBy("k").agg(F.min("id").alias("keeper"))
    return docs.join(least, "k").where("id <> keeper").select("id", "keeper")


@query("SELECT id, keeper AS superseded_by FROM (SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS keeper, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)) WHERE n > 1")
def conflict_identity(spark, d):
    o = read_table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return T.conflicts(o, ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.asc("id")]).select("id", "superseded_by")


@query(f"WITH {FACTS} SELECT id, keeper AS superseded_by FROM (SELECT id, first_value(id) OVER w AS keeper, row_number() OVER w AS n FROM facts WINDOW w AS (PARTITION BY scope, statement_key, status ORDER BY valid_from DESC, id DESC)) WHERE n > 1")
def conflict_statement(spark, d):
    return T.conflicts(roles.facts(spark, d), ["scope", "statement_key", "status"], [F.desc("valid_from"), F.desc("id")]).select("id", "superseded_by")


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderdate, o_totalprice / 600000 AS confidence FROM orders),
w AS (SELECT *, max(confidence) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p),
k AS (SELECT * FROM w WHERE best IS NULL OR confidence > best)
SELECT id, CASE WHEN confidence >= 0.75 THEN 'canonical' ELSE 'hypothesis' END AS status, o_orderdate AS valid_from, lead(o_orderdate) OVER x AS valid_to, lead(id) OVER x AS superseded_by FROM k WINDOW x AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, id)""")
def identity_running_winner(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 600000).alias("confidence"))
    return T.running_winners(o, ["o_custkey", "o_orderpriority"], ["created_at", "id"]).select("id", "status", "valid_from", "valid_to", "superseded_by")


@query("SELECT o_custkey, o_orderpriority AS predicate, o_orderkey AS id, o_totalprice AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def identity_context(spark, d):
    best = R.keep_first(read_table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return best.select("o_custkey", F.col("o_orderpriority").alias("predicate"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def episode_antijoin(spark, d):
    lines = read_table(spark, d, "lineitem").select("l_orderkey")
    return read_table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("""SELECT (SELECT count(*) FROM orders) AS facts, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)) AS facts_without_lines,
(SELECT count(*) FROM documents) AS episodes, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = d.doc_id)) AS unlabelled, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-24') AS recent_events""")
def backlog_counts(spark, d):
    docs, labels, events = (read_table(spark, d, t) for t in ("documents", "labels", "events"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(read_table(spark, d, "orders"), "facts"), one(episode_antijoin(spark, d), "facts_without_lines"), one(docs, "episodes"), one(docs.join(labels, "doc_id", "left_anti"), "unlabelled"), one(events.where("ts >= timestamp_ntz '2024-01-24'"), "recent_events")]
    keyed = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        keyed = keyed.join(p.withColumn("k", F.lit(1)), "k")  # one row each
    return keyed.drop("k")


@query(f"""WITH {FACTS}, t AS (SELECT *, CASE status WHEN 'F' THEN 'canonical' WHEN 'O' THEN 'hypothesis' ELSE 'conjecture' END AS st, CASE WHEN id % 2 = 0 THEN 'working' ELSE 'semantic' END AS tier FROM facts)
SELECT st AS status, tier, count(*) AS n, count(*) FILTER (WHERE valid_to IS NULL AND date_diff('day', valid_from, TIMESTAMP '2001-12-31') > 90 AND (st <> 'canonical' OR tier = 'working')) AS retired FROM t GROUP BY ALL""")
def decay_facts(spark, d):
    now = at("2001-12-31")
    status = F.when(F.col("status") == "F", "canonical").when(F.col("status") == "O", "hypothesis").otherwise("conjecture")
    rows = roles.facts(spark, d).withColumn("status", status).withColumn("tier", F.when(F.col("id") % 2 == 0, "working").otherwise("semantic")).withColumn("created_at", F.col("valid_from")).withColumn("was", F.col("valid_to"))
    new = F.count_if(F.col("was").isNull() & F.col("valid_to").isNotNull())
    return T.decay(rows, now).groupBy("status", "tier").agg(F.count("*").alias("n"), new.alias("retired"))


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey, o_totalprice * 2 AS price FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS id, o_custkey, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upsert_snapshot(spark, d):
    old = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    new = old.where("o_orderstatus = 'P'").select("id", "o_custkey", (F.col("price") * 2).alias("price"))
    return R.upsert(old.drop("o_orderstatus"), new, ["id"])


@query("SELECT p_partkey AS id, p_size AS v FROM part UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)")
def insert_ignore_snapshot(spark, d):
    return R.insert_ignore(read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v")), read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v")), ["id"])


@query("SELECT l_orderkey, l_linenumber, coalesce(m.new, l_partkey) AS part FROM lineitem LEFT JOIN (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS new FROM part) m ON m.old = l_partkey")
def repoint_keys(spark, d):
    p = read_table(spark, d, "part")
    least = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("new"))
    mapping = p.join(least, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("old"), "new").where("old <> new")
    return R.repoint(read_table(spark, d, "lineitem").withColumnRenamed("l_partkey", "part"), "part", mapping).select("l_orderkey", "l_linenumber", "part")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-11-01' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def protected_deletes(spark, d):
    lines = read_table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '2001-11-01'").select("l_suppkey")
    poor = read_table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return R.protected_delete(read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), [lines, poor])


@query("SELECT c_custkey AS id, c_name || ' = ' || c_mktsegment AS text, c_acctbal AS score FROM customer WHERE c_mktsegment ILIKE '%build%' OR c_name ILIKE '%build%' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def entity_recall(spark, d):
    from palimpsest.operators.retrieval import entity_channel

    facts = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("predicate"), F.col("c_mktsegment").alias("object"), F.col("c_acctbal").alias("confidence"))
    return entity_channel(facts, "build", 10).select("id", "text", "score")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_group(spark, d):
    return roles.events(spark, d).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT o_orderkey AS id, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def filtered_page(spark, d):
    rows = read_table(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice >= 1000")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(50).select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice")


@query("SELECT c.c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counts_per_parent(spark, d):
    sums = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))
    rows = read_table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("t", F.lit(0.0)).alias("total"))


@query("SELECT l_orderkey AS plan_id, count(*) AS n_tasks, count(*) FILTER (WHERE l_returnflag = 'A') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, round(count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 4) AS progress, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) = count(*) AS terminal FROM lineitem GROUP BY 1")
def plan_progress(spark, d):
    from palimpsest.operators import decisions

    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("pending")
    return decisions.plan_progress(read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), status.alias("status")))


@query("SELECT n_nationkey, n_name, s.scenario, s.probability, s.outcome FROM nation, (VALUES ('best_case', 0.2::DOUBLE, 'maximum_gain'), ('worst_case', 0.2, 'maximum_loss'), ('most_likely', 0.35, 'expected_value'), ('black_swan', 0.1, 'tail_risk'), ('status_quo', 0.15, 'no_change')) s(scenario, probability, outcome)")
def scenario_distribution(spark, d):
    from palimpsest.operators import decisions

    return decisions.scenarios(read_table(spark, d, "nation").select("n_nationkey", "n_name"))


_LEVELS = "CASE {} WHEN 0 THEN 'suggest_only' WHEN 1 THEN 'confirm_each' WHEN 2 THEN 'bounded_auto' ELSE 'full_auto' END"


@query(f"""WITH r AS (SELECT o_orderkey AS id, ['read', 'memory_write', 'memory_forget_hard', 'file_edit', 'code_exec', 'net_egress', 'external_post', 'spend', 'self_modify', 'other'][(o_orderkey % 10 + 1)::INT] AS ac,
 (o_custkey % 4)::INT AS ad, (o_orderkey // 10 % 4)::INT AS wo, o_custkey % 7 <> 0 AS granted, o_orderkey % 97 = 0 AS unreadable, o_orderkey % 89 = 0 AS kill, o_custkey % 31 = 0 AS hard, o_orderkey // 10 % 2 = 0 AS host_ok,
 CASE WHEN o_custkey % 2 = 0 THEN 'granted' END AS approval, CASE WHEN o_custkey % 3 = 0 THEN 'pass' END AS eval, o_custkey % 11 = 0 AS dry, CASE WHEN o_custkey % 5 = 0 THEN 'private' END AS channel, o_totalprice / 5000 AS usd FROM orders),
f AS (SELECT *, CASE WHEN ac = 'spend' THEN CASE WHEN usd > 25 THEN 1 ELSE 3 END WHEN ac = 'external_post' THEN CASE WHEN channel = 'private' THEN 3 ELSE 1 END WHEN ac = 'read' THEN 3 WHEN ac IN ('memory_forget_hard', 'self_modify') THEN 1 WHEN ac = 'other' THEN NULL ELSE 2 END AS fl FROM r),
g AS (SELECT *, least(ad, wo, coalesce(fl, 0)) AS lv FROM f),
h AS (SELECT *, CASE WHEN ac = 'read' THEN 'read_no_side_effect' WHEN fl IS NULL THEN 'unknown_action_class_fail_closed' WHEN unreadable THEN 'kill_switch_unreadable' WHEN kill THEN 'kill_switch_active' WHEN NOT granted THEN 'capability_grant_missing'
 WHEN ac = 'net_egress' AND NOT host_ok THEN 'net_egress_host_not_in_allowlist' WHEN hard THEN 'budget_hard_limit_exceeded' WHEN ac = 'self_modify' AND eval IS NULL THEN 'self_modify_eval_gate_unsatisfied' WHEN ac = 'self_modify' AND lv = 0 THEN 'self_modify_autonomy_forbids'
 WHEN ac = 'self_modify' AND approval = 'granted' THEN 'self_modify_dual_gate_satisfied' WHEN ac = 'self_modify' THEN 'self_modify_requires_approval' WHEN dry THEN 'dry_run_requested' WHEN lv = 1 AND approval = 'granted' THEN 'approval_granted' WHEN lv = 0 THEN 'suggest_only_no_side_effect' WHEN lv = 1 THEN 'gated_at_confirm_each' ELSE 'auto_allow' END AS reason FROM g)
SELECT id, reason, CASE WHEN reason IN ('read_no_side_effect', 'self_modify_dual_gate_satisfied', 'approval_granted', 'auto_allow') THEN 'ALLOW' WHEN reason IN ('self_modify_requires_approval', 'gated_at_confirm_each') THEN 'REQUIRE_APPROVAL' WHEN reason = 'dry_run_requested' THEN 'DRY_RUN' ELSE 'DENY' END AS verdict,
 CASE WHEN reason IN ('unknown_action_class_fail_closed', 'kill_switch_unreadable', 'kill_switch_active', 'capability_grant_missing') THEN 'suggest_only' ELSE {_LEVELS.format('lv')} END AS effective_level,
 CASE WHEN reason IN ('unknown_action_class_fail_closed', 'kill_switch_unreadable', 'kill_switch_active', 'capability_grant_missing') OR fl = lv THEN 'action_class_floor' WHEN wo = lv THEN 'workspace_override' END AS clamped_by FROM h""")
def policy_matrix(spark, d):
    from palimpsest.functions.lexicon import AUTONOMY, CLASS_FLOORS
    from palimpsest.operators import decisions

    c = F.col
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    o = read_table(spark, d, "orders")
    tens = F.floor(c("o_orderkey") / 10)
    rows = o.select(
        c("o_orderkey").alias("id"),
        pick([*CLASS_FLOORS, "other"], c("o_orderkey") % 10).alias("action_class"),
        pick(AUTONOMY, c("o_custkey") % 4).alias("agent_default"),
        pick(AUTONOMY, tens % 4).alias("workspace_override"),
        F.when(c("o_custkey") % 7 != 0, F.array(*map(F.lit, CLASS_FLOORS))).otherwise(F.array().cast("array<string>")).alias("tools"),
        (c("o_orderkey") % 97 == 0).alias("kill_unreadable"),
        (c("o_orderkey") % 89 == 0).alias("kill_global"),
        F.lit(False).alias("kill_agent"),
        F.when(c("o_custkey") % 31 == 0, 10).otherwise(1).alias("tokens"),
        F.lit(10).alias("tokens_limit"),
        *[F.lit(x).alias(n) for n, x in (("tool_actions", 0), ("tool_actions_limit", 5), ("usd", 0.0), ("usd_limit", 9.0), ("seconds", 0), ("seconds_limit", 60))],
        F.lit("a.example").alias("host"),
        F.when(tens % 2 == 0, F.array(F.lit("a.example"))).otherwise(F.array(F.lit("b.example"))).alias("egress_allow"),
        F.when(c("o_custkey") % 2 == 0, "granted").alias("approval_state"),
        F.when(c("o_custkey") % 3 == 0, "pass").alias("eval_verdict"),
        (c("o_custkey") % 11 == 0).alias("force_dry_run"),
        F.when(c("o_custkey") % 5 == 0, "private").alias("channel"),
        (c("o_totalprice") / 5000).alias("amount_usd"),
    )
    return decisions.policy(rows).select("id", "reason", "verdict", "effective_level", "clamped_by")


@query("SELECT p_partkey AS id, rtrim(regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g'), ' .!?,;:') AS statement_key, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS alnum, coalesce(nullif(rtrim(substring(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-'), ''), 'untitled') AS slug FROM part")
def text_keys(spark, d):
    c = F.col("p_name")
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.statement_key(c).alias("statement_key"), X.alnum_key(c).alias("alnum"), X.slug(c).alias("slug"))


@query("SELECT user_id, count(*) AS n, round(avg(pow(least(value / 500, 1) - CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END, 2)), 6) AS mean_surprise FROM events GROUP BY 1")
def brier_outcomes(spark, d):
    rows = roles.events(spark, d).select("user_id", S.brier(F.least(F.col("value") / 500, F.lit(1.0)), F.col("event_type") != "error").alias("s"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_surprise"))


@query("SELECT event_id, round(pow(least(value / 500, 1) - 1, 2), 6) AS surprise FROM events e WHERE event_type <> 'error' AND pow(least(value / 500, 1) - 1, 2) >= 0.25 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'F') ORDER BY pow(least(value / 500, 1) - 1, 2) DESC, event_id LIMIT 20")
def distill_candidates(spark, d):
    used = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.array("o_orderkey").alias("outcomes")).select(F.explode("outcomes").alias("used"))
    rows = roles.events(spark, d).where("event_type <> 'error'").withColumn("s", S.brier(F.least(F.col("value") / 500, F.lit(1.0)), F.lit(True)))
    rows = rows.where("s >= 0.25").join(used, F.col("event_id") == F.col("used"), "left_anti")
    return rows.orderBy(F.desc("s"), "event_id").limit(20).select("event_id", F.round("s", 6).alias("surprise"))


_NOW = "2024-01-31"


@query(f"""WITH l AS (SELECT user_id AS id, round(avg(value) / 500, 9) AS confidence, min(ts) AS created_at, max(ts) AS seen FROM events GROUP BY 1),
r AS (SELECT *, confidence * pow(0.5, epoch_us(TIMESTAMP '{_NOW}') / 86400e6 / 3 - epoch_us(seen) / 86400e6 / 3) AS raw FROM l)
SELECT id, CASE WHEN raw < 0.05 THEN 'retired' ELSE 'provisional' END AS status, round(CASE WHEN raw < 0.05 THEN confidence ELSE greatest(0.1, raw) END, 6) AS confidence FROM r""")
def lesson_decay(spark, d):
    from palimpsest.operators import decisions

    rows = roles.events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg("value") / 500, 9).alias("confidence"), F.min("ts").alias("created_at"), F.max("ts").alias("last_reinforced_at"))
    rows = rows.withColumn("last_decayed_at", F.col("created_at")).withColumn("status", F.lit("provisional"))
    out = decisions.decay_lessons(rows, at(_NOW), half_life_days=3.0)
    return out.select("id", "status", F.round("confidence", 6).alias("confidence"))


@query("SELECT p_partkey AS id, 1 + n AS support_count, round(least(1, 0.5 + 0.1 * n)::DOUBLE, 6) AS confidence, CASE WHEN 1 + n >= 3 THEN 'validated' ELSE 'provisional' END AS status FROM (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1)")
def lesson_reinforce(spark, d):
    from palimpsest.operators import decisions

    lessons = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("support_count"), F.lit(0.5).alias("confidence"), F.lit("provisional").alias("status"))
    said = read_table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("id"))
    return decisions.reinforce(lessons, said).select("id", "support_count", F.round("confidence", 6).alias("confidence"), "status")


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) * 5 + list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS place FROM events)")
def interleave_kinds(spark, d):
    return R.interleave(roles.events(spark, d), ["user_id"], "event_type", ["event_id"], ["view", "click", "purchase", "signup", "error"]).select("user_id", "event_id", "place")


@query("""WITH RECURSIVE b AS (SELECT conv_id, turn, sha256(role || ':' || text) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT conv_id, turn, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS entry_hash FROM b WHERE n = 1 UNION ALL SELECT b.conv_id, b.turn, b.n, h.entry_hash, sha256(h.entry_hash || b.body) FROM h JOIN b ON b.conv_id = h.conv_id AND b.n = h.n + 1)
SELECT conv_id, turn, prev_hash, entry_hash FROM h""")
def hash_chain(spark, d):
    return R.hash_chain(read_table(spark, d, "conversations"), ["conv_id"], "turn", F.concat("role", F.lit(":"), "text"))


@query("SELECT event_id, (event_type = 'error')::INT * (n - min_n + 1) AS consecutive FROM (SELECT *, min(n) OVER (PARTITION BY user_id, g) AS min_n FROM (SELECT *, row_number() OVER w AS n, count(*) FILTER (WHERE event_type <> 'error') OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'error') UNION ALL SELECT event_id, 0 FROM events WHERE event_type <> 'error'")
def consecutive_failures(spark, d):
    return R.run_lengths(roles.events(spark, d), ["user_id"], ["event_id"], F.col("event_type") == "error").select("event_id", "consecutive")


@query("SELECT c_custkey AS id, c_acctbal FROM customer ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def boolean_first_order(spark, d):
    rows = read_table(spark, d, "customer")
    return rows.orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25).select(F.col("c_custkey").alias("id"), "c_acctbal")


@query("SELECT o_custkey, o_orderkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_key(spark, d):
    return R.top_per_key(read_table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("id")], 3).select("o_custkey", "id", "rank")


@query("SELECT o.o_orderkey AS order_id, count(e.event_id) AS n_events FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 700)::INT) AS at FROM orders) o JOIN events e ON e.user_id = o.o_custkey AND e.ts >= o.at AND e.ts < o.at + INTERVAL 48 HOUR GROUP BY 1")
def interval_join(spark, d):
    # Equality on the user and on the day, each window laid out over the three days it can touch, before the exact bounds.
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 700).cast("int"))
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("u"), start.alias("at"))
    o = o.withColumn("day", F.explode(F.sequence(F.to_date("at"), F.date_add(F.to_date("at"), 2))))
    e = roles.events(spark, d).select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    rows = o.join(e, (F.col("u") == F.col("user_id")) & (o["day"] == e["day"])).where(F.expr("ts >= at and ts < at + interval 48 hours"))
    return rows.groupBy("order_id").agg(F.count("*").alias("n_events"))


@query("SELECT o_orderkey AS order_id, e.event_id FROM (SELECT o_orderkey, o_custkey AS user_id, TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 700)::INT) AS at FROM orders) o ASOF JOIN events e ON o.user_id = e.user_id AND o.at >= e.ts")
def as_of_join(spark, d):
    # The newest event at or before each order: one window over the union of both, no range join.
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 700).cast("int"))
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), start.alias("at"), F.col("o_orderkey").alias("order_id"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    e = roles.events(spark, d).select("user_id", F.col("ts").alias("at"), F.lit(None).cast("long").alias("order_id"), "event_id", F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("at", "side", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w))
    return rows.where("side = 1 and event_id is not null").select("order_id", "event_id")
