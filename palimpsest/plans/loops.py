"""Queries over goals, approvals, jobs, entities' neighbours and evaluation: what remains of the domain beside facts, text and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import consolidation as C
from palimpsest.operators import graph as G
from palimpsest.operators import lifecycles as Y
from palimpsest.operators import relational as R
from palimpsest.operators import temporal as T
from palimpsest.operators import writing as W
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import PART_EDGES

_NOW = "2001-12-31"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query("SELECT o_orderkey AS id, o_custkey, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 300000) WHERE n <= 2")
def promote_opportunities(spark, d):
    rows = read_table(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice >= 300000").withColumnRenamed("o_orderkey", "id")
    return R.top_per_key(rows, ["o_custkey"], [F.desc_nulls_last("o_totalprice"), F.asc("id")], 2).select("id", "o_custkey", F.col("o_totalprice").alias("score"))


@query("SELECT c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 12")
def goals_without_plan(spark, d):
    """Goals with no live plan and fewer plans than the cap: one count per goal answers both."""
    plans = read_table(spark, d, "orders").select(F.col("o_custkey").alias("goal_id"), F.when(F.col("o_orderstatus") == "P", "executing").otherwise("completed").alias("status"))
    return Y.live_plans(read_table(spark, d, "customer").select(F.col("c_custkey").alias("id")), plans, 12)


@query(f"SELECT CASE WHEN o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '{_NOW}' THEN 'expired' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'granted' END AS state, count(*) AS n FROM orders GROUP BY 1")
def approval_states(spark, d):
    from palimpsest.operators.decisions import approvals_at

    rows = read_table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "pending").otherwise("granted").alias("state"), F.expr("o_orderdate + interval 30 days").alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("decided_at"))
    return approvals_at(rows, _now()).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {PART_EDGES}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT p_partkey AS id, degree FROM part JOIN g ON node = p_partkey * 2 WHERE degree >= 5 AND NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderdate >= TIMESTAMP '2001-01-01')""")
def neglected_entities(spark, d):
    """Well-connected entities that recent activity doesn't mention."""
    recent = read_table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '2001-01-01'").select("o_orderkey")
    seen = read_table(spark, d, "lineitem").join(recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select((F.col("l_partkey") * 2).alias("seen"))
    rows = G.degree(roles.part_edges(spark, d)).where("degree >= 5 and node % 2 = 0").join(seen, F.col("node") == F.col("seen"), "left_anti")
    return rows.join(read_table(spark, d, "part").select((F.col("p_partkey") * 2).alias("node"), F.col("p_partkey").alias("id")), "node").select("id", "degree")


@query("SELECT label AS a, nearest AS b, count(*) AS n FROM (SELECT v.label, p.label AS nearest, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) DESC, p.label) AS k FROM embeddings v, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) p) WHERE k = 1 GROUP BY 1, 2")
def label_confusion(spark, d):
    from palimpsest.plans.graphs import nearest_prototype

    return nearest_prototype(spark, d).groupBy(F.col("label").alias("a"), F.col("nearest").alias("b")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT DISTINCT o_custkey AS id, o_orderpriority FROM orders), m AS (SELECT o_custkey AS id, count(*) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT c_custkey AS id, coalesce(m, 0) AS mentions, round(least(0.5 + 0.1 * (8 - coalesce(m, 0)), 0.95)::DOUBLE, 6) AS severity FROM customer LEFT JOIN m ON m.id = c_custkey WHERE coalesce(m, 0) < 8""")
def alignment_gaps(spark, d):
    """Goals that recent activity mentions less than 8 times, with a severity that grows with what is missing."""
    said = read_table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '2000-01-01'").groupBy("o_custkey").agg(F.count("*").alias("m"))
    rows = read_table(spark, d, "customer").join(said, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("m", F.lit(0)).alias("mentions")).where("mentions < 8")
    return rows.withColumn("severity", F.round(F.least(F.lit(0.5) + F.lit(0.1) * (8 - F.col("mentions")), F.lit(0.95)), 6))


@query("SELECT event_type AS name, count(*) AS calls, count(*) FILTER (WHERE value > 400) AS errors, round(count(*) FILTER (WHERE value > 400) / count(*), 4) AS error_rate, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def call_rollup(spark, d):
    return Y.call_rollup(roles.events(spark, d), "event_type", F.col("value") > 400, "value")


@query("""SELECT n, count(*) AS facts FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'empty_statement' WHEN c_custkey IS NULL THEN 'episode_missing' WHEN c_nationkey <> o_custkey % 25 AND o_orderkey % 2 = 0 THEN 'scope_mismatch' ELSE 'accepted' END AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey * (CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END)) GROUP BY 1""")
def add_facts(spark, d):
    """Adding facts: what is accepted, and why others are not."""
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    scope = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 25)
    o = read_table(spark, d, "orders")
    episode = F.col("o_custkey") * F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(1)
    own = c.select(F.col("id").alias("__c"), "nation")
    facts = o.join(own, F.col("o_custkey") == F.col("__c"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce(scope, F.col("nation")).alias("scope"), F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("statement"), episode.alias("source_episode_id"))
    good, bad, _ = W.add(facts, c.withColumnRenamed("nation", "scope"), c.select("id").limit(0))
    return good.select(F.lit("accepted").alias("n")).unionByName(bad.select(F.col("reason").alias("n"))).groupBy("n").agg(F.count("*").alias("facts"))


@query(f"""WITH {roles.FACTS} SELECT status, count(*) AS n, count(*) FILTER (WHERE valid_to IS NULL AND id % 3 <> 0) AS current FROM facts GROUP BY 1""")
def invalidate_facts(spark, d):
    facts = roles.facts(spark, d)
    asked = facts.where("id % 3 = 0").select(F.col("id").alias("fact_id"), "scope", F.lit(None).cast("long").alias("superseded_by"))
    out, _, _ = W.invalidate(facts, asked, _now())
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("valid_to").isNull()).alias("current"))


@query(f"""WITH {roles.FACTS}, w AS (SELECT id FROM facts WHERE valid_to IS NULL AND id % 2 = 0 ORDER BY valid_from, id LIMIT 100) SELECT CASE WHEN id % 2 = 0 AND id NOT IN (SELECT id FROM w) THEN 'working' ELSE 'semantic' END AS tier, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT id FROM w)) AS promoted FROM facts GROUP BY 1""")
def promote_working(spark, d):
    rows = roles.facts(spark, d).withColumn("tier", F.when(F.col("id") % 2 == 0, "working").otherwise("semantic")).withColumn("created_at", F.col("valid_from"))
    return C.promote(rows, _now()).groupBy("tier").agg(F.count("*").alias("n"), F.count("episode").alias("promoted"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE k = 1) AS due_kinds, max(ts) AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events WHERE ts >= date_trunc('week', TIMESTAMP '2024-01-25')) GROUP BY 1""")
def period_guard(spark, d):
    """What has run in the current calendar week already, by job."""
    since = F.date_trunc("week", F.lit("2024-01-25").cast("timestamp_ntz"))
    rows = roles.events(spark, d).where(F.col("ts") >= since)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("due_kinds"), F.max("ts").alias("last_at"))


@query("SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) AS place FROM conversations) WHERE back <= 3")
def reversed_tail(spark, d):
    """The newest three messages of each conversation, in the order they were said."""
    rows = R.top_per_key(read_table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 3)
    return rows.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("""SELECT item_id AS id, round(len(list_filter(w, lambda x: contains(t, x))) / len(w), 6)::DOUBLE AS share FROM (SELECT item_id, lower(text) AS t, list_distinct(list_filter(string_split_regex(lower(before), '[^a-z]+'), lambda x: length(x) >= 4)) AS w FROM (SELECT item_id, text, lag(text) OVER (ORDER BY item_id) AS before FROM benchmark) WHERE before IS NOT NULL) WHERE len(w) > 0""")
def eval_containment(spark, d):
    """How many of the words of the item before an answer contains."""
    rows = R.previous(read_table(spark, d, "benchmark").withColumn("all", F.lit(1)), ["all"], ["item_id"], "text", "before").where("before is not null")
    rows = rows.withColumn("w", X.word_set(F.col("before"), 4)).where(F.size("w") > 0)
    return rows.select(F.col("item_id").alias("id"), F.round(X.share_contained(F.col("text"), F.col("w")), 6).alias("share"))


@query(f"""WITH {PART_EDGES}, n AS (SELECT p_partkey * 2 AS id, p_brand AS name FROM part), h AS (SELECT dst AS node, count(*) AS degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) SELECT node, degree FROM h""")
def graph_context(spark, d):
    """The hubs among suppliers, each with a line of its first relations, of which the digest keeps the degree."""
    e = roles.part_edges(spark, d)
    nodes = read_table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_brand").alias("name"))
    return G.context_lines(nodes, e, 30).where(F.col("node") % 2 == 1).select("node", "degree")


@query("SELECT tier, kind, count(*) AS n FROM (SELECT CASE WHEN o_totalprice >= 200000 THEN 'canonical' ELSE 'hypothesis' END AS tier, o_orderpriority AS kind, o_totalprice FROM orders WHERE o_totalprice >= 100000) GROUP BY 1, 2")
def principle_gate(spark, d):
    """Candidates below the least confidence go, those above the gate are canonical."""
    rows = read_table(spark, d, "orders").select(F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("kind"))
    return Y.gate_principles(rows, 100000, 200000).groupBy(F.col("status").alias("tier"), "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {roles.FACTS} SELECT id, CASE WHEN status = 'P' AND valid_to IS NULL THEN TIMESTAMP '{_NOW}' ELSE valid_to END AS valid_to FROM facts""")
def soft_delete_rows(spark, d):
    return T.soft_delete(roles.facts(spark, d), F.col("status") == "P", _now()).select("id", "valid_to")
