"""Queries over workspaces, projects, prefixes, groups of events, grown arrays, and passes over a scope's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators import consolidation as C
from palimpsest.operators import lifecycles as Y
from palimpsest.operators import relational as R
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles

#: Types of the supplied events, by group.
_GROUPS = {"click": "use", "view": "use", "purchase": "trade", "signup": "account", "error": "fault"}


@query("SELECT c_custkey AS id, c_name AS name, n_name AS workspace, r_name AS area FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_nationkey % 2 = 0")
def workspace_projects(spark, d):
    """Projects with the name and area of their workspace; some have none."""
    c, n, r = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    projects = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("workspace_id"), F.col("c_name").alias("name"))
    spaces = n.where("n_nationkey % 2 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("area"))
    return Y.projects_in_workspaces(projects, spaces).select("id", "name", "workspace", "area")


@query("""WITH f AS (SELECT o_custkey AS k, o_orderpriority AS v, min(o_orderkey) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2), l AS (SELECT k, list(v ORDER BY n) AS v FROM f GROUP BY 1)
SELECT c_custkey AS id, array_to_string(list_concat(['1-URGENT', '1-URGENT'], coalesce(v, [])), ',') AS tags FROM customer LEFT JOIN l ON k = c_custkey""")
def grown_tags(spark, d):
    """Arrays to which each new value is added once, at the end."""
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    rows = c.select(F.col("c_custkey").alias("id"), F.array(F.lit("1-URGENT"), F.lit("1-URGENT")).alias("tags"))
    more = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("value"))
    return R.append_distinct(rows, more, "id", "tags").select("id", F.array_join("tags", ",").alias("tags"))


@query("""SELECT p_partkey AS id, split_part(substr('deep:' || lower(replace(p_brand, '#', '/')) || '/' || p_size, 6), '/', 1) AS prefix, CASE WHEN p_partkey % 2 = 0 THEN 'team' ELSE 'user' END AS level, CASE WHEN p_partkey % 2 = 0 THEN 'a:' || p_size ELSE p_brand END AS ident, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE p_size / 100 END::DOUBLE AS sure FROM part""")
def prefixes_and_scopes(spark, d):
    """Prefixes of nested sources, the two halves of scopes, and numbers held between 0 and 1."""
    p = read_table(spark, d, "part")
    source = F.concat(F.lit("deep:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))), F.lit("/"), F.col("p_size").cast("string"))
    scope = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("team:a:"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "7.5").when(k == 1, "-1").when(k == 2, "no number").otherwise((F.col("p_size") / 100).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), X.nested_prefix(source).alias("prefix"), X.scope_level(scope).alias("level"), X.scope_ident(scope).alias("ident"), S.clamp01(raw).alias("sure"))


@query("SELECT CASE event_type " + " ".join(f"WHEN '{t}' THEN '{g}'" for t, g in _GROUPS.items()) + " END AS event_group, count(*) AS n FROM events GROUP BY 1")
def event_groups(spark, d):
    """Events by the group of their type, from a closed catalogue."""
    group = X.event_group(F.concat(F.lit("org.example."), "event_type"), _GROUPS, "org.example.")
    return roles.events(spark, d).groupBy(group.alias("event_group")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts >= date_trunc('week', TIMESTAMP '2024-01-24 10:00:00'))")
def due_this_week(spark, d):
    """Whoever has done nothing since the week began."""
    e = roles.events(spark, d)
    return Y.due_in_period(e.select("user_id").distinct(), e.select("user_id", "ts"), F.lit("2024-01-24 10:00:00").cast("timestamp"), "week", "user_id", "ts")


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS scope, CASE WHEN o_orderstatus = 'O' THEN 'working' ELSE 'semantic' END AS tier, o_orderpriority AS k, o_orderdate AS made FROM orders), u AS (SELECT id FROM m WHERE tier = 'working' ORDER BY made, id LIMIT 100),
p AS (SELECT m.*, u.id IS NOT NULL AS up FROM m LEFT JOIN u USING (id)), w AS (SELECT *, row_number() OVER (PARTITION BY scope, k ORDER BY made DESC, id DESC) AS r FROM p)
SELECT CASE WHEN up THEN 'semantic' ELSE tier END AS tier, count(*) AS n, count(*) FILTER (WHERE r > 1) AS retired FROM w GROUP BY 1""")
def consolidated_scopes(spark, d):
    """Passes one after the other, each from what the one before leaves: working rows are promoted, then all but the newest of a key retired."""
    o = read_table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), F.when(F.col("o_orderstatus") == "O", "working").otherwise("semantic").alias("tier"), F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    now = F.lit("2024-01-01").cast("timestamp_ntz")

    def conflicts(state):
        m = state["memories"]
        newest = R.keep_first(m, ["scope", "k"], [F.desc("created_at"), F.desc("id")]).select(F.col("id").alias("__id"))
        kept = m.join(newest, F.col("id") == F.col("__id"), "left")
        return {"memories": kept.withColumn("valid_to", F.when(F.col("__id").isNull(), now).otherwise(F.col("valid_to"))).drop("__id")}

    state, done = C.run_passes({"memories": rows}, {"promote": lambda s: {"memories": C.promote(s["memories"], now)}, "conflict": conflicts}, "deep")
    return state["memories"].groupBy("tier").agg(F.count("*").alias("n"), F.count("valid_to").alias("retired"))


@query("""WITH old AS (SELECT p_brand AS phrase, CASE WHEN min(p_partkey) % 3 = 0 THEN 'canonical' ELSE 'hypothesis' END AS status FROM part WHERE p_size <= 25 GROUP BY 1), new AS (SELECT DISTINCT p_brand AS phrase FROM part WHERE p_size > 10)
SELECT phrase, status, status = 'hypothesis' AS ended FROM old UNION ALL SELECT phrase, 'hypothesis', false FROM new WHERE phrase NOT IN (SELECT phrase FROM old WHERE status = 'canonical')""")
def refreshed_themes(spark, d):
    """Themes anew: those that were only supposed end, new ones come in unless one that is sure says the same."""
    from palimpsest.operators.writing import retire_and_insert

    p, now = read_table(spark, d, "part"), F.lit("2024-01-01").cast("timestamp_ntz")
    old = p.where("p_size <= 25").groupBy(F.col("p_brand").alias("phrase")).agg(F.when(F.min("p_partkey") % 3 == 0, "canonical").otherwise("hypothesis").alias("status")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    new = p.where("p_size > 10").select(F.col("p_brand").alias("phrase")).distinct().select("phrase", F.lit("hypothesis").alias("status"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return retire_and_insert(old, new, ["phrase"], now).select("phrase", "status", F.col("valid_to").isNotNull().alias("ended"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'portfolio' WHEN 1 THEN 'writing' WHEN 2 THEN 'job-search' ELSE regexp_replace(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-'), '-+', '-', 'g') END AS project FROM part""")
def routed_projects(spark, d):
    """The project of an area that a text is about, else one of its title."""
    p, k = read_table(spark, d, "part"), F.col("p_partkey") % 4
    area = F.when(k == 2, "career").otherwise("content")
    text = F.when(k == 0, "a case study and a blog").when(k == 1, "one more essay").when(k == 2, "an interview").otherwise("nothing of the kind")
    return p.select(F.col("p_partkey").alias("id"), X.route_project(area, F.col("p_brand"), text).alias("project"))
