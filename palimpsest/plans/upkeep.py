"""Queries over the upkeep of a memory: what is distilled, merged, retired and promoted, and how its graph grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import consolidation as C
from palimpsest.operators import graph as G
from palimpsest.plans.graphs import _COS
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import EPISODES, PART_EDGES

_NOW = "2024-06-01"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


# Distilling ---------------------------------------------------------------------------------------------------------

_OPEN = f"""{EPISODES}, turn AS (SELECT id, scope, CASE WHEN id % 11 = 0 THEN 'ok thanks' ELSE content END AS content, CASE WHEN id % 13 = 0 THEN 'jrnl:1' WHEN id % 17 = 0 THEN NULL ELSE source_ref END AS source_ref, created_at FROM episodes),
left_ AS (SELECT * FROM turn t WHERE NOT starts_with(coalesce(source_ref, ''), 'jrnl:') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.id AND l.toxic = 1))"""


def _open(spark, d):
    e, k = roles.episodes(spark, d), F.col("id")
    e = e.withColumn("content", F.when(k % 11 == 0, "ok thanks").otherwise(F.col("content"))).withColumn("source_ref", F.when(k % 13 == 0, "jrnl:1").when(k % 17 == 0, F.lit(None)).otherwise(F.col("source_ref")))
    memories = read_table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_episode_id"))
    memories = memories.join(e.select(F.col("id").alias("source_episode_id"), "scope"), "source_episode_id")
    return C.to_distil(e, memories)


@query(f"WITH {_OPEN} SELECT id, (row_number() OVER (PARTITION BY scope ORDER BY created_at, id) - 1) // 6 AS batch FROM left_ WHERE NOT (length(trim(content)) < 12 OR content = 'ok thanks')")
def distil_batches(spark, d):
    """Episodes that no memory comes from yet, in batches of six, the oldest of a scope first."""
    return _open(spark, d)[0].select("id", "batch")


@query(f"WITH {_OPEN} SELECT id, '_distilled:' || id AS statement_key, 'working' AS tier FROM left_ WHERE length(trim(content)) < 12 OR content = 'ok thanks'")
def distil_markers(spark, d):
    """Trivial turns, marked as done."""
    return _open(spark, d)[1].select("id", "statement_key", "tier")


@query("""SELECT c_custkey AS episode, k AS kind, s AS statement, key AS statement_key FROM (SELECT c_custkey, unnest([{'k': 'fact', 's': 'Lives in ' || c_nationkey || '.', 'key': 'lives in ' || c_nationkey}, {'k': 'decision', 's': c_mktsegment || ' it is', 'key': lower(c_mktsegment) || ' it is'}], recursive := true) FROM customer)""")
def distilled_facts(spark, d):
    """At most three facts of an episode: kinds that aren't known and what is too short don't count, equal keys are one."""
    c = read_table(spark, d, "customer")
    fact = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.alias("statement"))
    lives = F.concat(F.lit("Lives in "), F.col("c_nationkey").cast("string"))
    facts = F.array(fact("gossip", F.lit("said something long")), fact("fact", F.concat(lives, F.lit("."))), fact("fact", F.lit("short")), fact("fact", F.lower(lives)), fact("decision", F.concat("c_mktsegment", F.lit(" it is"))), fact("fact", F.lit("one more than three")))
    return C.distil(c.select(F.col("c_custkey").alias("id"), F.lit("s").alias("scope"), "c_nationkey", "c_mktsegment"), facts).select("episode", "kind", "statement", "statement_key")


# Duplicates, conjectures, identity ----------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS newer, {_COS.format(a='a', b='b')} AS c, a.vec_id % 3 = b.vec_id % 3 AS same FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT id, max(newer) AS superseded_by FROM p WHERE c >= 0.35 OR (c >= 0.25 AND same) GROUP BY 1""")
def superseded_duplicates(spark, d):
    """Memories that a newer one repeats: alike enough, or alike and with an equal key."""
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), "embedding", F.col("vec_id").alias("created"), (F.col("vec_id") % 3).cast("string").alias("key"))
    return C.duplicates(v, tau=0.25, auto=0.35)


@query("""WITH m AS (SELECT item_id AS id, item_id % 3 AS scope, list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 120)), '[^a-z]+'), lambda w: length(w) >= 3)) AS w FROM benchmark),
p AS (SELECT a.id AS id1, b.id AS id2, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM m a JOIN m b ON a.scope = b.scope AND a.id < b.id WHERE len(a.w) >= 3 AND len(b.w) >= 3)
SELECT id1, id2, overlap::DOUBLE AS overlap FROM p WHERE overlap BETWEEN 0.1 AND 0.7 ORDER BY overlap DESC, id1, id2 LIMIT 20""")
def conjectures(spark, d):
    """Pairs of statements of a scope that overlap in words, but not too much."""
    b = read_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 3).alias("scope"), F.substring("text", 1, 120).alias("statement"), F.lit("canonical").alias("status"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return C.recombine(b, least=0.1).select("id1", "id2", "overlap")


@query("""WITH c AS (SELECT o_custkey AS scope, o_orderpriority AS predicate, CASE WHEN o_orderkey % 5 = 0 THEN '[turn 1] x' ELSE o_orderstatus END AS object, CASE WHEN o_orderkey % 7 = 0 THEN 0.6 ELSE o_orderkey % 10 / 10 END::DOUBLE AS confidence, o_orderkey AS seq FROM orders),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, predicate ORDER BY confidence DESC, seq) AS k FROM c WHERE NOT contains(object, '[turn')) WHERE k = 1)
SELECT scope, predicate, object, confidence FROM b WHERE NOT (object = 'F' AND scope % 2 = 0)""")
def identity_promotions(spark, d):
    """What reflections suggest about someone, the best of each predicate, as far as it isn't known."""
    o = read_table(spark, d, "orders")
    cands = o.select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("predicate"), F.when(F.col("o_orderkey") % 5 == 0, "[turn 1] x").otherwise(F.col("o_orderstatus")).alias("object"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 10) / 10).alias("confidence"), F.col("o_orderkey").alias("seq"))
    facts = cands.select("scope", "predicate").distinct().where("scope % 2 = 0").select("scope", "predicate", F.lit("F").alias("object"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return C.promote_identity(cands, facts)


@query("""WITH r AS (SELECT user_id, max(event_id) AS seq FROM events GROUP BY 1), x AS (SELECT user_id AS scope, seq, unnest([seq % 4, seq % 4 + 1]) AS id, unnest(['completed', 'stale']) AS said FROM r)
SELECT g.user_id AS scope, g.id, coalesce(said, 'open') AS status, CASE WHEN said = 'completed' THEN 1.0 ELSE 0.25 END::DOUBLE AS progress FROM (SELECT DISTINCT user_id, unnest(range(6)) AS id FROM events) g LEFT JOIN x ON x.scope = g.user_id AND x.id = g.id""")
def goal_deltas(spark, d):
    """Goals after the latest report of their scope."""
    e = roles.events(spark, d)
    delta = lambda n, s: F.struct((F.col("event_id") % 4 + n).alias("goal_id"), F.lit(s).alias("status"))
    reports = e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), F.array(delta(0, "completed"), delta(1, "stale")).alias("deltas"))
    goals = e.select(F.col("user_id").alias("scope")).distinct().withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("status", F.lit("open")).withColumn("progress", F.lit(0.25))
    return C.apply_goal_deltas(goals, reports)


@query("SELECT o_custkey AS scope, 'prefers ' || o_orderpriority AS statement FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 GROUP BY 1, 2 HAVING o_custkey % 2 = 1")
def principle_mirror(spark, d):
    """Current principles that no memory says yet, without those that only count words."""
    o = read_table(spark, d, "orders")
    said = F.concat(F.lit("prefers "), "o_orderpriority")
    p = o.select(F.col("o_custkey").alias("scope"), F.when(F.col("o_orderkey") % 3 == 0, "'use' appears 4 times").otherwise(said).alias("statement"), F.when(F.col("o_orderkey") % 4 == 0, _now()).alias("valid_to"))
    m = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("scope"), said.alias("statement"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return C.mirror_principles(p, m)


@query("SELECT CASE event_type WHEN 'click' THEN 'stored' WHEN 'error' THEN 'invalidated' ELSE 'noop' END AS action, count(*) AS n, count(DISTINCT user_id) AS scopes FROM events GROUP BY 1")
def projection_actions(spark, d):
    kind = F.when(F.col("event_type") == "click", "stored").when(F.col("event_type") == "error", "invalidated").otherwise("other")
    return C.action_histogram(roles.events(spark, d).select(F.col("user_id").alias("scope"), kind.alias("kind")))


# The graph ----------------------------------------------------------------------------------------------------------

_VEC_EDGES = "SELECT vec_id AS src, vec_id + 3 AS dst FROM embeddings WHERE vec_id % 5 = 0 AND vec_id + 3 <= (SELECT max(vec_id) FROM embeddings)"


def _vec_graph(spark, d):
    v = read_table(spark, d, "embeddings")
    top = v.agg(F.max("vec_id")).first()[0]
    edges = v.where((F.col("vec_id") % 5 == 0) & (F.col("vec_id") + 3 <= top)).select(F.col("vec_id").alias("edge_id"), F.col("vec_id").alias("src"), (F.col("vec_id") + 3).alias("dst"))
    return v.select(F.col("vec_id").alias("id"), F.col("label").alias("episode"), "embedding"), edges


@query(f"""WITH e AS ({_VEC_EDGES}), h AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM e),
n AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS id, {_COS.format(a='a', b='b')} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a', b='b')}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5),
s AS (SELECT least(q, id) AS lo, greatest(q, id) AS hi, max(score) AS score, 2 AS o FROM n WHERE score >= 0.4 GROUP BY 1, 2),
c AS (SELECT a.vec_id AS lo, b.vec_id AS hi, {_COS.format(a='a', b='b')} AS score, 1 AS o FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS.format(a='a', b='b')} >= 0.35),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY o) AS k FROM (SELECT * FROM c UNION ALL SELECT * FROM s) u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lo = u.lo AND h.hi = u.hi)) WHERE k = 1),
t AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT lo FROM f UNION SELECT hi FROM f),
r AS (SELECT least(q, id) AS lo, greatest(q, id) AS hi, max(score) AS score FROM n WHERE rank = 1 AND q NOT IN (SELECT id FROM t) GROUP BY 1, 2)
SELECT lo, hi, CASE o WHEN 1 THEN 'cooccurrence' ELSE 'similarity' END AS method, round(score, 3) AS score FROM f UNION ALL SELECT lo, hi, 'orphan_rescue', round(score, 3) FROM r""")
def densified_edges(spark, d):
    """Edges that the graph lacks, by co-occurrence, by likeness, and for nodes that have none."""
    return G.densify(*_vec_graph(spark, d), strong=0.4, together=0.35).select("lo", "hi", "method", "score")


@query(f"""WITH RECURSIVE v AS (SELECT * FROM embeddings), e AS (SELECT vec_id AS u, vec_id + 3 AS w FROM v WHERE vec_id % 5 <> 0 AND vec_id + 3 <= (SELECT max(vec_id) FROM v)), b AS (SELECT u, w FROM e UNION ALL SELECT w, u FROM e),
r AS (SELECT vec_id AS id, vec_id AS place FROM v UNION SELECT r.id, b.w FROM r JOIN b ON b.u = r.place), c AS (SELECT id, min(place) AS component FROM r GROUP BY 1),
m AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
p AS (SELECT ca.component, a.vec_id AS src, z.vec_id AS dst, round({_COS.format(a='a', b='z')}, 9) AS score FROM v a JOIN c ca ON ca.id = a.vec_id AND ca.component NOT IN (SELECT * FROM m) JOIN v z ON true JOIN c cz ON cz.id = z.vec_id AND cz.component IN (SELECT * FROM m))
SELECT component, src, dst, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, src, dst) AS k FROM p) WHERE k = 1""")
def island_bridges(spark, d):
    """Each component that isn't the largest, tied to it where the two are most alike."""
    v = read_table(spark, d, "embeddings")
    last = v.agg(F.max("vec_id")).first()[0]
    edges = v.where((F.col("vec_id") % 5 != 0) & (F.col("vec_id") + 3 <= last)).select(F.col("vec_id").alias("src"), (F.col("vec_id") + 3).alias("dst"))
    return G.bridges(v.select(F.col("vec_id").alias("id"), "embedding"), edges)


@query(f"""WITH e AS ({_VEC_EDGES}), b AS (SELECT src AS u, dst AS w, src AS edge_id FROM e UNION ALL SELECT dst, src, src FROM e), s AS (SELECT DISTINCT u AS node FROM b WHERE u % 50 = 0), o AS (SELECT DISTINCT w AS node FROM b JOIN s ON u = node WHERE w NOT IN (SELECT node FROM s))
SELECT DISTINCT edge_id, hop FROM (SELECT edge_id, 1::BIGINT AS hop FROM b JOIN s ON u = node UNION ALL SELECT edge_id, 2 FROM b JOIN o ON u = node)""")
def expanded_edges(spark, d):
    """The edges that two steps from some nodes touch, with the step."""
    _, edges = _vec_graph(spark, d)
    return G.touched_edges(edges, edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node % 50 = 0"), 2)


@query(f"""WITH {PART_EDGES}, n AS (SELECT DISTINCT dst AS node, p_brand AS name, src FROM edges JOIN part ON p_partkey * 2 = src), g AS (SELECT node, name, row_number() OVER (PARTITION BY node ORDER BY name) AS k FROM (SELECT DISTINCT node, name FROM n))
SELECT node, (SELECT count(DISTINCT src) FROM n WHERE n.node = g.node) AS n_others, string_agg(name, ',' ORDER BY name) AS others FROM g WHERE k <= 6 GROUP BY 1""")
def neighbourhood_names(spark, d):
    names = read_table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_brand").alias("name"))
    return G.neighbourhoods(roles.part_edges(spark, d), names)


@query(f"""WITH m AS (SELECT vec_id AS mention, label % 3 AS scope, CASE WHEN vec_id % 4 = 0 THEN ' Name  ' || (vec_id % 40) WHEN vec_id % 9 = 0 THEN 'x' ELSE 'only ' || vec_id END AS name, embedding FROM embeddings WHERE vec_id % 2 = 0),
e AS (SELECT vec_id AS id, label % 3 AS scope, 'name ' || (vec_id % 40) AS name, embedding FROM embeddings WHERE vec_id % 2 = 1 OR vec_id % 40 = 8),
k AS (SELECT *, regexp_replace(trim(lower(name)), '\\s+', ' ', 'g') AS key FROM m), k2 AS (SELECT * FROM k WHERE length(key) >= 2),
s AS (SELECT mention, min(e.id) AS same FROM k2 JOIN e ON e.scope = k2.scope AND e.name = key GROUP BY 1),
n AS (SELECT * FROM (SELECT k2.mention, e.id AS near, round({_COS.format(a='k2', b='e')}, 9) AS c, row_number() OVER (PARTITION BY k2.mention ORDER BY round({_COS.format(a='k2', b='e')}, 9) DESC, e.id) AS r FROM k2 JOIN e ON e.scope = k2.scope AND e.id <> k2.mention WHERE k2.mention NOT IN (SELECT mention FROM s)) WHERE r = 1 AND c >= 0.35)
SELECT k2.mention, coalesce(same, near, k2.mention) AS entity, CASE WHEN same IS NOT NULL THEN 'name' WHEN near IS NOT NULL THEN 'nearest' ELSE 'new' END AS how FROM k2 LEFT JOIN s USING (mention) LEFT JOIN n USING (mention)""")
def resolved_mentions(spark, d):
    """Mentions to entities: by name, by likeness, or as new ones."""
    v, k = read_table(spark, d, "embeddings"), F.col("vec_id")
    s = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit(" Name  "), (k % 40).cast("string"))).when(k % 9 == 0, "x").otherwise(F.concat(F.lit("only "), s))
    m = v.where("vec_id % 2 = 0").select(k.alias("mention"), (F.col("label") % 3).alias("scope"), name.alias("name"), "embedding")
    e = v.where("vec_id % 2 = 1 or vec_id % 40 = 8").select(k.alias("id"), (F.col("label") % 3).alias("scope"), F.concat(F.lit("name "), (k % 40).cast("string")).alias("name"), "embedding", k.alias("created_at"))
    return G.resolve(m, e, tau=0.35)


_TRIPLES = """t AS (SELECT o_custkey % 7 AS scope, o_orderkey AS episode, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS subject, 'is' AS predicate, CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 13 = 0 THEN 'x' ELSE 'State ' || o_orderstatus END AS object FROM orders),
k AS (SELECT *, lower(subject) AS s, lower(object) AS o FROM t WHERE length(object) >= 2 AND lower(subject) <> lower(object))"""


def _projected(spark, d):
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey")
    subject = F.when(k % 3 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    obj = F.when(k % 11 == 0, F.lower("o_orderpriority")).when(k % 13 == 0, "x").otherwise(F.concat(F.lit("State "), "o_orderstatus"))
    return G.project_triples(o.select((F.col("o_custkey") % 7).alias("scope"), k.alias("episode"), subject.alias("subject"), F.lit("is").alias("predicate"), obj.alias("object")))


@query(f"WITH {_TRIPLES}, m AS (SELECT scope, episode, s AS name, subject AS alias FROM k UNION ALL SELECT scope, episode, o, object FROM k) SELECT scope, name, count(DISTINCT episode) AS mention_count, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM m GROUP BY 1, 2")
def projected_entities(spark, d):
    """Entities of what episodes say, with the ways they are written and how many episodes mention them."""
    return _projected(spark, d)[0]


@query(f"WITH {_TRIPLES} SELECT scope, s AS src, o AS dst, predicate AS rel_type, min(episode) AS episode, count(*) AS n FROM k GROUP BY 1, 2, 3, 4")
def projected_edges(spark, d):
    return _projected(spark, d)[1]


@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN 'Tool' ELSE p_brand END AS label, CASE WHEN p_partkey % 4 = 2 THEN 'canonical' ELSE 'hypothesis' END AS status, CASE WHEN p_partkey % 8 = 0 THEN TIMESTAMP '2020-01-01' WHEN p_partkey % 4 = 0 THEN TIMESTAMP '{_NOW}' END AS valid_to FROM part""")
def entity_actions(spark, d):
    """Nodes after decisions to prune, retype and claim some of them."""
    p, k = read_table(spark, d, "part"), F.col("p_partkey")
    nodes = p.select(k.alias("id"), F.col("p_brand").alias("label"), F.lit("hypothesis").alias("status"), F.when(k % 8 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("valid_to"))
    action = F.when(k % 4 == 0, "prune").when(k % 4 == 1, "retype").otherwise("claim")
    return G.apply_actions(nodes, p.where("p_partkey % 4 < 3").select(k.alias("id"), action.alias("action"), F.lit("Tool").alias("label")), _now())


@query(f"""WITH {PART_EDGES}, h AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30),
x AS (SELECT src AS node, dst AS other, edge_id, 'out' AS direction FROM edges UNION ALL SELECT dst, src, edge_id, 'in' FROM edges), r AS (SELECT x.*, degree, row_number() OVER (PARTITION BY x.node ORDER BY edge_id, direction, other) AS k FROM x JOIN h USING (node))
SELECT node, any_value(degree) AS degree, string_agg(CASE direction WHEN 'out' THEN '-> ' ELSE '<- ' END || coalesce(p_brand, other::VARCHAR), '; ' ORDER BY k) AS line FROM r LEFT JOIN part ON p_partkey * 2 = other WHERE k <= 4 GROUP BY 1""")
def graph_lines(spark, d):
    """The hubs, each with a line of its first relations."""
    nodes = read_table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_brand").alias("name"))
    return G.context_lines(nodes, roles.part_edges(spark, d), 30)
