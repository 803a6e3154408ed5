"""Queries over recall: channels with their filters, what is done where they find nothing, and what comes after fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.operators import relational as R
from palimpsest.operators import retrieval as V
from palimpsest.operators.temporal import as_of
from palimpsest.plans.graphs import _COS, _DENSE, _SPARSE, _recall_channels
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import EPISODES

_AT = "2024-01-10"
#: Vectors as memories: a scope of five, a status by id, valid for thirty days.
_MEMORIES = """mem AS (SELECT vec_id AS id, 's' || (label % 5) AS scope, CASE vec_id % 4 WHEN 0 THEN 'canonical' WHEN 1 THEN 'belief' WHEN 2 THEN 'hypothesis' ELSE 'retracted' END AS status,
  TIMESTAMP '2024-01-01' + to_hours((vec_id % 400)::INT) AS valid_from, CASE WHEN vec_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours((vec_id % 400 + 100)::INT) END AS valid_to, embedding FROM embeddings)"""


def _memories(spark, d):
    v, hours = read_table(spark, d, "embeddings"), F.col("vec_id") % 400
    at = lambda h: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h.cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("canonical", "belief", "hypothesis", "retracted"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return v.select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), (F.col("label") % 5).cast("string")).alias("scope"), status.alias("status"), at(hours).alias("valid_from"), F.when(F.col("vec_id") % 3 == 0, at(hours + 100)).alias("valid_to"), "embedding")


def _dense_sql(mode: str, k: int) -> str:
    statuses = ", ".join(f"'{s}'" for s in L.MODE_STATUSES[mode])
    return f"""WITH {_MEMORIES}, q AS (SELECT * FROM mem WHERE id % 50 = 0), m AS (SELECT * FROM mem WHERE status IN ({statuses}) AND valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_AT}'))
SELECT query, id, round(score, 6) AS score, rank FROM (SELECT q.id AS query, m.id, {_COS.format(a='q', b='m')} AS score, row_number() OVER (PARTITION BY q.id ORDER BY round({_COS.format(a='q', b='m')}, 9) DESC, m.id) AS rank FROM q JOIN m ON m.scope = q.scope AND m.id <> q.id) WHERE rank <= {k}"""


def _dense(spark, d, mode):
    m = _memories(spark, d)
    asked = m.where("id % 50 = 0").select(F.col("id").alias("query"), "scope", "embedding")
    return V.dense_channel(m, asked, F.lit(_AT).cast("timestamp_ntz"), mode).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(_dense_sql("fast", 20))
def dense_recall_fast(spark, d):
    return _dense(spark, d, "fast")


@query(_dense_sql("divergent", 50))
def dense_recall_divergent(spark, d):
    """Also what is only supposed."""
    return _dense(spark, d, "divergent")


_ALL = _SPARSE.replace("sc AS (SELECT item, id, sum(", "need AS (SELECT item, count(*) AS need FROM q GROUP BY 1), sc AS (SELECT item, id, count(*) AS n, sum(")


@query(f"""WITH {_ALL}, strict AS (SELECT item, id, score FROM sc JOIN need USING (item) WHERE n = need), chosen AS (SELECT * FROM strict UNION ALL SELECT item, id, score FROM sc WHERE item NOT IN (SELECT item FROM strict))
SELECT item AS query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, id) AS rank FROM chosen) WHERE rank <= 20""")
def sparse_recall_strict(spark, d):
    """All words of an item, or any where no document has all."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = V.sparse_channel(docs, read_table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), 20)
    return rows.select("query", "id", F.round("score", 6).alias("score"), "rank")


_GRAPH = """ent AS (SELECT p_partkey AS id, p_partkey % 211 AS episode, CASE WHEN p_size % 5 = 0 THEN 'hypothesis' ELSE 'canonical' END AS status FROM part),
edges AS (SELECT p_partkey AS src, (p_partkey * 7) % (SELECT count(*) FROM part) + 1 AS dst FROM part WHERE p_partkey % 3 = 0),
mem AS (SELECT o_orderkey AS id, o_custkey % 211 AS episode, CASE o_orderstatus WHEN 'P' THEN 'hypothesis' ELSE 'canonical' END AS status FROM orders),
seeds AS (SELECT id % 4 AS query, id FROM mem WHERE id % 997 = 0)"""


@query(f"""WITH {_GRAPH}, se AS (SELECT DISTINCT query, episode FROM seeds JOIN mem USING (id)), n0 AS (SELECT DISTINCT query, ent.id AS node FROM se JOIN ent USING (episode) WHERE status = 'canonical'),
n1 AS (SELECT DISTINCT query, dst AS node FROM n0 JOIN edges ON src = node), n2 AS (SELECT DISTINCT query, dst AS node FROM n1 JOIN edges ON src = node),
w AS (SELECT query, node, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM n0 UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2) GROUP BY 1, 2),
ep AS (SELECT query, episode, min(depth) AS depth FROM w JOIN ent ON ent.id = node GROUP BY 1, 2)
SELECT query, mem.id, depth::BIGINT AS depth, round(1 / (1 + depth), 6)::DOUBLE AS score FROM ep JOIN mem USING (episode) WHERE status = 'canonical'""")
def graph_recall(spark, d):
    """From seed memories by their episodes' entities over two steps of the graph to other memories."""
    p, o = read_table(spark, d, "part"), read_table(spark, d, "orders")
    n = p.count()
    ent = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 211).alias("episode"), F.when(F.col("p_size") % 5 == 0, "hypothesis").otherwise("canonical").alias("status"))
    edges = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7) % n + 1).alias("dst"))
    mem = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 211).alias("episode"), F.when(F.col("o_orderstatus") == "P", "hypothesis").otherwise("canonical").alias("status"))
    seeds = mem.where("id % 997 = 0").select((F.col("id") % 4).alias("query"), "id")
    return V.graph_channel(seeds, mem, ent, edges, 2).select("query", "id", "depth", F.round("score", 6).alias("score"))


@query(f"""WITH {_SPARSE}, {_DENSE}, u AS (SELECT DISTINCT query, id FROM (SELECT query, id FROM dense UNION ALL SELECT item * 50, id FROM sparse)),
s AS (SELECT query, u.id, round(coalesce({_COS.format(a='a', b='b')}, -1), 9) AS score FROM u LEFT JOIN embeddings a ON a.vec_id = query LEFT JOIN embeddings b ON b.vec_id = u.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)
SELECT query, r.id, rank, round(score, 4) AS score, substr(text, 1, 200) AS text FROM r JOIN documents ON doc_id = r.id WHERE rank <= 10""")
def recall_by_cosine(spark, d):
    """What all channels found, by its true likeness to the query; what has no vector last. The heads of the texts as shown."""
    v = read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    fused = V.rrf(_recall_channels(spark, d))
    best = V.rerank(fused, v.select(F.col("id").alias("query"), "embedding"), v, 10)
    return best.join(roles.episodes(spark, d).select("id", "content"), "id").select("query", "id", "rank", F.round("score", 4).alias("score"), F.substring("content", 1, 200).alias("text"))


@query(f"""WITH {_SPARSE}, f AS (SELECT item, count(*) AS n, max(score) AS best FROM sparse WHERE item % 3 <> 0 AND (item % 3 <> 1 OR rank <= 2) GROUP BY 1),
a AS (SELECT item_id, 'alpha beta gamma delta ' || item_id || CASE WHEN item_id % 2 = 0 THEN ' and Other Things' ELSE '' END AS t, coalesce(n, 0) AS n FROM benchmark LEFT JOIN f ON item = item_id)
SELECT item_id AS query, CASE WHEN n = 0 THEN t || ' details' ELSE 'Other things' END AS text FROM a WHERE n = 0 OR (n < 3 AND item_id % 2 = 0)""")
def recall_follow_ups(spark, d):
    """Second questions where the first find nothing, or too little of several aspects."""
    docs, b = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), read_table(spark, d, "benchmark")
    found = V.bm25(docs, b.select(F.col("item_id").alias("query"), "text"), 20, all_terms=False).where("query % 3 <> 0 and (query % 3 <> 1 or rank <= 2)")
    said = F.concat(F.lit("alpha beta gamma delta "), F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, " and Other Things").otherwise(""))
    return V.follow_up_queries(b.select(F.col("item_id").alias("query"), said.alias("text")), found)


@query(f"""WITH {EPISODES}, e AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'agent:' || id ELSE source_ref END AS ref FROM episodes), m AS (SELECT * FROM e WHERE split_part(ref, ':', 1) NOT IN ('agent', 'meta', 'reflection')),
q AS (SELECT * FROM (VALUES ('a', 'the '), ('b', 'zzzqqq'), ('c', 'und')) AS t(query, needle)), f AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY created_at DESC, id) AS rank FROM q JOIN m ON contains(lower(content), needle)),
l AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m)
SELECT query, id, 'match' AS origin, rank FROM f WHERE rank <= 20 UNION ALL SELECT query, id, 'recent', rank FROM q, l WHERE rank <= 12 AND query NOT IN (SELECT query FROM f)""")
def narrative_material(spark, d):
    e = roles.episodes(spark, d).withColumn("source_ref", F.when(F.col("id") % 9 == 0, F.concat(F.lit("agent:"), F.col("id").cast("string"))).otherwise(F.col("source_ref")))
    return V.narrative_material(e, spark.createDataFrame([("a", "the "), ("b", "zzzqqq"), ("c", "und")], "query string, text string"))


@query(f"""WITH {_MEMORIES}, q AS (SELECT * FROM mem WHERE id % 100 = 0), m AS (SELECT * FROM mem WHERE status = 'canonical' AND (id % 5 = 0 OR id % 8 = 4))
SELECT query, id, round(score, 6) AS score, rank FROM (SELECT q.id AS query, m.id, {_COS.format(a='q', b='m')} AS score, row_number() OVER (PARTITION BY q.id ORDER BY round({_COS.format(a='q', b='m')}, 9) DESC, m.id) AS rank FROM q JOIN m ON m.id <> q.id) WHERE rank <= 5""")
def similar_lessons(spark, d):
    """The nearest lessons of a status whose conditions are empty or name the domain."""
    from palimpsest.functions import jsons as J

    m = _memories(spark, d).withColumn("conditions", F.when(F.col("id") % 5 == 0, "{}").when(F.col("id") % 8 == 4, '{"domain": "work"}').otherwise('{"domain": "play"}'))
    gated = m.where("status = 'canonical'").where(J.empty_or_has(F.col("conditions"), "domain", "work"))
    return V.knn(m.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding"), gated, 5).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_SPARSE}, k AS (SELECT item_id AS item, doc_id AS id, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark JOIN documents ON contains(lower(documents.text), 'the') WHERE item_id % 2 = 0)
SELECT item AS query, id, round(score, 6) AS score, rank FROM sparse WHERE item % 2 = 1 UNION ALL SELECT item, id, score, rank FROM k WHERE rank <= 5""")
def recall_or_keywords(spark, d):
    """Documents that hold a keyword, where recall has failed (here: for every other item)."""
    b, docs = read_table(spark, d, "benchmark"), read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = V.bm25(docs, b.select(F.col("item_id").alias("query"), "text"), 20, all_terms=False).where("query % 2 = 1").select("query", "id", F.round("score", 6).alias("score"), "rank")
    first = docs.where(F.contains(F.lower("text"), F.lit("the"))).orderBy("id").limit(5)
    spare = R.top_per_key(first.withColumn("all", F.lit(0)), ["all"], ["id"], 5)
    spare = b.select(F.col("item_id").alias("query"), F.lit(0).alias("all")).join(F.broadcast(spare), "all")
    return V.or_else(found, spare.select("query", "id", F.lit(0.0).alias("score"), "rank").where("query % 2 = 0"))


@query(f"WITH {_MEMORIES} SELECT scope, status, count(*) AS n FROM mem WHERE valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_AT}') AND status IN ('canonical', 'belief') GROUP BY 1, 2")
def recallable(spark, d):
    m = as_of(_memories(spark, d), F.lit(_AT).cast("timestamp_ntz")).where(F.col("status").isin(*L.MODE_STATUSES["deep"]))
    return m.groupBy("scope", "status").agg(F.count("*").alias("n"))
