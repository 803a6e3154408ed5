"""Queries over property graphs and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators import graph as G
from palimpsest.operators import retrieval as R
from palimpsest.operators.relational import keep_first
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import CHAIN_EDGES, PART_EDGES


@query(f"WITH {PART_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def degree_hubs(spark, d):
    return G.hubs(roles.part_edges(spark, d), 20)


@query(f"WITH {PART_EDGES}, s AS (SELECT unnest([3, 5, 4]) AS node) SELECT node, other, edge_id, direction FROM (SELECT src AS node, dst AS other, edge_id, 'out' AS direction FROM edges UNION ALL SELECT dst, src, edge_id, 'in' FROM edges) WHERE node IN (SELECT node FROM s)")
def neighbors_both(spark, d):
    seeds = spark.createDataFrame([(3,), (5,), (4,)], "node long")
    return G.neighbours(roles.part_edges(spark, d), seeds)


@query(f"""WITH RECURSIVE {CHAIN_EDGES}, walk(node, depth) AS (SELECT 'c7', 0::BIGINT UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
SELECT node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY 1""")
def khop_directed(spark, d):
    return G.k_hop(roles.chain_edges(spark, d), spark.createDataFrame([("c7",)], "node string"), 3)


@query(f"""WITH RECURSIVE {CHAIN_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk(node, depth) AS (SELECT 'o7', 0::BIGINT UNION SELECT e.b, w.depth + 1 FROM walk w JOIN both_ways e ON e.a = w.node WHERE w.depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0""")
def khop_undirected(spark, d):
    return G.k_hop(roles.chain_edges(spark, d), spark.createDataFrame([("o7",)], "node string"), 3, directed=False)


@query("SELECT node, min(o) OVER (PARTITION BY o_custkey) AS component FROM (SELECT o_custkey, o_custkey * 10 + 1 AS node, o_custkey * 10 + 1 AS o FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT o_custkey, o_orderkey * 10 + 2, o_orderkey * 10 + 2 FROM orders)")
def components(spark, d):
    o = read_table(spark, d, "orders")
    return G.components(o.select((F.col("o_custkey") * 10 + 1).alias("src"), (F.col("o_orderkey") * 10 + 2).alias("dst")))


@query("SELECT old, new FROM (SELECT p_partkey AS old, first_value(p_partkey) OVER (PARTITION BY p_type, regexp_replace(lower(p_brand || p_size), '[^a-z0-9]', '', 'g') ORDER BY p_partkey) AS new FROM part) WHERE old <> new")
def merge_entities(spark, d):
    nodes = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("scope"), F.concat("p_brand", F.col("p_size").cast("string")).alias("name"))
    return G.merge_map(nodes, X.alnum_key(F.col("name")), ["id"])


@query(f"""WITH {PART_EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT old, new FROM (SELECT p_partkey AS old, first_value(p_partkey) OVER (PARTITION BY p_type, p_brand, p_size ORDER BY coalesce(degree, 0) DESC, p_partkey) AS new FROM part LEFT JOIN d ON node = p_partkey * 2) WHERE old <> new""")
def canonical_by_degree(spark, d):
    nodes = read_table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_type").alias("scope"), "p_brand", "p_size")
    rows = G.merge_map(G.with_degree(nodes, roles.part_edges(spark, d)), F.struct("p_brand", "p_size"), [F.desc("degree"), F.asc("id")])
    return rows.select((F.col("old") / 2).cast("long").alias("old"), (F.col("new") / 2).cast("long").alias("new"))


@query(f"""WITH {PART_EDGES}, m AS (SELECT p_partkey * 2 AS old, min(p_partkey * 2) OVER (PARTITION BY p_type, p_brand, p_size) AS new FROM part),
r AS (SELECT edge_id, coalesce(m.new, src) AS src, dst, rel_type FROM edges LEFT JOIN m ON m.old = src) SELECT min(edge_id) AS edge_id, src, dst, rel_type FROM r GROUP BY src, dst, rel_type""")
def merged_edges(spark, d):
    nodes = read_table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_type").alias("scope"), "p_brand", "p_size")
    return G.merge_edges(roles.part_edges(spark, d), G.merge_map(nodes, F.struct("p_brand", "p_size"), ["id"]))


@query("SELECT a.l_partkey AS lo, b.l_partkey AS hi, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2")
def densify_cooccurrence(spark, d):
    return G.cooccurrence(read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("node")))


@query(f"""WITH {PART_EDGES}, h AS (SELECT * FROM (SELECT src FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 60) UNION ALL SELECT * FROM (SELECT dst FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 60)) SELECT edge_id, src, dst FROM edges WHERE src IN (SELECT src FROM h) AND dst IN (SELECT src FROM h)""")
def graph_view(spark, d):
    """The edges among the hubs of both sides."""
    e = roles.part_edges(spark, d)
    side = lambda c: e.groupBy(F.col(c).alias("node")).count().orderBy(F.desc("count"), "node").limit(60).select("node")
    return G.induced(e, side("src").unionByName(side("dst"))).select("edge_id", "src", "dst")


@query(f"""WITH {PART_EDGES} SELECT dst AS node, count(*) AS n_edges, count(DISTINCT src) AS n_others, count(DISTINCT rel_type) AS n_types, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS types FROM edges GROUP BY 1""")
def relation_types(spark, d):
    e = roles.part_edges(spark, d)
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_others"), F.countDistinct("rel_type").alias("n_types"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("types"))


_COS = "list_cosine_similarity({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[])"


@query(f"""SELECT query, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS.format(a='a', b='b')} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a', b='b')}, 9) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def knn_exact(spark, d):
    v = read_table(spark, d, "embeddings")
    return R.knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"), v.withColumnRenamed("vec_id", "id"), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH p AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1), s AS (SELECT v.vec_id AS id, v.label, p.label AS nearest, row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_COS.format(a='v', b='p')}, 9) DESC, p.label) AS n FROM embeddings v, p)
SELECT id, label, nearest FROM s WHERE n = 1""")
def nearest_prototype(spark, d):
    v = read_table(spark, d, "embeddings")
    # Labels are other ids than the vectors', so no vector is left out as itself.
    prototypes = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumn("id", F.col("label").cast("long") - (1 << 40))
    near = R.knn(v.select(F.col("vec_id").alias("query"), "embedding"), prototypes, 1)
    return v.select(F.col("vec_id").alias("query"), "label").join(near, "query").select(F.col("query").alias("id"), "label", (F.col("id") + (1 << 40)).cast("int").alias("nearest"))


@query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings), 2) AS share FROM embeddings GROUP BY 1")
def breadth(spark, d):
    v = read_table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return v.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def _recall_channels(spark, d):
    """Vectors whose id is divisible by 50 ask; the benchmark item of a fiftieth of the id is the query's text. Documents and vectors share ids."""
    v = read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    texts = read_table(spark, d, "benchmark").select((F.col("item_id") * 50).alias("query"), "text")
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return {"dense": R.knn(asked, v, 20), "sparse": R.bm25(docs, texts, 20, all_terms=False)}


_TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"
_SPARSE = f"""t AS MATERIALIZED (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), w AS (SELECT id, len(t) AS n_words, unnest(t) AS term FROM t), q AS MATERIALIZED (SELECT item_id AS item, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM t), tf AS MATERIALIZED (SELECT term, id, n_words, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT item, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / mean))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT item, id, score, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 20)"""


@query(f"WITH {_SPARSE} SELECT item * 50 AS query, id, round(score, 6) AS score, rank FROM sparse")
def sparse_recall(spark, d):
    return _recall_channels(spark, d)["sparse"].select("query", "id", F.round("score", 6).alias("score"), "rank")


_DENSE = f"""dense AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS.format(a='a', b='b')} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a', b='b')}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 20)"""


@query(f"""WITH {_SPARSE}, {_DENSE}, u AS (SELECT query, id, score, rank, 'dense' AS c FROM dense UNION ALL SELECT item * 50, id, score, rank, 'sparse' FROM sparse)
SELECT query, id, round(sum(1 / (60 + rank)), 6) AS fused_score, round(max(score), 6) AS raw_score, count(*) AS n_channels, string_agg(c, ',' ORDER BY c) AS channels FROM u GROUP BY 1, 2""")
def rrf_fusion(spark, d):
    rows = R.rrf(_recall_channels(spark, d))
    return rows.select("query", "id", F.round("fused_score", 6).alias("fused_score"), F.round("raw_score", 6).alias("raw_score"), "n_channels", "channels")


def recall(spark, d, budget: int = 4000, divergent: bool = False):
    """Both channels, fused with recency, diversified if asked for, packed to the budget, best first and second best last."""
    eps = roles.episodes(spark, d)
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    fused = R.rrf(_recall_channels(spark, d), R.recency_of(eps, now))
    top = Window.partitionBy("query").orderBy(F.desc(F.round("fused_score", 12)), "id")
    ranked = fused.withColumn("place", F.row_number().over(top).cast("long")).where("place <= 30")
    texts = eps.select("id", F.col("content").alias("text"), "lang")
    rows = ranked.join(texts, "id")
    words = X.word_set(F.col("text")) if divergent else F.array().cast("array<string>")
    item = F.struct("place", F.col("fused_score").alias("score"), F.when(F.col("lang") == "en", "semantic").otherwise("episodic").alias("tier"), (X.token_estimate(F.col("text")) + 5).alias("tokens"), F.trim(F.lower(F.substring("text", 1, 100))).alias("head"), "id", words.alias("words"))
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    if divergent:
        picked = lists.withColumn("order", R.mmr_fold(F.col("items"), 30))
        lists = picked.withColumn("items", F.transform("order", lambda p: F.element_at(F.filter("items", lambda x: x["place"] == p), 1)))
    lists = lists.withColumn("kept", R.pack_fold(F.col("items"), budget))
    out = lists.select("query", F.posexplode(F.filter("items", lambda x: F.array_contains(F.col("kept"), x["place"]))).alias("k", "x"), F.size("kept").alias("n"))
    return out.select("query", F.col("x.id").alias("id"), R.lost_in_the_middle(F.col("k") + 1, F.col("n")).alias("place"), F.round("x.score", 6).alias("score"), F.col("x.tokens").alias("tokens"))


@query()
def context_pack(spark, d):
    return recall(spark, d)


@query()
def mmr(spark, d):
    return recall(spark, d, divergent=True)


@query(f"""WITH RECURSIVE l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS.format(a='a', b='b')} >= 0.35), r AS (SELECT vec_id AS id, vec_id AS at FROM embeddings UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.at),
n AS (SELECT u AS id, count(*) AS n_links FROM l GROUP BY 1) SELECT id, min(at) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM r LEFT JOIN n USING (id) GROUP BY 1""".replace(" AS at ", " AS place ").replace(", at ", ", place ").replace("r.at", "r.place").replace("min(at)", "min(place)"))
def dup_pairs(spark, d):
    """Vectors of a label within cosine 0.35: id, class_id (least id connected), n_links."""
    from palimpsest.operators.consolidation import similarity_classes

    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope"), "embedding", F.col("vec_id").alias("created"))
    return similarity_classes(v, tau=0.35)


@query(f"""WITH {PART_EDGES} SELECT e.dst AS node, e.src AS other, e.edge_id FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY edge_id) AS n FROM edges) e WHERE n <= 4""")
def first_relations(spark, d):
    from palimpsest.operators.relational import top_per_key

    e = top_per_key(roles.part_edges(spark, d), ["dst"], ["edge_id"], 4)
    return e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_id")


@query("SELECT p_partkey AS id, coalesce(m.canonical, p_partkey) AS resolved FROM part LEFT JOIN (SELECT regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g') AS k, min(p_partkey) AS canonical FROM part WHERE p_size <= 25 GROUP BY 1) m ON m.k = regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g')")
def resolve_entities(spark, d):
    p = read_table(spark, d, "part").withColumn("k", X.mention_key(F.col("p_name")))
    known = keep_first(p.where("p_size <= 25"), ["k"], ["p_partkey"]).select("k", F.col("p_partkey").alias("canonical"))
    return p.join(known, "k", "left").select(F.col("p_partkey").alias("id"), F.coalesce("canonical", "p_partkey").alias("resolved"))
