"""Queries over stored indexes: vectors by cells, texts by postings, many needles by automata."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import needles as N
from palimpsest.operators import text_index as T
from palimpsest.operators import vector_index as V
from palimpsest.plans.graphs import _COS, _SPARSE
from palimpsest.plans.recall import _ALL
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table

#: Cells of the small tables here; by itself an index parts only what is larger than a group.
_CELLS = 24


def _vectors(spark, d):
    v = read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query"), "label", "embedding")


@query(f"""SELECT query, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS.format(a='a', b='b')} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a', b='b')}, 9) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def index_knn(spark, d):
    """The exact nearest by cells: some are probed first, then all that may still hold a nearer one."""
    v, asked = _vectors(spark, d)
    return V.search(V.write_index(v, n_cells=_CELLS), asked, 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT query, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS.format(a='a', b='b')} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a', b='b')}, 9) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label AND b.vec_id % 4 <> 3 WHERE a.vec_id % 50 = 0 AND round({_COS.format(a='a', b='b')}, 9) >= 0.1) WHERE rank <= 5""")
def index_knn_filtered(spark, d):
    """The nearest of one's label and of some statuses with a likeness of at least 0.1: cells that can't hold one are left out."""
    v, asked = _vectors(spark, d)
    index = V.write_index(v.withColumn("status", F.col("id") % 4), within="label", keep=["status"], part=16)
    rows = V.search(index, asked, 5, within="label", where=F.col("status") != 3, least=0.1)
    return rows.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) * 10 AS n, true AS good FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark, d):
    """Approximate search with as many probes as nine tenths of the true neighbours need: whether it has them."""
    v, asked = _vectors(spark, d)
    index = V.write_index(v, n_cells=_CELLS)
    probes = V.calibrate(index, asked, 10, 0.92)
    right = V.search(index, asked, 10).select("query", "id", F.lit(1).alias("right"))
    found = V.search(index, asked, 10, probes=probes).select("query", "id", F.lit(1).alias("found"))
    both = right.join(found, ["query", "id"], "left")
    return both.agg(F.count("*").alias("n"), (F.count("found") >= 0.9 * F.count("*")).alias("good"))


def _texts(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return T.write_index(docs), read_table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


@query(f"WITH {_SPARSE} SELECT item AS query, id, round(score, 6) AS score, rank FROM sparse")
def index_ranked(spark, d):
    """Ranked texts from stored postings: only blocks that can still matter are opened."""
    index, asked = _texts(spark, d)
    return T.search(index, asked, 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_ALL}, strict AS (SELECT item, id, score FROM sc JOIN need USING (item) WHERE n = need), chosen AS (SELECT * FROM strict UNION ALL SELECT item, id, score FROM sc WHERE item NOT IN (SELECT item FROM strict))
SELECT item AS query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, id) AS rank FROM chosen) WHERE rank <= 20""")
def index_ranked_strict(spark, d):
    """All words of an item, or any where no text has all, from stored postings."""
    index, asked = _texts(spark, d)
    return T.channel(index, asked, 20).select("query", "id", F.round("score", 6).alias("score"), "rank")


_LINE = "' ' || array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> ''), ' ') || ' '"


@query(f"""WITH l AS MATERIALIZED (SELECT doc_id, {_LINE} AS t FROM documents), w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM benchmark)
SELECT DISTINCT item_id AS query, doc_id AS id FROM w JOIN l ON CASE item_id % 4 WHEN 0 THEN contains(t, ' ' || w[1] || ' ' || w[2] || ' ' || w[3] || ' ') WHEN 1 THEN (contains(t, ' ' || w[1] || ' ') OR contains(t, ' ' || w[2] || ' ' || w[3] || ' ')) AND NOT contains(t, ' ' || w[4] || ' ')
WHEN 2 THEN contains(t, ' ' || w[1] || ' ') AND contains(t, ' ' || w[2] || ' ') ELSE NOT contains(t, ' ' || w[1] || ' ' || w[2] || ' ') END""")
def index_matches(spark, d):
    """Queries as people type them, many at once, from positions: phrases, alternatives, what must not occur."""
    index, b = _texts(spark, d)
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    quoted = lambda *k: F.concat(F.lit('"'), F.concat_ws(" ", *[w[i] for i in k]), F.lit('"'))
    kind = F.col("query") % 4
    asked = F.when(kind == 0, quoted(0, 1, 2)).when(kind == 1, F.concat(w[0], F.lit(" or "), quoted(1, 2), F.lit(" -"), w[3])).when(kind == 2, F.concat_ws(" ", w[0], w[1])).otherwise(F.concat(F.lit("-"), quoted(0, 1)))
    return T.match(index, b.select("query", asked.alias("text")))


@query("SELECT needle, count(*) AS n, min(doc_id) AS first FROM (SELECT DISTINCT substr(lower(text), 1, 12) AS needle FROM documents) JOIN documents ON contains(lower(text), needle) WHERE needle <> '' GROUP BY 1")
def needle_hits(spark, d):
    """In how many texts the beginnings of all texts stand, and in which first: one pass for all of them."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return N.tally(docs, docs.select(F.substring("text", 1, 12).alias("needle")), F.count("*").alias("n"), F.min("id").alias("first"))


_STORE = f"""mem AS MATERIALIZED (SELECT vec_id AS id, 's' || (label % 5) AS scope, vec_id % 211 AS episode, CASE vec_id % 4 WHEN 0 THEN 'canonical' WHEN 1 THEN 'belief' WHEN 2 THEN 'hypothesis' ELSE 'retracted' END AS status,
  TIMESTAMP '2024-01-01' + to_hours((vec_id % 400)::INT) AS valid_from, CASE WHEN vec_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours((vec_id % 400 + 100)::INT) END AS valid_to, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id),
m AS MATERIALIZED (SELECT * FROM mem WHERE status IN ('canonical', 'belief') AND valid_from <= TIMESTAMP '2024-01-10' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')),
ask AS MATERIALIZED (SELECT mem.id AS query, scope, embedding, b.text FROM mem JOIN benchmark b ON item_id * 50 = mem.id),
dense AS (SELECT * FROM (SELECT query, m.id, {_COS.format(a='ask', b='m')} AS score, row_number() OVER (PARTITION BY query ORDER BY round({_COS.format(a='ask', b='m')}, 9) DESC, m.id) AS rank FROM ask JOIN m ON m.scope = ask.scope AND m.id <> query) WHERE rank <= 20),
t AS MATERIALIZED (SELECT id, scope, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS t FROM m), wo AS (SELECT id, scope, len(t) AS n_words, unnest(t) AS term FROM t), qt AS MATERIALIZED (SELECT query, scope AS own, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM ask),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM t), tf AS MATERIALIZED (SELECT term, id, scope, n_words, count(*) AS tf FROM wo WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), need AS (SELECT query, count(*) AS need FROM qt GROUP BY 1),
sc AS (SELECT query, id, count(*) AS n, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / mean))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st WHERE scope = own GROUP BY 1, 2),
strict AS (SELECT query, id, score FROM sc JOIN need USING (query) WHERE n = need), chosen AS (SELECT * FROM strict UNION ALL SELECT query, id, score FROM sc WHERE query NOT IN (SELECT query FROM strict)),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM chosen) WHERE rank <= 20),
u AS MATERIALIZED (SELECT query, id, 'dense' AS c, rank, score FROM dense UNION ALL SELECT query, id, 'sparse', rank, score FROM sparse),
rec AS (SELECT id, 1 + 0.3 * exp(-0.01 * date_diff('second', valid_from, TIMESTAMP '2024-01-10') / 86400.0) AS f FROM m),
f1 AS (SELECT query, id, sum(1 / (60 + rank)) * any_value(f) AS fused FROM u JOIN rec USING (id) GROUP BY 1, 2), seeds AS (SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 12) DESC, id) AS k FROM f1) WHERE k <= 5),
ent AS (SELECT p_partkey AS id, p_partkey % 211 AS episode, CASE WHEN p_size % 5 = 0 THEN 'hypothesis' ELSE 'canonical' END AS status FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 7) % (SELECT count(*) FROM part) + 1 AS dst FROM part WHERE p_partkey % 3 = 0),
n0 AS (SELECT DISTINCT query, ent.id AS node FROM seeds JOIN mem USING (id) JOIN ent ON ent.episode = mem.episode WHERE ent.status = 'canonical'), n1 AS (SELECT DISTINCT query, dst AS node FROM n0 JOIN e ON src = node),
ep AS (SELECT query, episode, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM n0 UNION ALL SELECT *, 1 FROM n1) w JOIN ent ON ent.id = w.node GROUP BY 1, 2),
graph AS (SELECT query, m.id, 'graph' AS c, NULL::BIGINT AS rank, 1.0 / (1 + depth) AS score FROM ep JOIN m USING (episode) JOIN ask USING (query) WHERE m.scope = ask.scope)"""


@query(f"""WITH {_STORE}, f2 AS (SELECT query, id, coalesce(sum(1 / (60 + rank)), 0) * any_value(f) AS fused, max(score) AS score, string_agg(c, ',' ORDER BY c) AS signals FROM (SELECT * FROM u UNION ALL SELECT * FROM graph) JOIN rec USING (id) GROUP BY 1, 2)
SELECT query, id, round(fused, 9) AS fused_score, round(score, 6)::DOUBLE AS score, signals, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 12) DESC, id) AS place FROM f2) WHERE place <= 50""")
def recall_candidates(spark, d):
    """One recall for many queries: channels within a scope and time, fused, the graph from the best five, fused again, with the signals of each."""
    from palimpsest.operators import recall as P

    v, docs, p = (read_table(spark, d, t) for t in ("embeddings", "documents", "part"))
    at = lambda h: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h.cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("canonical", "belief", "hypothesis", "retracted"))), (F.col("vec_id") % 4 + 1).cast("int"))
    memories = v.join(docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id").select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), (F.col("label") % 5).cast("string")).alias("scope"), (F.col("vec_id") % 211).alias("episode"), status.alias("status"), F.lit("semantic").alias("tier"), "content", at(F.col("vec_id") % 400).alias("valid_from"), F.when(F.col("vec_id") % 3 == 0, at(F.col("vec_id") % 400 + 100)).alias("valid_to"), "embedding")
    asked = memories.select(F.col("id").alias("query"), "scope", "embedding").join(read_table(spark, d, "benchmark").select((F.col("item_id") * 50).alias("query"), "text"), "query")
    n = p.count()
    entities = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 211).alias("episode"), F.when(F.col("p_size") % 5 == 0, "hypothesis").otherwise("canonical").alias("status"))
    edges = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7) % n + 1).alias("dst"))
    # Facts of identity are no part of the supplied tables: their channel is empty here.
    facts = memories.where("false").select("id", "scope", F.lit("").alias("predicate"), F.lit("").alias("object"), F.lit(0.5).alias("confidence"))
    rows = P.candidates(P.Store(memories, facts, entities, edges), asked, F.lit("2024-01-10").cast("timestamp_ntz"))
    return rows.select("query", "id", F.round("fused_score", 9).alias("fused_score"), F.round("score", 6).alias("score"), F.array_join(F.array_sort(F.map_keys("signals")), ",").alias("signals"), "place")
