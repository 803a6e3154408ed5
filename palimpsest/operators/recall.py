"""One recall: channels, fusion with signals, the graph from the best, fusion again, a second round where the first says too little, diversity, and packing.

For many queries at once; each keeps at most `POOL` candidates beyond fusion, so what is folded per query is of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators import retrieval as R
from palimpsest.operators.needles import hits
from palimpsest.operators.temporal import as_of
from palimpsest.runtime import cut

POOL = 50
SEEDS = 5
#: Fixed values by mode: how many a channel gives, steps of the graph, further rounds.
CHANNEL_K = {"fast": 20, "deep": 50, "divergent": 20}
HOPS = {"fast": 1, "deep": 2, "divergent": 1}
ROUNDS = {"fast": 0, "deep": 0, "divergent": 1}
ENTITY_K, SECOND_K = 10, 10
RECENCY_WEIGHT = 0.3
#: What recency is at least where the old is looked for.
FLOOR = 0.01


@dataclass
class Store:
    """memories: id, scope, status, tier, content, episode, valid_from, valid_to, embedding. facts: id, scope, predicate, object, confidence. entities: id, episode, status. edges: src, dst."""

    memories: DataFrame
    facts: DataFrame
    entities: DataFrame
    edges: DataFrame


def entity_matches(facts: DataFrame, queries: DataFrame, k: int = ENTITY_K) -> DataFrame:
    """query, id, score, rank: the surest facts of the query's scope whose predicate or object contains its text, whatever the case. All texts are looked for in one pass."""
    asked = queries.select("query", F.col("scope").alias("__scope"), F.lower("text").alias("needle"))
    # A line break between the two, so that nothing is found across them.
    rows = facts.select("id", "scope", "confidence", F.lower(F.concat_ws("\n", "predicate", "object")).alias("text"))
    met = hits(rows, asked.select("needle"), keep=("scope", "confidence")).join(asked, "needle").where(F.col("scope") == F.col("__scope"))
    w = Window.partitionBy("query").orderBy(F.desc("confidence"), "id")
    return met.select("query", "id", F.col("confidence").cast("double").alias("score"), F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)


def fuse(channels: dict[str, DataFrame], born: DataFrame, now: Column, divergent: bool = False) -> DataFrame:
    """query, id, fused_score, score, signals (channel to score). A channel gives query, id, score and rank, or no rank: what only such ones give has a fused score of 0.

    born: id, valid_from. The sum of 1 / (60 + rank) grows with recency, or where the old is looked for with age; what has no time is of now."""
    rows = None
    for name, df in channels.items():
        rank = F.col("rank") if "rank" in df.columns else F.lit(None)
        one = df.select("query", "id", F.lit(name).alias("channel"), rank.cast("long").alias("rank"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    part = F.when(F.col("rank").isNotNull(), 1.0 / (R.RRF_K + F.col("rank"))).otherwise(0.0)
    out = rows.groupBy("query", "id").agg(F.sum(part).alias("rrf"), F.max("score").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("signals"))
    recent = F.coalesce(S.recency(S.days_between(now, F.col("valid_from"))), F.lit(1.0))
    recent = 1.0 - recent + FLOOR if divergent else recent
    fused = F.col("rrf") * (1 + RECENCY_WEIGHT * recent)
    fused = F.when(F.isnan(fused) | (F.abs(fused) == float("inf")), 0.0).otherwise(fused)
    return out.join(born.select("id", "valid_from"), "id", "left").select("query", "id", fused.alias("fused_score"), "score", "signals")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k of each query with the greatest fused score (ties: least id), with their place."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("fused_score", 12)), "id")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def candidates(store: Store, queries: DataFrame, t: Column, mode: str = "fast", now: Column | None = None, embed: Callable[[Column], Column] | None = None, rounds: int | None = None) -> DataFrame:
    """query, id, fused_score, score, signals, place: what a recall of queries (query, scope, text, embedding) finds, at most `POOL` and what a second round adds.

    `embed`: of a text's Column the vector, for questions of a second round; without it they have no dense channel. A reranker's score would take the place of `score`, but the order is that of
    the fused one, so reranking only cuts to `POOL`."""
    now, divergent = now if now is not None else t, mode == "divergent"
    statuses = L.MODE_STATUSES[mode]
    valid = cut(as_of(store.memories, t).where(F.col("status").isin(*statuses)))
    texts = valid.select("id", "scope", F.col("content").alias("text"))
    born = valid.select("id", "valid_from")
    k = CHANNEL_K[mode]
    found = {
        "dense": cut(R.knn(queries, valid, k, within="scope")),
        "sparse": cut(R.sparse_channel(texts, queries, k, within="scope")),
        "entity": cut(entity_matches(store.facts, queries)),
    }
    first = best(fuse(found, born, now, divergent), SEEDS)
    graph = R.graph_channel(first.select("query", "id"), store.memories, store.entities, store.edges, HOPS[mode], tuple(statuses))
    mine = valid.select("id", "scope").join(graph, "id").join(queries.select("query", F.col("scope").alias("__scope")), "query").where(F.col("scope") == F.col("__scope"))
    pool = cut(best(fuse({**found, "graph": mine.select("query", "id", "score")}, born, now, divergent), POOL))
    if not (ROUNDS[mode] if rounds is None else rounds):
        return pool
    asked = R.follow_up_queries(queries, pool.where("place <= 10").select("query", F.col("fused_score").alias("score"))).join(queries.select("query", "scope"), "query")
    more = {"sparse": R.sparse_channel(texts, asked, SECOND_K, within="scope")}
    if embed is not None:
        more["dense"] = R.knn(asked.withColumn("embedding", embed(F.col("text"))), valid, SECOND_K, within="scope")
    new = fuse(more, born, now, divergent).join(pool.select("query", "id"), ["query", "id"], "left_anti")
    return cut(best(pool.drop("place").unionByName(new), POOL + 2 * SECOND_K))


def recall(store: Store, queries: DataFrame, t: Column, mode: str = "fast", budget: int = 4000, **options) -> DataFrame:
    """query, id, tier, place, fused_score, score, signals, tokens: what fits the budget of each query, the best first and the second best last; in divergent mode what differs from what is there comes before more of it."""
    rows = candidates(store, queries, t, mode, **options)
    # Facts of identity are no memories: their text is predicate and object.
    said = store.memories.select("id", "tier", F.col("content").alias("text")).unionByName(store.facts.select("id", F.lit("semantic").alias("tier"), F.concat_ws(" = ", "predicate", "object").alias("text")))
    words = X.word_set(F.col("text")) if mode == "divergent" else F.array().cast("array<string>")
    tokens = X.token_estimate(F.col("text")) + 5
    item = F.struct("place", F.col("fused_score").alias("score"), "tier", tokens.alias("tokens"), F.trim(F.lower(F.substring("text", 1, 100))).alias("head"), "id", words.alias("words"), F.col("score").alias("raw"), "signals")
    lists = rows.join(said.dropDuplicates(["id"]), "id").select("query", item.alias("item")).groupBy("query").agg(F.array_sort(F.collect_list("item"), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("items"))
    if mode == "divergent":
        top = F.slice("items", 1, 30)
        lists = lists.withColumn("order", R.mmr_fold(F.transform(top, lambda x: F.struct(x["place"].alias("place"), x["score"].alias("score"), x["words"].alias("words"))), 30))
        lists = lists.withColumn("items", F.transform("order", lambda p: F.element_at(F.filter("items", lambda x: x["place"] == p), 1)))
    lists = lists.withColumn("kept", R.pack_fold(F.col("items"), budget))
    out = lists.select("query", F.posexplode(F.filter("items", lambda x: F.array_contains(F.col("kept"), x["place"]))).alias("k", "x"), F.size("kept").alias("n"))
    return out.select("query", F.col("x.id").alias("id"), F.col("x.tier").alias("tier"), R.lost_in_the_middle(F.col("k") + 1, F.col("n")).alias("place"), F.col("x.score").alias("fused_score"), F.col("x.raw").alias("score"), F.col("x.signals").alias("signals"), F.col("x.tokens").alias("tokens"))
