"""Hybrid retrieval: dense, sparse and entity channels, rank fusion, diversity, and packing to a token budget.

All work for many queries at once: a channel gives rows (query, id, rank, score), fused per query. Searches by vector
deal queries and items over blocks that meet in pairs; a pair gives the best k of each query, and the best of these are the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import lexicon as L
from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators.needles import hits
from palimpsest.operators.relational import top_per_key
from palimpsest.operators.temporal import as_of
from palimpsest.operators.vector_index import best, matrix, unit
from palimpsest.operators.words import word_counts
from palimpsest.runtime import cut

RRF_K = 60
BLOCK = 1 << 13
ITEM_BLOCK = 1 << 15
# What parts the aspects of a question, in the order of the tests.
ASPECTS = (" and ", " or ", " vs ", " versus ", " compared ", " difference ")
# Shares of the token budget by tier.
TIER_SHARES = {"semantic": 0.40, "episodic": 0.30, "graph": 0.20, "working": 0.10}


def _blocks(df: DataFrame, key: str, block: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // block))
    return df.withColumn("__mine", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def knn(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query", item_id: str = "id", vector: str = "embedding", within: str | None = None, block: int = BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """query, id, score, rank: the exact k nearest by cosine (ties: least id), never the query itself. Null vectors match nothing. With `within` only items that are equal in that column.

    Queries and items are dealt over blocks, and each pair of blocks is a group of bounded size that gives its best k of each query: nothing comes to the driver but the numbers of blocks."""
    group = F.lit(0) if within is None else F.xxhash64(within)
    asked, n_asked = _blocks(queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.col(vector).cast("array<double>").alias("v"), group.alias("g")), "query", block)
    rows, n_rows = _blocks(items.where(F.col(vector).isNotNull()).select(F.col(item_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), group.alias("g")), "id", item_block)
    asked = asked.withColumn("qb", F.col("__mine")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).drop("__mine")
    rows = rows.withColumn("ib", F.col("__mine")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).drop("__mine")
    schema = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def judge(q: pa.Table, t: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        kinds = [q.schema.field("query").type, t.schema.field("id").type, pa.float64()]
        if not q.num_rows or not t.num_rows:
            return pa.table([pa.array([], x) for x in kinds], names)
        t = t.sort_by("id")
        ids, own = q["query"].to_numpy(), t["id"].to_numpy()
        mine, other = q["g"].to_numpy(), t["g"].to_numpy()

        def bar(score: np.ndarray, at: slice) -> None:
            score[(ids[at, None] == own[None, :]) | (mine[at, None] != other[None, :])] = -np.inf

        i, j, value = best(unit(matrix(q["v"])), unit(matrix(t["v"])), k, bar)
        return pa.table([q["query"].take(pa.array(i)), t["id"].take(pa.array(j)), pa.array(value)], names)

    found = asked.groupBy("qb", "ib").cogroup(rows.groupBy("qb", "ib")).applyInArrow(judge, schema)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, all_terms: bool = True, within: str | None = None) -> DataFrame:
    """query, id, score, rank for queries (query, text). With all_terms a document must hold every word of the query, with `within` be equal to it in that column.

    Texts are cut into words once: each gives its distinct words with their counts, of which those of the queries and one row of its size are written."""
    asked = queries.select("query", F.explode(X.word_set(F.col("text"))).alias("term"))
    need = asked.groupBy("query").agg(F.count("*").alias("need"))
    counts = word_counts(docs, id_col, text_col, sizes=True)
    wanted = asked.select(F.col("term").alias("word")).distinct().withColumn("asked", F.lit(True))
    held = cut(counts.join(wanted, "word", "left").where("word is null or asked").select(F.col("word").alias("term"), "id", F.col("n").alias("tf"), "n_words"))
    sizes = held.where("term is null").agg(F.count("*").alias("n_docs"), F.avg("n_words").alias("mean")).first()
    n_docs, mean = sizes["n_docs"], sizes["mean"] or 1.0
    held = held.where("term is not null")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_words") / F.lit(mean)))
    rows = held.join(df, "term").withColumn("part", part).join(asked, "term").groupBy("query", "id").agg(F.sum("part").alias("score"), F.count("*").alias("n"))
    if all_terms:
        rows = rows.join(need, "query").where("n = need")
    if within is not None:
        mine = lambda df, key, name: df.select(F.col(key).alias(name), F.col(within).alias(f"__{name}"))
        rows = rows.join(mine(docs, id_col, "id"), "id").join(mine(queries, "query", "query"), "query").where("__id = __query")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return rows.select("query", "id", "score", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)


def or_else(first: DataFrame, second: DataFrame, key: str = "query") -> DataFrame:
    """The rows of `first`, and those of `second` for queries that have none there."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def sparse_channel(docs: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Documents with all words of a query; for queries that no document has all words of, those with any."""
    return or_else(bm25(docs, queries, k, **options), bm25(docs, queries, k, all_terms=False, **options))


def dense_channel(memories: DataFrame, queries: DataFrame, t: Column, mode: str = "fast", k: int | None = None) -> DataFrame:
    """The nearest memories of the query's scope that are valid at t and of a status that the mode includes. memories: id, scope, status, valid_from, valid_to, embedding; queries: query, scope, embedding."""
    rows = as_of(memories, t).where(F.col("status").isin(*L.MODE_STATUSES[mode]))
    return knn(queries, rows, k or {"fast": 20}.get(mode, 50), within="scope")


def graph_channel(seeds: DataFrame, memories: DataFrame, entities: DataFrame, edges: DataFrame, hops: int = 1, statuses: tuple[str, ...] = ("canonical",)) -> DataFrame:
    """query, id, depth, score: memories of the episodes that the graph leads to from the seeds' episodes, best first by 1 / (1 + depth).

    seeds: query, id (memories). memories: id, episode, status. entities: id, episode, status. edges: src, dst; validity is the caller's filter. Walks follow edges outwards."""
    named = memories.select(F.col("id").alias("m"), F.col("episode").alias("m_episode"))
    start = seeds.join(named, F.col("id") == F.col("m")).select("query", F.col("m_episode").alias("episode")).distinct()
    of = entities.select(F.col("id").alias("node"), "episode", F.col("status").alias("entity_status"))
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    reached = start.join(of.where(F.col("entity_status").isin(*statuses)), "episode").select("query", "node").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier = reached
    for k in range(1, hops + 1):
        new = frontier.join(steps, F.col("node") == F.col("a")).select("query", F.col("b").alias("node")).distinct()
        frontier = cut(new.join(reached.select("query", "node"), ["query", "node"], "left_anti").withColumn("depth", F.lit(k).cast("long")))
        reached = reached.unionByName(frontier)
    episodes = reached.join(of.select("node", "episode"), "node").groupBy("query", "episode").agg(F.min("depth").alias("depth"))
    rows = episodes.join(memories.where(F.col("status").isin(*statuses)).select("id", "episode"), "episode")
    return rows.select("query", "id", "depth", (1.0 / (1.0 + F.col("depth"))).alias("score"))


def rerank(rows: DataFrame, queries: DataFrame, items: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """query, id, score, rank: candidates by their true cosine with the query; those without a vector have `least`."""
    q = queries.select("query", F.col("embedding").alias("__q"))
    v = items.select("id", F.col("embedding").alias("__v"))
    scored = rows.select("query", "id").join(q, "query", "left").join(v, "id", "left").withColumn("score", F.round(F.coalesce(S.cosine(F.col("__q"), F.col("__v")), F.lit(least)), 9))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.select("query", "id", "score", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)


def follow_up_queries(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query, text: a second question where the results (query, score) don't cover the first one: nothing found, nothing good, or one of several aspects only."""
    found = results.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    rows = queries.select("query", "text").join(found, "query", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    words = F.split(F.trim("text"), r"\s+")
    brief = F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise(F.concat("text", F.lit(" overview")))
    rest = F.coalesce(*[F.nullif(F.trim(F.substring_index(F.lower("text"), m, -1)), F.trim(F.lower("text"))) for m in ASPECTS])
    second = F.when(F.col("n") == 0, F.concat("text", F.lit(" details"))).when(F.col("best") < 0.05, brief).when(F.col("n") < 3, F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))
    return rows.select("query", second.alias("text")).where("text is not null")


def narrative_material(episodes: DataFrame, queries: DataFrame, matches: int = 20, recent: int = 12, leave_out: tuple[str, ...] = L.OPERATIONAL_SOURCES) -> DataFrame:
    """query, id, origin, rank: the newest episodes that contain the query's text, or, for queries that none does, the newest of all. Sources of operation are no material, nor are episodes without a source.

    episodes: id, content, source_ref, created_at; queries: query, text (an empty one is contained in nothing)."""
    rows = episodes.where(X.source_not_in(F.col("source_ref"), leave_out))
    asked = queries.select("query", F.lower("text").alias("needle"))
    newest = [F.desc("created_at"), F.asc("id")]
    found = hits(rows.select("id", "created_at", F.lower("content").alias("text")), asked.select("needle"), keep=("created_at",)).join(asked, "needle")
    found = cut(top_per_key(found, ["query"], newest, matches).select("query", "id", F.lit("match").alias("origin"), "rank"))
    # A dozen rows go to each query that has none.
    last = rows.select("id", "created_at").orderBy(*newest).limit(recent).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*newest)).cast("long"))
    fallback = asked.select("query", F.lit(0).alias("all")).join(F.broadcast(last.withColumn("all", F.lit(0))), "all").select("query", "id", F.lit("recent").alias("origin"), "rank")
    return or_else(found, fallback)


def entity_channel(facts: DataFrame, needle: str, k: int, id_col: str = "id") -> DataFrame:
    """Identity facts whose predicate or object contains the needle, best confidence first: id, text, score, rank."""
    rows = facts.where(F.col("predicate").ilike(f"%{needle}%") | F.col("object").ilike(f"%{needle}%"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("confidence"), id_col)
    # The k best are found by partial top-k first, so the window sees k rows.
    best = rows.orderBy(F.desc("confidence"), id_col).limit(k)
    return best.select(F.col(id_col).alias("id"), F.concat_ws(" = ", "predicate", "object").alias("text"), F.col("confidence").alias("score"), F.row_number().over(w).cast("long").alias("rank"))


def rrf(channels: dict[str, DataFrame], recency: DataFrame | None = None, weight: float = 0.3, key: tuple[str, ...] = ("query", "id")) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (60 + rank) over channels, times 1 + weight * recency. Adds fused_score, raw_score, n_channels, channels."""
    rows = None
    for name, df in channels.items():
        one = df.select(*key, F.lit(name).alias("channel"), "rank", "score")
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy(*key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused_score"), F.max("score").alias("raw_score"), F.count("*").alias("n_channels"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    if recency is not None:
        out = out.join(recency.select(key[-1], F.col("recency").alias("__r")), key[-1], "left").withColumn("fused_score", F.col("fused_score") * (1 + weight * F.coalesce("__r", F.lit(0.0)))).drop("__r")
    return out


def mmr_fold(items: Column, top: int, lam: float = 0.5) -> Column:
    """Greedy diversity over an array of structs (place, score, words) by falling score: places in the order they are picked.

    Each round takes the item of the greatest lam * score - (1 - lam) * its largest overlap with what is picked; the first wins ties."""
    start = F.struct(F.array().cast("array<bigint>").alias("picked"), F.array().cast("array<array<string>>").alias("seen"))

    def round_(acc: Column, _: Column) -> Column:
        left = F.filter(items, lambda x: ~F.array_contains(acc["picked"], x["place"]))
        near = lambda x: F.coalesce(F.array_max(F.transform(acc["seen"], lambda s: X.overlap_of_first(x["words"], s))), F.lit(0.0))
        valued = F.transform(left, lambda x: F.struct((-F.round(lam * x["score"] - (1 - lam) * near(x), 12)).alias("v"), x["place"].alias("place"), x["words"].alias("words")))
        best = F.array_min(valued)
        return F.when(F.size(left) == 0, acc).otherwise(F.struct(F.array_append(acc["picked"], best["place"]).alias("picked"), F.array_append(acc["seen"], best["words"]).alias("seen")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, round_)["picked"]


def pack_fold(items: Column, budget: int) -> Column:
    """Greedy packing of an array of structs (place, tier, tokens, head) by rank: places that fit.

    Repeats of a head (first 100 characters) are skipped, items of a tier that is full are skipped, and packing stops when the whole is full. Unknown tiers
    have the semantic share, but a count of their own."""
    share = F.create_map(*[F.lit(x) for t, s in TIER_SHARES.items() for x in (t, int(s * budget))])
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("long").alias("used"), F.create_map().cast("map<string,bigint>").alias("tiers"), F.array().cast("array<string>").alias("heads"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        cap = F.coalesce(F.try_element_at(share, x["tier"]), F.lit(int(TIER_SHARES["semantic"] * budget))).cast("long")
        tier_used = F.coalesce(F.try_element_at(acc["tiers"], x["tier"]), F.lit(0).cast("long"))
        again = F.array_contains(acc["heads"], x["head"])
        tier_full = tier_used + x["tokens"] > cap
        over = acc["used"] + x["tokens"] > budget
        fits = ~acc["full"] & ~again & ~tier_full & ~over
        return F.struct(
            F.when(fits, F.array_append(acc["kept"], x["place"])).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.map_concat(F.map_filter(acc["tiers"], lambda k, v: k != x["tier"]), F.create_map(x["tier"], tier_used + x["tokens"]))).otherwise(acc["tiers"]).alias("tiers"),
            F.when(acc["full"] | again, acc["heads"]).otherwise(F.array_append(acc["heads"], x["head"])).alias("heads"),
            (acc["full"] | (~again & ~tier_full & over)).alias("full"),
        )

    return F.aggregate(items, start, step)["kept"]


def lost_in_the_middle(rank: Column, n: Column) -> Column:
    """The place of a ranked item: best first, second best last, all others between."""
    return F.when(rank == 1, F.lit(1)).when(rank == 2, n).otherwise(rank - 1).cast("long")


def follow_up(query: str, scores: list[float]) -> str | None:
    """A follow-up query where the results don't cover this one, else None."""
    if not scores:
        return f"{query} details"
    if scores[0] < 0.05:
        words = query.split()
        return " ".join(words[:3]) if len(words) > 3 else f"{query} overview"
    low = query.lower()
    if len(scores) < 3:
        for marker in ASPECTS:
            rest = low.split(marker, 1)[1].strip() if marker in low else ""
            if rest:
                return rest.capitalize()
    return None


def recency_of(df: DataFrame, now: Column, id_col: str = "id", at: str = "created_at") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), S.recency(S.days_between(now, F.col(at))).alias("recency"))
