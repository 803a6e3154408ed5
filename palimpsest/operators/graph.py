"""Property graphs as two frames: nodes (id, …) and edges (edge_id, src, dst, …).

Disjunctive joins are never written as such: edges are laid out once as (node, other) and joined by equality. Walks and
components loop over frames that are written each round; nothing of the graph comes to the driver but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.operators.relational import keep_first
from palimpsest.operators.vector_index import matrix, nearest, threshold_join, tiles, unit
from palimpsest.runtime import cut, remove, shared_path, written


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: node, other, edge_id, direction. A self loop stands twice."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_id", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_id", F.lit("in").alias("direction")))


def degree(edges: DataFrame) -> DataFrame:
    """node, degree. A self loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degree(edges).withColumnRenamed("node", "__node")
    return nodes.join(d, F.col("id") == F.col("__node"), "left").drop("__node").withColumn("degree", F.coalesce("degree", F.lit(0)))


def hubs(edges: DataFrame, n: int) -> DataFrame:
    return degree(edges).orderBy(F.desc("degree"), "node").limit(n)


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at the seeds (node): node, other, edge_id, direction."""
    rows = ends(edges)
    rows = rows if direction == "both" else rows.where(F.col("direction") == direction)
    return rows.join(seeds.select("node").distinct(), "node", "left_semi")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = True, include_seeds: bool = False) -> DataFrame:
    """node, depth: what is reached from the seeds, with its least depth."""
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if directed else ends(edges).select(F.col("node").alias("a"), F.col("other").alias("b"))
    # Dealt by where they start once, for all hops.
    steps = steps.distinct().repartition("a").persist(StorageLevel.DISK_ONLY)
    reached = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier = reached
    for k in range(1, hops + 1):
        new = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = new.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(k).cast("long"))
        frontier = cut(new)
        reached = reached.unionByName(frontier)
    return reached if include_seeds else reached.where("depth > 0")


def star_roots(edges: DataFrame, hub: int = 4096, rows_per_file: int = 200_000, alone: int = 65_536) -> DataFrame:
    """node, root: the least node that links (u, v) connect each node with, for all nodes but the roots themselves.

    Links lie as (greater, lesser). A small star ties a node's lesser neighbours and itself to the least of them, a large star moves a link from a lesser
    end to what that end is tied to; when neither changes anything, the links are stars around the roots. Each round is a table of few
    files, and goes when the next one is written. Up to `alone` links are one file, and a round of them is one task without a shuffle: a driver keeps what it knows of each stage. Ends that more links share than `hub` and than a 65,536th of all (so 65,536 at most) meet theirs by broadcast, so that no task gets all links of a hub.
    Links with a null end connect nothing."""
    spark = edges.sparkSession
    base = shared_path(spark, "stars")

    def round_(e: DataFrame, k: int, files: int | None) -> tuple[DataFrame, int, tuple]:
        seen = Observation()
        e = e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sign"))
        out = written(e.coalesce(files) if files else e, f"{base}/{k}")
        return out, seen.get["n"], (seen.get["n"], seen.get["sign"])

    def tied(e: DataFrame, end: str, n: int) -> DataFrame:
        """e with m, the least node that its `end` is tied to (or that end itself)."""
        few = "few_" + end
        own = F.struct(F.col("u").alias("x"), F.col("v").alias("y"), F.lit(1 if end == "u" else 0).alias("here"))
        other = F.struct(F.col("v").alias("x"), F.lit(None).cast(e.schema["v"].dataType).alias("y"), F.lit(1).alias("here"))
        ends_ = e.select(F.explode(F.array(own, other) if end == "v" else F.array(own)).alias("p")).select("p.*")
        least = ends_.groupBy("x").agg(F.min("y").alias("y"), F.sum("here").alias("n")).select(F.col("x").alias(few), F.coalesce("y", "x").alias("m"), (F.col("n") > max(hub, n >> 16)).alias("hot"))
        if n <= alone:
            least = least.hint("merge")  # of one partition with itself: nothing is exchanged
        if n <= max(hub, alone):
            return e.join(least, F.col(end) == F.col(few)).select("u", "v", "m")
        known = e.join(F.broadcast(least.where("hot").select(F.col(few).alias(end), F.col("m").alias("hot_m"))), end, "left")
        cold = known.where("hot_m is null").select("u", "v").join(least.where("not hot"), F.col(end) == F.col(few)).select("u", "v", "m")
        return known.where("hot_m is not null").select("u", "v", F.col("hot_m").alias("m")).union(cold)

    e, n, before = round_(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0, None)
    k = 0
    while n:
        k += 1
        few = 1 if n <= alone else max(8, -(-n // rows_per_file))
        small = tied(e.coalesce(1) if n <= alone else e, "u", n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        large = tied(small.coalesce(few), "v", n).select("u", F.col("m").alias("v")).distinct()
        e, n, now = round_(large, k, few)
        remove(spark, f"{base}/{k - 1}")
        if now == before:
            break
        before = now
    out = cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")))
    remove(spark, base)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of an edge is connected with."""
    roots = star_roots(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("root", "component")
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return every.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merge_map(nodes: DataFrame, key: Column, order: list, scope: str = "scope") -> DataFrame:
    """old, new: nodes of equal scope and key go to the first of them in the order."""
    w = Window.partitionBy(scope, "__k").orderBy(*order)
    rows = nodes.withColumn("__k", key).withColumn("new", F.first("id").over(w))
    return rows.where("id <> new").select(F.col("id").alias("old"), "new")


def merge_edges(edges: DataFrame, mapping: DataFrame, kind: str = "rel_type") -> DataFrame:
    """Edges repointed by the map, without self loops, one of each parallel set (least edge_id)."""
    from palimpsest.operators.relational import keep_first, repoint

    moved = repoint(repoint(edges, "src", mapping), "dst", mapping).where("src <> dst")
    return keep_first(moved, ["src", "dst", kind], ["edge_id"])


def unordered(a: str = "src", b: str = "dst") -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


#: Rows of a task, where there are more than the session's partitions would take: so tasks grow in number and not in size.
TASK_ROWS = 1 << 20


def _spread(rows: DataFrame, n_rows: int, *by: str) -> DataFrame:
    """`rows` dealt by columns over as many tasks as so many rows ask for, or as the session has."""
    n = -(-n_rows // TASK_ROWS)
    return rows.repartition(n, *by) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*by)


def cooccurrence(members: DataFrame, group: str = "group", node: str = "node", block: int = 1024) -> DataFrame:
    """lo, hi, n: in how many groups two nodes are together. All pairs of all groups; members of a group above `block` are dealt over blocks
    that meet in pairs, so no task has a group. A group's members, or those of two blocks, are a list, and pairs are read off it one by one; tasks have a bounded number of rows."""
    rows = members.select(F.col(group).alias("g"), F.col(node).alias("k")).where("g is not null and k is not null")
    sizes = rows.groupBy("g").agg(F.count("*").alias("m"))
    n, pairs, most = sizes.agg(F.sum(F.col("m") * F.ceil(F.col("m") / block)), F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2), F.max("m")).first()
    if (most or 0) <= block:
        lists = _spread(rows, n or 0, "g").groupBy("g").agg(F.collect_set(F.struct("k", F.lit(0).alias("i"))).alias("l"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    else:
        blocks = sizes.select("g", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
        dealt = rows.distinct().join(blocks, "g").withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("g", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "k", "i")
        lists = _spread(dealt, n, "g", "a", "b").groupBy("g", "a", "b").agg(F.collect_set(F.struct("k", "i")).alias("l"))
    one = lists.select("a", "b", F.array_sort("l").alias("l")).select("a", "b", "l", F.posexplode("l").alias("p", "x"))
    two = one.where("p + 1 < size(l)").select("a", "b", "x", F.explode(F.expr("slice(l, p + 2, size(l))")).alias("y")).where("a = b or x.i <> y.i")
    return _spread(two.select(F.col("x.k").alias("lo"), F.col("y.k").alias("hi")), int(pairs or 0), "lo", "hi").groupBy("lo", "hi").agg(F.count("*").alias("n"))


def alike(rows: DataFrame, least: float) -> DataFrame:
    """lo, hi, score: pairs of a scope with a cosine of at least so much. rows: id, scope, v. Groups of bounded size meet, and only pairs that are alike are rows."""
    kind = rows.schema["id"].dataType

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["lo", "hi", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], x) for x in (left.schema.field("query").type, right.schema.field("id").type, pa.float64())], names)
        asks, ids, found = left["query"].to_numpy(), right["id"].to_numpy(), []
        own, cells = left["own"].to_numpy(), right["own"].to_numpy()
        for at, score in tiles(unit(matrix(left["v"])), unit(matrix(right["v"]))):
            i, j = np.nonzero(score >= least)
            a, b = asks[i + at], ids[j]
            # Rows of two cells meet here only, those of one cell from both sides.
            good = np.where(own[i + at] == cells[j], a < b, a != b)
            found.append((np.minimum(a, b)[good], np.maximum(a, b)[good], score[i, j][good]))
        return pa.table([pa.array(np.concatenate([f[x] for f in found])) for x in range(3)], names)

    return threshold_join(rows, least, judge, T.StructType([T.StructField("lo", kind), T.StructField("hi", kind), T.StructField("score", T.DoubleType())]), once=True)


def densify(nodes: DataFrame, edges: DataFrame, strong: float = 0.70, together: float = 0.60, k: int = 5) -> DataFrame:
    """lo, hi, rel_type, method, score: edges that a graph lacks. nodes: id, episode, embedding.

    Nodes of one episode with a cosine of at least `together` co-occur; a node's k nearest with one of at least `strong` are related; what has no edge then, is tied to
    its nearest. A pair has one edge, of co-occurrence first. That tie is by sets: two nodes without an edge may both be tied, where one after the other the first tie might have served both."""
    have = edges.where("src <> dst").select(*unordered()).distinct()
    vectors = nodes.where("embedding is not null")
    near = nearest(vectors.select(F.col("id").alias("query"), "embedding"), vectors.select("id", "embedding"), k)
    pairs = near.select(F.least("query", "id").alias("lo"), F.greatest("query", "id").alias("hi"), "score")
    related = pairs.where(F.col("score") >= strong).groupBy("lo", "hi").agg(F.max("score").alias("score")).select("lo", "hi", "score", F.lit(2).alias("order"), F.lit("similarity").alias("method"))
    both = alike(vectors.where("episode is not null").select("id", F.col("episode").alias("scope"), F.col("embedding").alias("v")), together)
    cooccur = both.groupBy("lo", "hi").agg(F.max("score").alias("score")).select("lo", "hi", "score", F.lit(1).alias("order"), F.lit("cooccurrence").alias("method"))
    found = cut(keep_first(cooccur.unionByName(related).join(have, ["lo", "hi"], "left_anti"), ["lo", "hi"], ["order"]))
    joined = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(found.select(F.explode(F.array("lo", "hi")))).distinct()
    alone = near.where("rank = 1").join(joined, F.col("query") == joined["id"], "left_anti")
    rescued = alone.select(F.least("query", "id").alias("lo"), F.greatest("query", "id").alias("hi"), "score").groupBy("lo", "hi").agg(F.max("score").alias("score")).withColumn("method", F.lit("orphan_rescue"))
    out = found.drop("order").unionByName(rescued)
    return out.select("lo", "hi", F.when(F.col("method") == "cooccurrence", "co_occurs_with").otherwise("related_to").alias("rel_type"), "method", F.round("score", 3).alias("score"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, src, dst, score: for each component but the largest, its node that is most like one of the largest (ties: least ids), and that one. nodes: id, embedding; nodes without edges are components."""
    own = components(edges.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    own = cut(own)
    main = own.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    inside = nodes.join(own.join(main, "component", "left_semi").select(F.col("node").alias("id")), "id")
    outside = nodes.join(own.join(main, "component", "left_anti").select(F.col("node").alias("id"), "component"), "id")
    best = nearest(outside.select(F.col("id").alias("query"), "embedding"), inside.select("id", "embedding"), 1).join(own.select(F.col("node").alias("query"), "component"), "query")
    return keep_first(best.withColumn("score", F.round("score", 9)), ["component"], [F.desc("score"), F.asc("query")]).select("component", F.col("query").alias("src"), F.col("id").alias("dst"), F.round("score", 3).alias("score"))


def touched_edges(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """edge_id, hop: the edges at the nodes that each step of an undirected walk stands on; an edge that is met again has several rows."""
    at = k_hop(edges, seeds, hops - 1, directed=False, include_seeds=True) if hops > 1 else seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))
    return ends(edges).join(at, "node").select("edge_id", (F.col("depth") + 1).alias("hop")).distinct()


def neighbourhoods(edges: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """node, n_others, others: the first `most` of the distinct names of a node's neighbours, in order. names: id, name."""
    rows = ends(edges).where("node <> other").select("node", "other").distinct().join(names.select(F.col("id").alias("other"), "name"), "other")
    few = rows.groupBy("node", "name").agg(F.count("*").alias("n"))
    counts = rows.groupBy("node").agg(F.count("*").alias("n_others"))
    top = few.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("name"))).where(F.col("k") <= most)
    return top.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("others")).join(counts, "node").select("node", "n_others", "others")


def resolve(mentions: DataFrame, entities: DataFrame, tau: float = 0.85, least_chars: int = 2) -> DataFrame:
    """mention, entity, how: the oldest entity of the same name, else the nearest by at least tau, else the mention itself as a new one. Names that are too short are nobody's.

    mentions: mention, scope, name, embedding; entities: id, scope, name, embedding, created_at."""
    m = mentions.withColumn("k", X.mention_key(F.col("name"))).where(F.length("k") >= least_chars)
    known = keep_first(entities.withColumn("k", X.mention_key(F.col("name"))), ["scope", "k"], ["created_at", "id"]).select("scope", "k", F.col("id").alias("same"))
    rows = cut(m.join(known, ["scope", "k"], "left"))
    left = rows.where("same is null")
    # Only cells that may hold a likeness of tau are looked at.
    near = nearest(left.select(F.col("mention").alias("query"), "scope", "embedding"), entities.select("id", "scope", "embedding"), 1, least=tau, within="scope").select(F.col("query").alias("mention"), F.col("id").alias("near"))
    out = rows.join(near, "mention", "left")
    how = F.when(F.col("same").isNotNull(), "name").when(F.col("near").isNotNull(), "nearest").otherwise("new")
    return out.select("mention", F.coalesce("same", "near", "mention").alias("entity"), how.alias("how"))


def project_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of triples scope, episode, subject, predicate, object: an entity per name of a scope with its aliases and number of mentions, an edge per pair and predicate with its first episode. Edges from a name to itself and names of one letter are left out."""
    keyed = triples.withColumn("s", X.mention_key(F.col("subject"))).withColumn("o", X.mention_key(F.col("object"))).where((F.length("s") >= 2) & (F.length("o") >= 2) & (F.col("s") != F.col("o")))
    said = keyed.select("scope", "episode", F.explode(F.array(F.struct(F.col("s").alias("name"), F.col("subject").alias("alias")), F.struct(F.col("o").alias("name"), F.col("object").alias("alias")))).alias("m")).select("scope", "episode", "m.name", "m.alias")
    # What an episode says several times is one mention.
    entities = said.distinct().groupBy("scope", "name").agg(F.countDistinct("episode").alias("mention_count"), F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))
    edges = keyed.groupBy("scope", F.col("s").alias("src"), F.col("o").alias("dst"), F.col("predicate").alias("rel_type")).agg(F.min("episode").alias("episode"), F.count("*").alias("n"))
    return entities, edges


def apply_actions(nodes: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Nodes (id, label, status, valid_to) after decisions about them (id, action: prune, retype or claim; label). Pruned nodes end, retyped ones take the label, claims become canonical."""
    rows = nodes.join(actions.select("id", "action", F.col("label").alias("__label")), "id", "left")
    is_ = lambda a: F.coalesce(F.col("action") == a, F.lit(False))
    return rows.select("id", F.when(is_("retype"), F.col("__label")).otherwise(F.col("label")).alias("label"), F.when(is_("claim"), "canonical").otherwise(F.col("status")).alias("status"), F.when(is_("prune") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to")).alias("valid_to"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    keep = nodes.select("node").distinct()
    out = edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi")
    return out.join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def context_lines(nodes: DataFrame, edges: DataFrame, top: int, max_rels: int = 4) -> DataFrame:
    """node, degree, line: the hubs and the first relations of each, as text."""
    from palimpsest.operators.relational import top_per_key

    best = hubs(edges, top)
    rels = ends(edges).join(best, "node").join(nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other", "left")
    few = top_per_key(rels, ["node"], ["edge_id", "direction", "other"], max_rels)
    said = F.concat(F.when(F.col("direction") == "out", "-> ").otherwise("<- "), F.coalesce("other_name", F.col("other").cast("string")))
    lines = few.groupBy("node", "degree").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))).alias("l"))
    return lines.select("node", "degree", F.array_join(F.transform("l", lambda x: x["said"]), "; ").alias("line"))
