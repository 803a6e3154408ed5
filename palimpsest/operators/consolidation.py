"""Consolidation passes: similarity dedup, promotion, recombination, event projection, governed forgetting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import lexicon as L
from palimpsest.functions import text as X
from palimpsest.operators.graph import star_roots
from palimpsest.operators.relational import join_dealt, keep_first, numbered, top_per_key
from palimpsest.operators.vector_index import forest, matrix, threshold_join, tiles, unit
from palimpsest.runtime import cut


def similarity_classes(rows: DataFrame, tau: float = 0.92, newest: int | None = None, block: int = 4096) -> DataFrame:
    """id, class_id (least id connected within the scope), n_links (neighbours with cosine of at least tau): one row per row. rows: scope, id, created, embedding.

    All rows of a scope are compared; if `newest` is given only so many of each scope, and the others stand for themselves. Rows of one scope and vector are one until the end; others meet
    where cells of a vector index are in reach. A group of them gives the number of neighbours of each and a tree of links, never pairs."""
    kind = rows.schema["id"].dataType
    seen = rows if newest is None else top_per_key(rows, ["scope"], [F.desc("created"), F.asc("id")], newest)
    named = seen.where("embedding is not null").withColumn("form", F.xxhash64("scope", "embedding"))
    forms = cut(named.groupBy("form").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("scope").alias("scope"), F.first(F.col("embedding").cast("array<double>")).alias("v")))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [left.schema.field("query").type, right.schema.field("id").type, pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], ["id", "to", "n"])
        right = right.sort_by("id")
        m, asks, ids = right["m"].to_numpy(), left["query"].to_numpy(), right["id"].to_numpy()
        near, n = np.zeros((len(asks), len(ids)), bool), np.zeros(len(asks), np.int64)
        for at, score in tiles(unit(matrix(left["v"])), unit(matrix(right["v"]))):
            tile = score >= tau
            near[at : at + len(tile)] = tile
            # A form's own row is no neighbour of itself, but its other rows are.
            n[at : at + len(tile)] = tile.astype(np.int64) @ m - (tile & (asks[at : at + len(tile), None] == ids[None, :])).sum(axis=1)
        i, j = forest(near)
        rows_, columns = np.flatnonzero(i >= 0), np.flatnonzero(j >= 0)
        ids = pa.concat_arrays([left["query"].combine_chunks().take(pa.array(rows_)), right["id"].combine_chunks().take(pa.array(columns))])
        return pa.table([ids, right["id"].take(pa.array(np.concatenate([i[rows_], j[columns]]))), pa.array(np.concatenate([n[rows_], np.zeros(len(columns), np.int64)]))], ["id", "to", "n"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("to", kind), T.StructField("n", T.LongType())])
    found = threshold_join(forms, tau, judge, schema, ("m",), block)
    n = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = star_roots(found.select(F.col("id").alias("u"), F.col("to").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("class_id"))
    classes = forms.select("form", "id").join(roots, "id", "left").join(n, "id", "left").select("form", F.coalesce("class_id", "id").alias("class_id"), "n_links")
    judged = join_dealt(named.select("id", "form"), classes, "form", "id").drop("form")
    return rows.select("id").join(judged, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def duplicates(rows: DataFrame, tau: float = 0.92, auto: float = 0.985, block: int = 4096) -> DataFrame:
    """id, superseded_by: rows that a newer one of their scope repeats, with the newest that does. rows: scope, id, created, key, embedding.

    From `auto` on likeness is enough, from `tau` on keys (as a confirming score, an equal statement) must agree. Of equal age the greater id is the newer one. Rows of one scope, vector and key are
    one, with the newest of them; others meet where cells of a vector index are in reach, and a group gives each its newest likeness."""
    kind, made = rows.schema["id"].dataType, rows.schema["created"].dataType
    named = rows.where("embedding is not null").withColumn("form", F.xxhash64("scope", "embedding", "key", F.col("key").isNull()))
    forms = named.groupBy("form").agg(F.max(F.struct("created", "id")).alias("last"), F.first("scope").alias("scope"), F.first("key").alias("key"), F.first(F.col("embedding").cast("array<double>")).alias("v"))
    forms = cut(forms.select(F.col("form").alias("id"), "scope", "v", "key", F.col("last.created").alias("created"), F.col("last.id").alias("newest")))
    schema = T.StructType([T.StructField("form", T.LongType()), T.StructField("created", made), T.StructField("by", kind)])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], right.schema.field("created").type), pa.array([], right.schema.field("newest").type)], ["form", "created", "by"])
        right = right.sort_by([("created", "descending"), ("newest", "descending")])
        # Equal keys have equal codes, in both tables.
        codes = pa.concat_arrays([left["key"].combine_chunks(), right["key"].combine_chunks()]).dictionary_encode().indices.fill_null(-1).to_numpy()
        mine, other = codes[: left.num_rows], codes[left.num_rows :]
        first = np.full(left.num_rows, -1)
        for at, score in tiles(unit(matrix(left["v"])), unit(matrix(right["v"]))):
            own = mine[at : at + len(score), None]
            good = (score >= auto) | ((score >= tau) & (own == other[None, :]) & (own >= 0))
            first[at : at + len(score)] = np.where(good.any(axis=1), good.argmax(axis=1), -1)
        i = np.flatnonzero(first >= 0)
        j = pa.array(first[i])
        return pa.table([left["query"].take(pa.array(i)), right["created"].take(j), right["newest"].take(j)], ["form", "created", "by"])

    found = threshold_join(forms, min(tau, auto), judge, schema, ("key", "created", "newest"), block)
    best = found.groupBy("form").agg(F.max(F.struct("created", F.col("by").alias("id"))).alias("best"))
    judged = join_dealt(named.select("id", "created", "form"), best, "form", "id").where(F.struct("created", "id") < F.col("best"))
    return judged.select("id", F.col("best.id").alias("superseded_by"))


def promote(memories: DataFrame, t: Column, at_most: int = 100) -> DataFrame:
    """The oldest working rows become semantic and get an episode `working:<id>`."""
    working = memories.where("tier = 'working' and valid_to is null").orderBy("created_at", "id").limit(at_most)
    ids = working.select(F.col("id").alias("__id"), F.lit(True).alias("__up"))
    rows = memories.join(ids, F.col("id") == F.col("__id"), "left")
    up = F.coalesce("__up", F.lit(False))
    return rows.withColumn("tier", F.when(up, "semantic").otherwise(F.col("tier"))).withColumn("episode", F.when(up, F.concat(F.lit("working:"), F.col("id").cast("string")))).withColumn("updated_at", F.when(up, t)).drop("__id", "__up")


def recombine(memories: DataFrame, cap: int = 20, least: float = 0.2, most: float = 0.7) -> DataFrame:
    """Conjectures from pairs of current canonical statements of a scope whose word overlap lies between the two: id1, id2, overlap, text; the `cap` of the greatest overlap.

    Pairs meet by shared words. A word that very many statements have says little and would pair them all; but a statement of n words that shares at least
    least * n of them with another shares one of its n - ceil(least * n) + 1 rarest, so the smaller one of a pair is looked up by these only."""
    rows = memories.where("status = 'canonical' and valid_to is null")
    words = rows.select("scope", "id", X.word_set(F.col("statement"), 3).alias("w")).where(F.size("w") >= 3)
    terms = cut(words.select("scope", "id", "w", F.explode("w").alias("t")))
    rank = F.row_number().over(Window.partitionBy("scope", "id").orderBy("df", "t"))
    kept = F.size("w") - F.ceil(F.lit(least) * F.size("w") - 1e-9) + 1
    rare = terms.join(terms.groupBy("scope", "t").agg(F.count("*").alias("df")), ["scope", "t"]).withColumn("r", rank).where(F.col("r") <= kept).select("scope", F.col("id").alias("i"), F.col("w").alias("w1"), "t")
    met = rare.join(terms.withColumnRenamed("w", "w2"), ["scope", "t"]).where((F.col("i") != F.col("id")) & (F.size("w1") <= F.size("w2")))
    pairs = met.select(F.least("i", "id").alias("id1"), F.greatest("i", "id").alias("id2"), "w1", "w2").dropDuplicates(["id1", "id2"])
    scored = pairs.withColumn("overlap", F.round(X.overlap_of_least(F.col("w1"), F.col("w2")), 6)).where(F.col("overlap").between(least, most))
    shared = F.array_join(F.slice(F.array_sort(F.array_intersect("w1", "w2")), 1, 5), ", ")
    return scored.orderBy(F.desc("overlap"), "id1", "id2").limit(cap).select("id1", "id2", "overlap", F.concat(F.lit("These may be linked by: "), shared).alias("text"))


def to_distil(episodes: DataFrame, memories: DataFrame, limit: int | None = None, batch: int = 6, skip: str = "jrnl:") -> tuple[DataFrame, DataFrame]:
    """(episodes with their batch, markers): what is to be distilled into facts, the oldest first in batches, and what can't hold any.

    Episodes that a memory comes from, and those whose source begins with `skip`, are done. Trivial turns get a marker: a retired working row that keeps them from being looked at again.
    episodes: id, scope, content, source_ref, created_at."""
    done = memories.select(F.col("source_episode_id").alias("__e"), F.col("scope").alias("__s")).distinct()
    rows = episodes.where(X.lacks_prefix(F.col("source_ref"), skip)).join(done, (F.col("id") == F.col("__e")) & (F.col("scope") == F.col("__s")), "left_anti")
    if limit is not None:
        rows = top_per_key(rows, ["scope"], ["created_at", "id"], limit).drop("rank")
    trivial = X.is_trivial_turn(F.col("content"))
    markers = rows.where(trivial).select("id", "scope", F.concat(F.lit("_distilled:"), F.col("id").cast("string")).alias("statement_key"), F.lit("working").alias("tier"), F.lit("hypothesis").alias("status"))
    kept = numbered(rows.where(~trivial), ["scope"], ["created_at", "id"], "n")
    return kept.withColumn("batch", F.floor((F.col("n") - 1) / batch).cast("long")).drop("n"), markers


def distil(episodes: DataFrame, facts: Column, most: int = 3, least_chars: int = 8, kinds: tuple[str, ...] = ("fact", "preference", "decision")) -> DataFrame:
    """episode, kind, statement, statement_key: the facts of each episode, an array of (kind, statement), the first `most` of some length and a known kind; of equal keys of an episode the first."""
    good = F.filter(facts, lambda f: f["kind"].isin(*kinds) & (F.length(F.trim(f["statement"])) >= least_chars))
    rows = episodes.select(F.col("id").alias("episode"), "scope", F.posexplode(F.slice(good, 1, most)).alias("k", "f"))
    rows = rows.select("episode", "scope", "k", "f.kind", "f.statement", X.statement_key(F.col("f.statement")).alias("statement_key"))
    return keep_first(rows, ["episode", "statement_key"], ["k"]).drop("k")


def run_passes(state: dict[str, DataFrame], passes: dict, mode: str = "fast") -> tuple[dict[str, DataFrame], list[str]]:
    """All passes of a mode in their order, each from the state (frames by name) that the one before leaves; and which were run. A pass without a function is left out."""
    done = []
    for name in L.PASSES[mode]:
        if name in passes:
            state = {**state, **{k: cut(v) for k, v in passes[name](state).items()}}
            done.append(name)
    return state, done


def promote_identity(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """scope, predicate, object, confidence: of what reflections suggest (scope, predicate, object, confidence, seq), the best per predicate, unless it is known already. Pieces of transcripts are left out; of equal confidence the first wins.

    facts: scope, predicate, object, valid_to."""
    good = candidates.where(F.col("predicate").isNotNull() & F.col("object").isNotNull()).where(~X.is_transcript(F.col("object")))
    best = keep_first(good.withColumn("confidence", F.coalesce("confidence", F.lit(0.6))), ["scope", "predicate"], [F.desc("confidence"), F.asc("seq")])
    known = facts.where("valid_to is null").select("scope", "predicate", "object").distinct()
    return best.join(known, ["scope", "predicate", "object"], "left_anti").select("scope", "predicate", "object", "confidence")


def apply_goal_deltas(goals: DataFrame, reports: DataFrame) -> DataFrame:
    """Goals with what the latest report of their scope says of them: status, and progress 1 if it is completed. reports: scope, seq, deltas (array of goal_id, status)."""
    last = keep_first(reports, ["scope"], [F.desc("seq")]).select("scope", F.explode("deltas").alias("d")).select("scope", F.col("d.goal_id").alias("id"), F.col("d.status").alias("__status"))
    one = last.groupBy("scope", "id").agg(F.max("__status").alias("__status"))
    rows = goals.join(one, ["scope", "id"], "left")
    return rows.withColumn("progress", F.when(F.col("__status") == "completed", 1.0).otherwise(F.col("progress"))).withColumn("status", F.coalesce("__status", "status")).drop("__status")


def mirror_principles(principles: DataFrame, memories: DataFrame) -> DataFrame:
    """scope, statement of current principles that no current memory says; those that only count words are none."""
    rows = principles.where("valid_to is null").where(F.length(F.trim("statement")) > 0).where(~X.is_counted_principle(F.col("statement")))
    said = memories.where("valid_to is null").select("scope", "statement").distinct()
    return rows.select("scope", "statement").distinct().join(said, ["scope", "statement"], "left_anti")


def project_events(log: DataFrame, watermark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current state per (scope, id) after the events beyond each scope's watermark, and the new watermarks.

    log: scope, seq, kind (stored, consolidated, invalidated or other), id, body. An invalidation leaves a tombstone."""
    rows = log.join(watermark.select("scope", F.col("seq").alias("__w")), "scope", "left").where(F.col("seq") > F.coalesce("__w", F.lit(-1)))
    acted = rows.where(F.col("kind").isin("stored", "consolidated", "invalidated"))
    state = acted.groupBy("scope", "id").agg(F.max(F.struct("seq", "kind", "body")).alias("last"))
    state = state.select("scope", "id", F.col("last.seq").alias("seq"), F.when(F.col("last.kind") != "invalidated", F.col("last.body")).alias("body"), (F.col("last.kind") == "invalidated").alias("tombstone"))
    marks = rows.groupBy("scope").agg(F.max("seq").alias("seq"))
    kept = watermark.select("scope", "seq").join(marks.select("scope"), "scope", "left_anti")
    return state, kept.unionByName(marks)


def forget(memories: DataFrame, requests: DataFrame, approvals: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Hard forgetting behind an approval: (memories with what was granted redacted, requests with ok and reason).

    A request (memory_id, scope, approval_id) needs a granted approval of its scope and class that hasn't expired; an approval serves one request, that of the least memory id."""
    once = Window.partitionBy("approval_id").orderBy("memory_id")
    a = approvals.select(F.col("id").alias("__a"), F.col("scope").alias("__s"), "action_class", "state", "expires_at")
    rows = requests.withColumn("__n", F.row_number().over(once)).join(a, F.col("approval_id") == F.col("__a"), "left")
    reason = (
        F.when(F.col("__a").isNull(), "approval_missing")
        .when(F.col("action_class") != "memory_forget_hard", "approval_class_mismatch")
        .when(F.col("__s") != F.col("scope"), "approval_scope_mismatch")
        .when(F.col("state") != "granted", "approval_not_granted")
        .when(F.col("expires_at") <= now, "approval_expired")
        .when(F.col("__n") > 1, "approval_already_used")
    )
    judged = rows.select("memory_id", "scope", "approval_id", reason.isNull().alias("ok"), reason.alias("reason"))
    gone = judged.where("ok").select(F.col("memory_id").alias("__m"), F.col("scope").alias("__sc")).distinct()
    out = memories.join(gone, (F.col("id") == F.col("__m")) & (F.col("scope") == F.col("__sc")), "left")
    hit = F.col("__m").isNotNull()
    return out.withColumn("statement", F.when(hit, "[redacted]").otherwise(F.col("statement"))).withColumn("statement_key", F.when(hit, F.lit(None)).otherwise(F.col("statement_key"))).withColumn("valid_to", F.when(hit, F.coalesce("valid_to", now)).otherwise(F.col("valid_to"))).drop("__m", "__sc"), judged


def action_histogram(log: DataFrame) -> DataFrame:
    """action, n, scopes: what a projection makes of the events of a log (scope, kind)."""
    action = F.when(F.col("kind").isin("stored", "consolidated", "invalidated"), F.col("kind")).otherwise("noop")
    return log.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"))
