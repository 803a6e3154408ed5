"""The verbs that write: recording, adding and invalidating as pure transforms, each with its accepted rows, rejected rows and events.

Nothing is written here. Rejected rows carry a reason, and events are a frame to append in the same batch as the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators.relational import keep_first

#: What stands for a redacted statement, which nobody may add.
REDACTED = "[redacted]"


def _split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def event_rows(rows: DataFrame, kind: str, subject: str = "id", scope: str = "scope") -> DataFrame:
    """An event per row: id (a hash of kind and subject, so that retries agree), type, subject, scope."""
    said = F.col(subject).cast("string")
    return rows.select(F.sha2(F.concat(F.lit(f"{kind}:"), said), 256).alias("id"), F.lit(kind).alias("type"), said.alias("subject"), F.col(scope).alias("scope"))


def record(episodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, events) of episodes id, scope, content: scaffolding is stripped, what is empty then is rejected."""
    rows = episodes.withColumn("content", X.strip_scaffolding(F.coalesce("content", F.lit(""))))
    reason = F.when(F.length("content") == 0, "empty_content")
    good, bad = _split(rows.withColumn("reason", reason))
    return good, bad, event_rows(good, "episode.recorded")


def add(facts: DataFrame, episodes: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, events) of facts id, scope, statement, source_episode_id.

    Rejected: empty statements, the reserved one, unknown episodes or those of another scope, and ids that `known` has. Accepted rows get statement_key."""
    e = episodes.select(F.col("id").alias("__e"), F.col("scope").alias("__scope"))
    k = known.select(F.col("id").alias("__k")).distinct()
    rows = facts.join(e, F.col("source_episode_id") == F.col("__e"), "left").join(k, F.col("id") == F.col("__k"), "left")
    said = F.trim(F.coalesce("statement", F.lit("")))
    reason = (
        F.when(said == "", "empty_statement")
        .when(said == REDACTED, "reserved_statement")
        .when(F.col("__e").isNull(), "episode_missing")
        .when(~F.col("__scope").eqNullSafe(F.col("scope")), "scope_mismatch")
        .when(F.col("__k").isNotNull(), "id_taken")
    )
    judged = rows.withColumn("reason", reason).withColumn("statement_key", X.statement_key(F.col("statement"))).drop("__e", "__scope", "__k")
    good, bad = _split(judged)
    return good, bad, event_rows(good, "fact.stored")


def invalidate(facts: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts with what was asked for ended, rejected requests, events). requests: fact_id, scope, superseded_by.

    Rejected: unknown facts, those of another scope, those that have ended. Of several requests for a fact the one with the least successor counts."""
    f = facts.select(F.col("id").alias("__f"), F.col("scope").alias("__scope"), F.col("valid_to").alias("__end"))
    reason = F.when(F.col("__f").isNull(), "fact_missing").when(F.col("__scope") != F.col("scope"), "scope_mismatch").when(F.col("__end").isNotNull(), "already_ended")
    judged = requests.join(f, F.col("fact_id") == F.col("__f"), "left").withColumn("reason", reason).drop("__f", "__scope", "__end")
    good, bad = _split(judged)
    good = keep_first(good, ["fact_id"], [F.col("superseded_by").asc_nulls_last()])
    ended = good.select(F.col("fact_id").alias("__f"), F.col("superseded_by").alias("__by"))
    out = facts.join(ended, F.col("id") == F.col("__f"), "left")
    hit = F.col("__f").isNotNull()
    out = out.withColumn("valid_to", F.when(hit, now).otherwise(F.col("valid_to"))).withColumn("superseded_by", F.when(hit, F.col("__by")).otherwise(F.col("superseded_by")))
    return out.drop("__f", "__by"), bad, event_rows(good, "fact.invalidated", "fact_id")


def retire_and_insert(old: DataFrame, new: DataFrame, key: list[str], now: Column, status: str = "hypothesis") -> DataFrame:
    """A refreshed snapshot: current rows of `status` end now, the new ones are added unless a row of another status has their key."""
    current = F.col("valid_to").isNull()
    kept = old.withColumn("valid_to", F.when(current & (F.col("status") == status), now).otherwise(F.col("valid_to")))
    held = old.where(current & (F.col("status") != status)).select(*key).distinct()
    return kept.unionByName(new.join(held, key, "left_anti"))
