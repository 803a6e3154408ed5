"""Bi-temporal facts: intervals are half-open, [valid_from, valid_to), with null for open ends. Time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def as_of(df: DataFrame, t: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.where(valid_at(t, start, end))


def validity(df: DataFrame, which: str, end: str = "valid_to") -> DataFrame:
    """current, superseded or all."""
    return {"current": df.where(F.col(end).isNull()), "superseded": df.where(F.col(end).isNotNull()), "all": df}[which]


def supersede(df: DataFrame, key: list[str], order: list[str], id_col: str = "id", at: str = "valid_from") -> DataFrame:
    """Each row of a key is superseded by the next in the order: adds valid_to and superseded_by."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("valid_to", F.lead(at).over(w)).withColumn("superseded_by", F.lead(id_col).over(w))


def soft_delete(df: DataFrame, condition: Column, t: Column, end: str = "valid_to") -> DataFrame:
    return df.withColumn(end, F.when(condition & F.col(end).isNull(), t).otherwise(F.col(end)))


def running_winners(df: DataFrame, key: list[str], order: list[str], confidence: str = "confidence", id_col: str = "id", at: str = "created_at", gate: float = 0.75) -> DataFrame:
    """The proposals that became current: those of strictly greater confidence than all before. Adds status, valid_from, valid_to, superseded_by.

    The set form of proposing one after the other: a winner's end is the next winner's start."""
    w = Window.partitionBy(*key).orderBy(*order)
    best = F.max(confidence).over(w.rowsBetween(Window.unboundedPreceding, -1))
    won = df.withColumn("__best", best).where(F.col("__best").isNull() | (F.col(confidence) > F.col("__best"))).drop("__best")
    status = F.when(F.col(confidence) >= gate, "canonical").otherwise("hypothesis")
    return won.select("*", status.alias("status"), F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), F.lead(id_col).over(w).alias("superseded_by"))


def last_of_chain(df: DataFrame, id_col: str = "id", next_col: str = "superseded_by", max_rounds: int = 40) -> DataFrame:
    """id, current: the end of each supersession chain, by pointer doubling."""
    from palimpsest.runtime import cut

    jump = cut(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(next_col), F.col(id_col)).alias("to")))
    for _ in range(max_rounds):
        step = jump.select(F.col("id").alias("mid"), F.col("to").alias("to2"))
        new = cut(jump.join(step, F.col("to") == F.col("mid"), "left").select("id", F.coalesce("to2", "to").alias("to"), (F.coalesce("to2", "to") != F.col("to")).alias("moved")))
        jump = new.select("id", "to")
        if new.where("moved").isEmpty():
            break
    return jump.select("id", F.col("to").alias("current"))


def conflicts(df: DataFrame, key: list[str], winner: list[Column], id_col: str = "id") -> DataFrame:
    """Rows of a key beside its winner (first by the order), with the winner's id: what conflict resolution retires."""
    w = Window.partitionBy(*key).orderBy(*winner)
    ranked = df.withColumn("__n", F.row_number().over(w)).withColumn("superseded_by", F.first(id_col).over(w))
    return ranked.where("__n > 1").drop("__n")


def decay(df: DataFrame, now: Column, days: int = 90, speculative: tuple[str, ...] = ("conjecture", "hypothesis", "possible_world")) -> DataFrame:
    """Retire working canonical rows and speculative ones that are older than `days`."""
    old = S.days_between(now, F.col("created_at")) > days
    cold = ((F.col("tier") == "working") & (F.col("status") == "canonical")) | F.col("status").isin(*speculative)
    return soft_delete(df, old & cold, now)
