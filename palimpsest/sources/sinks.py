"""Sinks: snapshots in place of in-place writes, events beside the rows they tell of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that `df` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_events(rows: DataFrame, kind: str, id_col: str = "id", scope_col: str = "scope") -> tuple[DataFrame, DataFrame]:
    """The rows and one event for each, whose id is a hash of what it tells, so that a retry tells the same."""
    data = F.to_json(F.struct(*rows.columns))
    events = rows.select(F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), data), 256), 1, 26)).alias("id"), F.lit(kind).alias("type"), F.col(id_col).cast("string").alias("subject"), F.col(scope_col).alias("scope"), data.alias("data"))
    return rows, events


def deliver_once(runs: DataFrame, delivered: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs that haven't been delivered, each once."""
    return runs.dropDuplicates([key]).join(delivered.select(key), key, "left_anti")


def write_vectors_tsv(rows: DataFrame, path: str, id_col: str = "id", column: str = "embedding") -> None:
    """Lines of id, tab, JSON array, as vectors_tsv reads them; added to what is there."""
    rows.select(F.concat_ws("\t", F.col(id_col).cast("string"), F.to_json(F.col(column))).alias("value")).write.mode("append").text(path)
