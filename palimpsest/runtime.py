"""Session helpers: a local session for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Rows, and bytes of values that are exchanged, for each of which `planned_once` has a partition; up to so many partitions it plans once.
PART_ROWS = 4096
PART_BYTES = 32 << 20
PLANNED_ONCE = 16


def local_session(app: str = "palimpsest", cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine; clusters bring their own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and all runs on one machine (tests) a local one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors and the driver need a folder that they share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that a lost executor costs no recomputation of what lies before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session within this; after it they are as they were."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this, shuffle files go when the action ends that wrote them, not when the driver happens to collect its garbage, and the texts of plans that the driver makes
    anew after each stage, and keeps for its status, are short. For loops over frames that are cut or written."""
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.ui.explainMode": "simple", "spark.sql.maxPlanStringLength": "4096"}):
        yield


@contextmanager
def planned_once(spark: SparkSession, rows: int, size: int = 0, most: int = PLANNED_ONCE) -> Iterator[int]:
    """Within this, what is so small that it needs `most` partitions at most has no more partitions than it needs, and its plans aren't made anew after each stage. Gives the number of partitions needed.

    For each stage of an adaptive plan the driver starts a job and threads that live for a minute, and the smaller the tables, the more stages there are in a minute. For one partition it compiles no code either, which takes longer than the rows do. size: bytes of all that is exchanged at once.
    Where the session keeps more partitions all the same, plans stay adaptive, which puts them together."""
    parts = max(1, -(-rows // PART_ROWS), -(-size // PART_BYTES))
    if parts > most:
        yield parts
        return
    name = "spark.sql.shuffle.partitions"
    with settings(spark, {name: str(min(parts, int(spark.conf.get(name))))}):
        once = {"spark.sql.adaptive.enabled": "false"} if int(spark.conf.get(name)) <= most else {}
        with settings(spark, once | ({"spark.sql.codegen.wholeStage": "false"} if parts == 1 else {})):
            yield parts


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of `df`, read again from a table at the path: like `cut`, but the caller can remove it by name."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written for one use, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
