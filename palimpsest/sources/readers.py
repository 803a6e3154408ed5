"""Readers: vaults of text files, paragraph chunks, triples, vectors, logs, archives of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def vault(spark: SparkSession, path: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), pattern: str = "*.md") -> DataFrame:
    """Text files below a folder: path (from the folder), top (first folder), text."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    # By the folder's name: the scheme before it may be written otherwise than it was given.
    root = path.rstrip("/").rsplit("/", 1)[-1] + "/"
    rel = F.split_part(F.col("_metadata.file_path"), F.lit(root), F.lit(-1))
    rows = rows.select(rel.alias("path"), F.col("value").alias("text"))
    rows = rows.withColumn("top", F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(""))
    rows = rows.where(F.col("top").isin(*include)) if include else rows
    return rows.where(~F.col("top").isin(*exclude)) if exclude else rows


def chunks(text: Column, size: int = 1200) -> Column:
    """Paragraphs (split at blank lines, longer ones cut hard) packed in order into chunks of at most `size` characters, two of them for each joint."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda k: F.substring(p, k * size + 1, F.lit(size)))))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 2 + F.length(p) <= size)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), p)))
        return F.when(fits, joined).otherwise(F.array_append(acc, p))

    return F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).otherwise(step(acc, p)))


def triples(spark: SparkSession, path: str, least: float = 0.5, aliases: dict[str, str] | None = None, identity: tuple[str, ...] = ()) -> DataFrame:
    """JSON triples (subject, predicate, object, confidence, source_file) with normalised predicate and class; those below the confidence are dropped. aliases: renamed predicates; identity: those of identity."""
    rows = spark.read.option("multiLine", True).schema("subject string, predicate string, object string, confidence double, source_file string").json(path)
    rows = rows.where(F.coalesce("confidence", F.lit(1.0)) >= least).withColumn("predicate", X.predicate_name(F.col("predicate"), aliases))
    return rows.withColumn("class", X.predicate_class(F.col("predicate"), identity))


def by_source(rows: DataFrame) -> DataFrame:
    """source_file, triples: imported triples by the file that they come from, each an array in the order of its parts."""
    return rows.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("subject", "predicate", "object", "confidence", "class"))).alias("triples"))


def vectors_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, embedding from lines of id, tab, JSON array."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("id string, vector string").csv(path)
    return rows.select("id", F.from_json("vector", "array<float>").alias("embedding"))


def fill_vectors(items: DataFrame, loaded: DataFrame, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """Vectors where there were none."""
    new = loaded.select(F.col("id").alias("__id"), F.col("embedding").alias("__new"))
    return items.join(new, F.col(id_col) == F.col("__id"), "left").withColumn(column, F.coalesce(column, "__new")).drop("__id", "__new")


def not_done(todo: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """What a resumed job has left, the shortest texts first within a partition, so that batches are even."""
    return todo.join(done.select(id_col), id_col, "left_anti").sortWithinPartitions(F.length("text"))


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n lines that aren't empty of a folder of log files: line, in order. Files come by name, lines as they stand in them; each task gives its last n, and nothing is sorted as a whole."""
    rows = spark.read.text(path).where("value <> ''")
    # Within a piece of a file numbers rise with the lines, whatever order the pieces are read in.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")]
    order = lambda f: [f("file"), f("start"), f("n")]
    last = rows.select("value", *place).orderBy(*order(F.desc)).limit(n).orderBy(*order(F.asc))
    return last.select(F.col("value").alias("line"))
