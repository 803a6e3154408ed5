"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated for as many epochs as allowed. A
document's virtual finish time is the words of its queue up to its end over the queue's target, so all queues
reach their targets at virtual time 1, where the total budget ends: there the mix is cut, and the document
that a queue has in service then is taken in part. `mix` gives these figures per document, `entries` the mix
itself, range-sorted by virtual finish time.

Running sums don't gather a source in one task: each source is dealt over ranges of the shuffle key, the ranges
are summed first, and a document adds the sum of the ranges before its own to the running sum within its range.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own and
last by code point; equal rows are each dealt their own place, rows of equal id by a hash of their texts; an empty table gives no rows; the id may be null. Only id,
text and source are read, other columns pass through `mix` under their names (result columns of those names replace them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
RANGES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: str, seed: int) -> Column:
    """The shuffled order: 32 hex digits that any engine with md5 can repeat."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from source, source_size: shares by weight, none above `epochs` times its source.

    Sources above get their limit and the others share the rest anew, until none is above: the sources are put in the order of
    limit over weight, and the first k of them are at their limit, k being the least for which the rest fit. One row per source, so windows over all of them are small."""
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rows = source_sizes.withColumn("n", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("limit", F.lit(float(epochs)) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.col("weight_left"))
    # The level at the first source that stays below its limit is that of all that follow.
    rows = rows.withColumn("place", F.row_number().over(by_ratio))
    below = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    rows = rows.withColumn("fill", F.min(below).over(everything)["level"])
    target = F.when(F.col("fill").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("fill") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 7, size: Column | None = None) -> DataFrame:
    """`docs` with size, source_size, target, virtual_start (of epoch 1), virtual_finish and taken. The text passes through only if `docs` is asked for it later."""
    added = ("size", "source_size", "target", "virtual_start", "virtual_finish", "taken")
    rest = [c for c in docs.columns if c not in (*added, source_col)]
    size_, mark, key, range_, source, source_t, source_s, range_s, before_, in_range, start = K.fresh(docs.columns, "__size", "__mark", "__key", "__range", "__source", "__source_t", "__source_s", "__range_s", "__before", "__in_range", "__start")
    rows = docs.withColumn(size_, size_of(F.col(text_col)) if size is None else size).withColumn(mark, F.xxhash64(text_col)).withColumn(key, shuffle_key(id_col, seed))
    rows = rows.withColumn(range_, (F.conv(F.substring(key, 1, 4), 16, 10).cast("long") * RANGES / 65536).cast("int"))
    rows = rows.select(*rest, F.col(source_col).alias(source), size_, mark, key, range_)

    sums = rows.groupBy(source, range_).agg(F.sum(size_).alias(in_range))
    aims = targets(sums.groupBy(F.col(source).alias("source")).agg(F.sum(in_range).alias("source_size")), weights, share, epochs)
    aims = aims.select(F.col("source").alias(source_t), "source_size", "target")
    before = Window.partitionBy(source).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn(before_, F.coalesce(F.sum(in_range).over(before), F.lit(0)))
    starts = starts.join(aims, F.col(source).eqNullSafe(F.col(source_t))).select(F.col(source).alias(source_s), F.col(range_).alias(range_s), before_, "source_size", "target")

    rows = rows.join(starts, F.col(source).eqNullSafe(F.col(source_s)) & (F.col(range_) == F.col(range_s)))
    within = Window.partitionBy(source, range_).orderBy(key, F.col(id_col).asc_nulls_last(), size_, mark).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.col(before_) + F.coalesce(F.sum(size_).over(within), F.lit(0)))
    aim = F.floor("target").cast("long")
    epoch = lambda k: F.greatest(F.lit(0), F.least(F.col(size_), aim - k * F.col("source_size") - F.col(start)))
    taken = sum((epoch(k) for k in range(1, epochs)), epoch(0)).cast("long")
    over = lambda words: F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))
    return rows.select(*rest, F.col(source).alias(source_col), F.col(size_).alias("size"), "source_size", "target", over(F.col(start)).alias("virtual_start"), over(F.col(start) + F.col(size_)).alias("virtual_finish"), taken.alias("taken"))


def entries(mixed: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix: one row per document and epoch that has words in it, globally range-sorted by virtual finish time, cut at time 1.

    `mixed` is a result of `mix`. Adds epoch (0 first) and taken_words, those of this entry; a reader takes that many words from the text."""
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    lap = F.when(F.col("target") > 0, F.col("epoch") * F.col("source_size") / F.col("target")).otherwise(F.lit(0.0))
    start = F.round(F.col("virtual_start") * F.col("target")).cast("long") + F.col("epoch") * F.col("source_size")
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - start)).cast("long")
    rows = mixed.withColumn("epoch", epoch).withColumn("taken_words", words)
    rows = rows.withColumn("virtual_start", F.col("virtual_start") + lap).withColumn("virtual_finish", F.col("virtual_finish") + lap)
    return rows.where("taken_words > 0").orderBy("virtual_finish", "virtual_start")
