"""Keyed writes without a lakehouse format, ordered state, and interleaving."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import cut


def keep_first(df: DataFrame, key: list, order: list) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def repeats(df: DataFrame, key: list, order: list) -> DataFrame:
    """The rows that keep_first leaves out."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n > 1").drop("__n")


def top_per_key(df: DataFrame, key: list, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key `new` lacks. Keys are unique in each."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def repoint(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace `column` by mapping(old, new) where it has one."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return df.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def protected_delete(df: DataFrame, protected: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Rows whose id is in none of the protected sets: what a hard delete may remove."""
    ids = protected[0].toDF("__id")
    for p in protected[1:]:
        ids = ids.union(p.toDF("__id"))
    return df.join(ids.distinct(), F.col(id_col) == F.col("__id"), "left_anti")


def interleave(df: DataFrame, key: list, kind: str, order: list, kinds: list[str]) -> DataFrame:
    """Round-robin over kinds within each key: the first of each, then the second of each; kinds in the order given. Adds place, which skips kinds that have run out."""
    n = F.row_number().over(Window.partitionBy(*key, kind).orderBy(*order))
    rows = df.withColumn("place", (n - 1) * len(kinds) + F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)))
    return rows.withColumn("place", F.col("place").cast("long"))


def gap_sessions(df: DataFrame, key: list[str], at: str, gap: str, order: list | None = None) -> DataFrame:
    """Adds session, from 0: a new one starts where the time since the row before is at least the gap."""
    w = Window.partitionBy(*key).orderBy(*(order or [at]))
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= F.expr(f"INTERVAL {gap}")).cast("long"), F.lit(0))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w).cast("long")).drop("__new")


def ranged(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """`df` dealt over ranges of key and order, with the range's number: a key of any number of rows is several ranges. Written, so that the ranges stay as they are."""
    return cut(df.repartitionByRange(*key, *order).withColumn("__range", F.spark_partition_id().cast("long")))


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Adds each row's place in its key, from 1. Ranges are numbered one by one, and add what stands before them."""
    rows = ranged(df, key, order)
    names = [*key, "__range"]
    sizes = rows.groupBy(*names).agg(F.count("*").alias("__size"))
    ahead = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"__of_{k}") for k in names], F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__before"))
    joined = rows.join(before, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in names]).drop(*[f"__of_{k}" for k in names])
    return joined.withColumn(name, F.col("__before") + F.row_number().over(Window.partitionBy(*names).orderBy(*order))).drop("__before", "__range")


def previous(df: DataFrame, key: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds, under `name`, the column's value in the row before of the same key. Ranges are looked at one by one, and the first row of each takes the last value of the one before."""
    rows = ranged(df, key, order)
    last = rows.groupBy(*key, "__range").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__last"))
    names = [*key, "__range"]
    carry = last.select(*[F.col(k).alias(f"__of_{k}") for k in names], F.lag("__last").over(Window.partitionBy(*key).orderBy("__range")).alias("__carry"))
    joined = rows.join(carry, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in names], "left").drop(*[f"__of_{k}" for k in names])
    w = Window.partitionBy(*names).orderBy(*order)
    before = F.coalesce(F.lag(F.struct(F.col(column).alias("v"))).over(w), F.col("__carry"))
    return joined.withColumn(name, before["v"]).drop("__carry", "__range")


def segments(df: DataFrame, key: list[str], order: str, shift: Column, least: int = 3) -> DataFrame:
    """key, order, segment: a boundary where `shift` is true and the running segment has `least` members already.

    That depends on the length so far, of which only whether it has reached `least` counts. So each range of a key says for each such length what it makes of it; these are
    put together range after range, and then each range is walked once more from where it really starts."""
    rows = ranged(df.select(*key, order, F.coalesce(shift, F.lit(False)).alias("__s")), key, [order])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = ", ".join(f"{k} {kinds[k]}" for k in key)

    def walk(flags: list[bool], n: int) -> tuple[list[int], int]:
        seg, out = 0, []
        for s in flags:
            n, seg = (1, seg + 1) if s and n >= least else (min(n + 1, least), seg)
            out.append(seg)
        return out, n

    def maps(group: pa.Table) -> pa.Table:
        flags = group.sort_by(order)["__s"].to_pylist()
        ends = [walk(flags, n) for n in range(least + 1)]
        first = group.slice(0, 1).select([*key, "__range"])
        return first.append_column("to", pa.array([[n for _, n in ends]], pa.list_(pa.int64()))).append_column("more", pa.array([[out[-1] for out, _ in ends]], pa.list_(pa.int64())))

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("__range")
        n, seg, starts, before = 0, 0, [], []
        for to, more in zip(group["to"].to_pylist(), group["more"].to_pylist(), strict=True):
            starts.append(n)
            before.append(seg)
            n, seg = to[n], seg + more[n]
        return group.select([*key, "__range"]).append_column("n", pa.array(starts, pa.int64())).append_column("seg", pa.array(before, pa.int64()))

    def number(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        out, _ = walk(group["__s"].to_pylist(), group["n"][0].as_py())
        return group.select([*key, order]).append_column("segment", pa.array([x + group["seg"][0].as_py() for x in out], pa.int64()))

    of_ranges = rows.groupBy(*key, "__range").applyInArrow(maps, f"{keys}, __range bigint, to array<bigint>, more array<bigint>")
    starts = of_ranges.groupBy(*key).applyInArrow(chain, f"{keys}, __range bigint, n bigint, seg bigint")
    return rows.join(starts, [*key, "__range"]).groupBy(*key, "__range").applyInArrow(number, f"{keys}, {order} {kinds[order]}, segment bigint")


def hash_chain(df: DataFrame, key: list[str], order: str, body: Column) -> DataFrame:
    """key, order, prev_hash, entry_hash: entry_hash = SHA-256(previous hash, SHA-256 of the body), in hex; the first previous hash is 64 zeros.

    A chain is one after the other by what it is, so a key is one group: of a run or a conversation, of which only the hashes of the bodies are held."""
    rows = df.select(*key, order, F.sha2(body.cast("binary"), 256).alias("__b"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        last, before, entries = "0" * 64, [], []
        for b in group["__b"].to_pylist():
            before.append(last)
            last = hashlib.sha256((last + b).encode()).hexdigest()
            entries.append(last)
        return group.select([*key, order]).append_column("prev_hash", pa.array(before)).append_column("entry_hash", pa.array(entries))

    return rows.groupBy(*key).applyInArrow(link, ", ".join(f"{c} {kinds[c]}" for c in (*key, order)) + ", prev_hash string, entry_hash string")


def first_break(chain: DataFrame, key: list[str], order: str, body: Column) -> DataFrame:
    """key, broken_at: the first entry that doesn't follow from the one stored before it, or null. Needs no fold, only the row before."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.coalesce(F.lag("entry_hash").over(w), F.lit("0" * 64))
    good = (F.col("prev_hash") == before) & (F.col("entry_hash") == F.sha2(F.concat(F.col("prev_hash"), F.sha2(body.cast("binary"), 256)).cast("binary"), 256))
    return chain.withColumn("__good", good).groupBy(*key).agg(F.min(F.when(~F.col("__good"), F.col(order))).alias("broken_at"))


def run_lengths(df: DataFrame, key: list[str], order: list, flag: Column) -> DataFrame:
    """Adds consecutive: how many rows with the flag end at this row (0 where it is false)."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*key, "__g").orderBy(*order)
    return rows.withColumn("consecutive", F.sum(F.col("__f").cast("long")).over(inside)).drop("__f", "__g")


def nulls_last_desc(*columns: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns]


def with_defaults(own: DataFrame, preset: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """key, value, origin: what is set, else the default; keys that have none are free."""
    a, b = own.select(*key, F.col(value).alias("__own")), preset.select(*key, F.col(value).alias("__preset"))
    origin = F.when(F.col("__preset").isNull(), "free").when(F.col("__own").isNull(), "default").otherwise("set")
    return a.join(b, key, "full").select(*key, F.coalesce("__own", "__preset").alias(value), origin.alias("origin"))


def not_in(df: DataFrame, column: str, others: DataFrame) -> DataFrame:
    """SQL's NOT IN (others has one column): nothing is left if any other is null, and rows of null only if there are none."""
    (name,) = others.columns
    nulls, some = others.where(F.col(name).isNull()), others.where(F.col(name).isNotNull())
    left = df.join(some.select(F.col(name).alias("__other")).distinct(), F.col(column) == F.col("__other"), "left_anti")
    if not nulls.isEmpty():
        return left.where(F.lit(False))
    return left if some.isEmpty() else left.where(F.col(column).isNotNull())


def latest_with_ties(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """All rows of each key that have its greatest value. One value per key is found first, so that a key's rows need no order."""
    last = df.groupBy(*key).agg(F.max(at).alias("__last"))
    return df.join(last, key).where(F.col(at) == F.col("__last")).drop("__last")


def tagged_union(frames: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """The rows of several frames of equal columns, each with the name of its own."""
    rows = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias(tag), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def capped(asked: int | None, most: int) -> int:
    """A limit between 1 and what is allowed."""
    return max(1, min(most if asked is None else asked, most))


def matching_first(df: DataFrame, column: str, needle: str, order: list[str], n: int) -> DataFrame:
    """The first n rows, those that contain the needle before all others, with their place. The n are found by partial top-n before they are numbered."""
    best = df.withColumn("__hit", F.col(column).ilike(f"%{needle}%")).orderBy(F.desc("__hit"), *order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__hit"), *order)).cast("long")).drop("__hit")


def next_version(names: DataFrame, versions: DataFrame, name: str, version: str) -> DataFrame:
    """name, next_version: one more than the greatest there is."""
    return names.join(versions.groupBy(name).agg(F.max(version).alias("__v")), name, "left").select(name, (F.coalesce("__v", F.lit(0)) + 1).alias("next_version"))


def children(parents: DataFrame, rows: DataFrame, parent: str, child: str, id_col: str = "id") -> DataFrame:
    """Parents with an array of their children, in order; an empty one if they have none."""
    lists = rows.groupBy(F.col(parent).alias("__p")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    out = parents.join(lists, F.col(id_col) == F.col("__p"), "left").drop("__p")
    return out.withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def join_dealt(rows: DataFrame, few: DataFrame, key: str | list[str], spread: str, deals: int = 64) -> DataFrame:
    """`rows` joined with `few`, which has each key once: what a key has in `rows` is dealt over parts by `spread`, and a part exists only where it has rows, so a hot key isn't one task."""
    key = [key] if isinstance(key, str) else key
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64(spread), F.lit(deals)).cast("int"))
    return rows.join(few.join(rows.select(*key, "__deal").distinct(), key), [*key, "__deal"]).drop("__deal")


def append_distinct(rows: DataFrame, additions: DataFrame, key: str, column: str) -> DataFrame:
    """`rows` with the values of `additions` (key, n, value) at the end of the array `column`, in the order of n; what is in it already, or comes again, is left out. A null array is empty."""
    new = additions.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("__new"))
    out = rows.join(new, F.col(key) == F.col("__key"), "left")
    kind = rows.schema[column].dataType
    had = F.coalesce(column, F.array().cast(kind))
    every = F.concat(had, F.coalesce(F.transform("__new", lambda x: x["value"]), F.array().cast(kind)))
    # What was there stays as it was, also what it had twice.
    grown = F.concat(had, F.array_except(F.array_distinct(every), had))
    return out.withColumn(column, F.when(F.col("__new").isNull(), F.col(column)).otherwise(grown)).drop("__key", "__new")
