"""Links between documents whose sets of shingles are similar: met by keys, held against small prints, decided on full sets.

A form is a set of shingles that stands for all documents that have it: set_key, owner, n (its size), keys (documents that are similar are likely to share one
at a place; keys of two places differ), prints (a few words whose differing bits tell how similar two sets can be). Forms are linked in two steps.

1. Each form meets the least owner's form of each of its keys, so k holders of a key give k meetings. Sizes and prints rule most out; full
sets decide about the nearest of those that are left. What that connects is a class. Then each form meets the one of another class whose prints are nearest, for each of its keys.
2. Holders of a key that still are of different classes meet in pairs, in groups of bounded size: a key's holders are dealt over
blocks, and each pair of blocks is a group. A pair is looked at where it first shares a key, only if it is of two classes and its prints are near; rows without such a
pair go before any full set travels. Within a group the nearest pairs come first, and what they link needn't be looked at again. Groups give links, never pairs.

Together that connects exactly what the pairs of the similarity connect that share a key and whose prints are near.
Full sets are 64-bit hashes; texts are read again for them, and don't travel: a bitmap of those that are wanted is broadcast. Sets are larger than packed texts, so pairs and groups are
decided in up to `PARTS` parts, and a share of the sets is on disk at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.operators.graph import star_roots
from palimpsest.operators.relational import join_dealt
from palimpsest.runtime import cut, remove, shared_path, written

#: Holders of a key, and shingles of their sets together, up to which they are one block.
BLOCK = 1024
BLOCK_SHINGLES = 2 << 20
#: Full sets of more bytes than this are made and decided in several parts, one after the other, and in so many at most: each part reads the texts again.
PART_BYTES = 128 << 20
PARTS = 4
#: Bits of a bitmap of what is wanted, for each hash and at most (16 MB). Beyond some ten millions of hashes it rules out less and less, and work is done in vain, but nothing is lost.
PLACES_EACH = 32
MOST_PLACES = 1 << 27
GROUP = ["slot", "key", "a", "b"]

#: Pairs of places (i, j) from sorted group numbers and the prints of rows.
Propose = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def shingle_hashes(column: pa.Array, words_of_shingle: int):
    """Rows [a, b), all shingle hashes of these texts, and where each text's begin and end."""
    for a, b, data, offsets in K.text_blocks(column):
        data = K.LOWER[data]
        starts, ends, first = K.spans(data, offsets, K.PLAIN)
        yield a, b, *K.shingles(K.span_hashes(data, starts, ends), first, words_of_shingle)


def sets_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's distinct hashes, where they begin and end, and a hash of each set."""
    own = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in own], np.uint64)
    return own, np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), keys


def full_sets(texts: DataFrame, wanted: DataFrame, words_of_shingle: int) -> DataFrame:
    """set_key and shingles of the wanted sets (place, set_key), made anew from the texts (place, text) in a narrow pass: bitmaps of places and sets tell what to hash and what to give.

    What they take for wanted comes along, and a set that several texts of a place have comes once from each task: joins and links are the same with both."""
    known = texts.sparkSession.sparkContext.broadcast(tuple(bitmaps(wanted.select("place", "set_key"))))
    given: set[int] = set()  # by this task

    def run(batch: pa.RecordBatch):
        places, marks = known.value
        here = in_bitmap(batch.column(0).to_numpy(), places)
        for _, _, hashes, bounds in shingle_hashes(batch.column(1).take(pa.array(here)), words_of_shingle):
            own, _, keys = sets_of(hashes, bounds)
            keys = keys.view(np.int64)
            new = [k for k in in_bitmap(keys, marks).tolist() if int(keys[k]) not in given and not given.add(int(keys[k]))]
            made = [own[k].view(np.int64) for k in new]
            yield [pa.array(keys[new], pa.int64()), K.lists(K.concat_rows(made), np.concatenate([[0], np.cumsum([len(x) for x in made])]), pa.int64())]

    return K.map_arrow(texts.select("place", "text"), run, K.schema(set_key="bigint", shingles="array<bigint>"))


def parts_of(shingles: int) -> int:
    """In how many parts sets with so many shingles together are decided."""
    return min(PARTS, max(1, -(-8 * shingles // PART_BYTES)))


def bitmaps(hashes: DataFrame) -> list[np.ndarray]:
    """For each column (longs) a bit for each of its hashes modulo the number of bits, which has a bound however many they are. Two jobs for all columns."""
    bits = 1 << 16
    n = hashes.count()
    while bits < min(PLACES_EACH * n, MOST_PLACES):
        bits <<= 1
    each = hashes.select(F.posexplode(F.array(*hashes.columns)).alias("column", "h"))
    words = each.groupBy("column", F.shiftright(F.pmod("h", F.lit(bits)), 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")).alias("bits")).toArrow()
    out = np.zeros((len(hashes.columns), bits // 64), np.uint64)
    out[words["column"].to_numpy(), words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return list(out)


def in_bitmap(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    at = np.mod(hashes, len(marks) * 64)
    return np.flatnonzero((marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))


def keyed(forms: DataFrame, shared: DataFrame) -> DataFrame:
    """set_key, slot, key: the keys of each form that several forms have. Of the others a bitmap of the shared ones (broadcast) rules most out before anything travels; what it took for shared is ruled out by joins later."""
    known = forms.sparkSession.sparkContext.broadcast(bitmaps(shared.select("key"))[0])

    def run(batch: pa.RecordBatch):
        lists = batch.column(1)
        keys, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        slot = np.arange(len(keys)) - (ends[:-1] - ends[0])[owner]
        here = in_bitmap(keys, known.value)
        yield [batch.column(0).take(pa.array(owner[here])), pa.array(slot[here].astype(np.int32)), pa.array(keys[here])]

    return K.map_arrow(forms.select("set_key", "keys"), run, K.schema(set_key="bigint", slot="int", key="bigint"))


def meetings(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """u, v (set keys): each holder of a shared key and the one of its least owner."""
    met = join_dealt(rows.select(F.col("set_key").alias("u"), "key"), shared.select("key", F.col("low.set_key").alias("v")), "key", "u")
    return met.select("u", "v").where("u <> v").distinct()


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def is_similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    # Sizes alone rule most others out.
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def similar_rows(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those u, v of `pairs` whose full sets are similar."""
    one = pairs.join(sets.select(F.col("set_key").alias("u"), F.col("shingles").alias("u_shingles")), "u")
    both = join_dealt(one, sets.select(F.col("set_key").alias("v"), F.col("shingles").alias("v_shingles")), "v", "u")

    def run(batch: pa.RecordBatch):
        a, b = batch.column(2), batch.column(3)
        good = [is_similar(a[k].values.to_numpy(zero_copy_only=False), b[k].values.to_numpy(zero_copy_only=False), percent) for k in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_())).columns

    return K.map_arrow(both.select("u", "v", "u_shingles", "v_shingles"), run, K.schema(u="bigint", v="bigint"))


# Pairs within groups ----------------------------------------------------------------------------------------------


def all_pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of equal numbers, by rising distance, so that what stands beside the rows is of their size."""
    live = np.arange(len(group))
    lag = 0
    while len(live):
        lag += 1
        live = live[live + lag < len(group)]
        live = live[group[live] == group[live + lag]]
        if len(live):
            yield live, live + lag


def _number_groups(rows: pa.Table) -> np.ndarray:
    columns = [rows[c].to_numpy() for c in GROUP]
    new = np.any([np.diff(c) != 0 for c in columns], axis=0) if len(rows) > 1 else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(new)])


def _ints(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.view(dtype).reshape(len(column), -1)


def _candidates(rows: pa.Table, propose: Propose, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Proposed pairs of two classes (and blocks, where two meet) whose sizes fit and that share no key at an earlier place."""
    group, prints, tags = _number_groups(rows), _ints(rows["prints"], np.uint64), _ints(rows["tags"], np.int32)
    kind, n, mine, slot = (rows[c].to_numpy() for c in ("class", "n", "mine", "slot"))
    across = rows["a"].to_numpy() != rows["b"].to_numpy()
    for i, j in propose(group, prints):
        ok = (kind[i] != kind[j]) & (~across[i] | (mine[i] != mine[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        if len(i):
            first = (tags[i] == tags[j]).argmax(axis=1) == slot[i]
            yield i[first], j[first]


def _active(rows: pa.Table, propose: Propose, percent: int) -> pa.Table:
    hit = np.zeros(len(rows), bool)
    for i, j in _candidates(rows, propose, percent):
        hit[i] = hit[j] = True
    return rows.filter(pa.array(hit))


def _nearest(rows: pa.Table, propose: Propose, percent: int) -> pa.Table:
    """u, v: for each row of a pair that is of the smaller class of the two in its group, the nearest partner of another class. One row each at most."""
    prints, keys = _ints(rows["prints"], np.uint64), rows["set_key"].to_numpy()
    _, of, size = np.unique(np.stack([_number_groups(rows), rows["class"].to_numpy()]), axis=1, return_inverse=True, return_counts=True)
    weight = size[of.ravel()]
    best = np.full(len(rows), 64 * prints.shape[1] + 1)
    partner = np.full(len(rows), -1)
    for i, j in _candidates(rows, propose, percent):
        swap = weight[i] > weight[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        far = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1).astype(np.int64)
        order = np.argsort(-far, kind="stable")  # of several the nearest is written last
        i, j, far = i[order], j[order], far[order]
        better = far < best[i]
        best[i[better]], partner[i[better]] = far[better], j[better]
    has = np.flatnonzero(partner >= 0)
    return pa.table({"u": pa.array(keys[has], pa.int64()), "v": pa.array(keys[partner[has]], pa.int64())})


def _links(rows: pa.Table, propose: Propose, percent: int) -> pa.Table:
    """What the full sets of candidates link, the nearest first: a tree for each that becomes one."""
    pairs = list(_candidates(rows, propose, percent))
    i, j = (K.concat_rows([p[k] for p in pairs]) for k in (0, 1))
    prints = _ints(rows["prints"], np.uint64)
    far = np.zeros(len(i), np.int64)
    for k in range(prints.shape[1]):
        far += np.bitwise_count(prints[i, k] ^ prints[j, k])
    order = np.argsort(far, kind="stable")
    # Classes that meet in one group only by rows of it: a link in another group needn't be known here.
    _, at = np.unique(np.stack([_number_groups(rows), rows["class"].to_numpy()]), axis=1, return_inverse=True)
    root = list(range(len(rows)))
    keys = rows["set_key"].to_numpy()
    lists = rows["shingles"].combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    u, v = [], []
    at = at.ravel()
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x0, y0 = find(int(at[x])), find(int(at[y]))
        if x0 != y0 and is_similar(flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]], percent):
            root[max(x0, y0)] = min(x0, y0)
            u.append(keys[x])
            v.append(keys[y])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def by_groups(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], out, held_rows: int = 20_000, held_bytes: int = 32 << 20) -> DataFrame:
    """What `fn` makes of whole groups, many small ones at once."""
    rows = K.bounded_batches(rows).repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and (sum(b.num_rows for b in held) >= held_rows or sum(b.nbytes for b in held) >= held_bytes):
                # A group is whole when another follows.
                last = [held[-1].column(c)[-1].as_py() for c in GROUP]
                new = np.flatnonzero(np.any([batch.column(c).to_numpy() != x for c, x in zip(GROUP, last, strict=True)], axis=0))
                if len(new):
                    held.append(batch.slice(0, int(new[0])))
                    yield from fn(pa.Table.from_batches(held)).combine_chunks().to_batches()
                    held, batch = [], batch.slice(int(new[0]))
            held.append(batch)
        if held:
            yield from fn(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return rows.mapInArrow(run, out)


def mixed_groups(named: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """Holders of keys that forms of several classes have, in groups: GROUP, mine (a row's own block), and what is known of the form. named: set_key, n, class, keys, prints; rows: set_key, slot, key."""
    held = join_dealt(rows, named.select("set_key", "n", "class"), "set_key", "key")
    mixed = held.groupBy("slot", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("m"), F.sum("n").alias("shingles")).where("low <> high")
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = join_dealt(rows, cut(mixed.select("slot", "key", blocks.alias("blocks"))), ["slot", "key"], "set_key")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tags = named.select("set_key", "class", "n", "prints", F.transform("keys", lambda x: F.shiftright(x, 32).cast("int")).alias("tags"))
    out = dealt.select("slot", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "set_key").join(tags, "set_key")
    return out.select(*GROUP, "mine", "set_key", "class", F.col("n").cast("long").alias("n"), "prints", "tags")


def similar_links(forms: DataFrame, full: Callable[[DataFrame], DataFrame], percent: int, near: Callable[[Column, Column], Column], propose: Propose, block: int = BLOCK) -> DataFrame:
    """u, v: links of set keys that connect what is similar. `full` gives the full sets (set_key, shingles) of the asked set keys; `near` says of two prints whether their sets can be similar, and `propose` which pairs of a group are."""
    keys = forms.select("owner", "set_key", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min(F.struct("owner", "set_key")).alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low"))
    rows = cut(keyed(forms, shared))
    some = rows.select("set_key").distinct()
    # Forms that share no key are never looked at again.
    forms = cut(forms.select("set_key", "n", "keys", "prints").join(some, "set_key", "left_semi"))
    link = K.schema(u="bigint", v="bigint")

    def named(roots: DataFrame) -> DataFrame:
        return forms.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "n", "keys", "prints", F.coalesce("root", "set_key").alias("class"))

    brief = lambda c: forms.select(F.col("set_key").alias(c), F.col("prints").alias(f"{c}_prints"), F.col("n").alias(f"{c}_n"))
    met = join_dealt(meetings(rows, shared).join(brief("u"), "u"), brief("v"), "v", "u")
    met = met.where(sizes_fit(F.col("u_n"), F.col("v_n"), percent) & near(F.col("u_prints"), F.col("v_prints")))
    # Of the forms that it meets each is held against the nearest: what another one would have linked too comes up below, if it is still apart by then.
    far = F.aggregate(F.zip_with("u_prints", "v_prints", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    met = cut(met.groupBy("u").agg(F.min(F.struct(far.alias("far"), "v")).alias("best")).select("u", F.col("best.v").alias("v")))
    spark = forms.sparkSession
    base = shared_path(spark, "sets")

    def in_parts(rows: DataFrame, by: list[str], shingles: int, keys: Column, judge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """What `judge` makes of the rows and the full sets of their `keys`, part by part. A part's sets are a table that goes when it is judged."""
        n, out = parts_of(shingles), []
        for k in range(n):
            part = rows.where(F.pmod(F.xxhash64(*by, F.lit("part")), F.lit(n)) == k)
            sets = written(full(part.select(F.explode(keys).alias("set_key")).distinct()), base)
            out.append(cut(judge(part, sets)))
            remove(spark, base)
        return functools.reduce(DataFrame.unionByName, out)

    def decided(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar. Dealt by u, so what many have as their v is in each part and else nothing is in two."""
        asked = F.array("u", "v")
        shingles = pairs.select(F.explode(asked).alias("set_key")).distinct().join(forms.select("set_key", "n"), "set_key").agg(F.sum("n")).first()[0] or 0
        return in_parts(pairs, ["u"], shingles, asked, lambda part, sets: similar_rows(part, sets, percent))

    edges = decided(met)
    roots = star_roots(edges)

    # One more meeting by nearness: most of a large group that the least owner's form doesn't tie together is by then.
    groups = mixed_groups(named(roots), rows, block)
    tries = cut(by_groups(groups, lambda t: _nearest(t, propose, percent), link).distinct())
    if tries.isEmpty():
        return edges
    edges = cut(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(decided(tries)))
    roots = star_roots(edges)

    groups = mixed_groups(named(roots), rows, block)
    active = cut(by_groups(groups, lambda t: _active(t, propose, percent), groups.schema))
    if active.isEmpty():
        return edges
    judge = lambda part, sets: by_groups(part.join(sets, "set_key").select(*groups.columns, "shingles"), lambda t: _links(t, propose, percent), link)
    return edges.unionByName(in_parts(active, GROUP, active.agg(F.sum("n")).first()[0], F.array("set_key"), judge))
