"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most 3 of 64 bits agree in one of 4 blocks of 16 bits at least. So there are four
tries, each with another block rotated to the front, and each is cut below its 16-bit roots: a subtree is a group of
fingerprints that agree in one block, and groups are dealt over tasks. Within a group pairs of trie nodes are
traversed together from the root downwards, level by level: a node paired with itself gives its children with
themselves and with each other, a pair of nodes gives four pairs of children, the differing bits are summed on
the way, and a pair beyond the error budget is pruned with all below it. A node is a range of the sorted fingerprints,
so all groups of a task are traversed at once.

A group above `split_above` fingerprints is cut further, by pairs of its nodes 4 levels down that are within the budget, and so on until each fits.
A task emits no pairs, but for each fingerprint the least one it is linked to in its group: at most one link for each
fingerprint and trie. Components of these links come from alternating large-star and small-star rounds.

Exact copies have one fingerprint, so all of this runs on distinct fingerprints; copies meet it again by one join.

Defined results: null and empty texts (no words) have fingerprint 0, which links as any other; repeated rows share a
component; a null id takes no part in the least id (null if no other is there); an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.operators.graph import star_roots
from palimpsest.operators.relational import join_dealt
from palimpsest.runtime import cut

SEED = 42
BITS = 64
BLOCKS = 4
BUDGET = 3
SPLIT_ABOVE = 200_000
SUB_BITS = 4
CHUNK = 1 << 17
SHINGLES = 1 << 16


def shingle_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, n: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of n words of raw, joined by spaces, in arrays of at most SHINGLES; of the whole if there are fewer words; nothing of nothing."""
    digest = xxhash.xxh64_intdigest
    if 0 < len(starts) <= n:
        yield np.array([digest(b" ".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), seed)], np.uint64)
        return
    for k in range(0, len(starts) - n + 1, SHINGLES):
        own = slice(k, k + SHINGLES + n - 1)
        sizes = ends[own] - starts[own] + 1
        line = b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
        stops = np.cumsum(sizes)
        heads = (stops - sizes)[: len(sizes) - n + 1].tolist()
        yield np.array([digest(line[x:y], seed) for x, y in zip(heads, (stops[n - 1 :] - 1).tolist(), strict=True)], np.uint64)


_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per run of hashes the word whose bits are set in over half of them; 0 for an empty run.

    Eight counters of a byte each share a word; runs are summed in pieces of 255 at most, so no counter overflows."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = offsets[:-1][full][owner] + 255 * (np.arange(len(owner)) - first[owner])
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        totals = np.add.reduceat(counts, first, axis=0)
        for byte in range(8):  # little-endian: byte b of the word holds bits 8b..8b+7
            out[full] |= (2 * totals[:, byte] > n[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of_shingle: int = 3, seed: int = SEED, rest: list[str] | None = None) -> DataFrame:
    """id, fingerprint (as a signed long), and the columns of `rest`; one narrow pass."""
    rest = rest or []
    out = K.schema(**{id_col: docs.schema[id_col].dataType.simpleString(), "fingerprint": "bigint"})
    for c in rest:
        out.add(docs.schema[c])

    def run(batch: pa.RecordBatch):
        for a, b, data, offsets in K.text_blocks(batch.column(1)):
            data = K.LOWER[data]
            starts, ends, first = K.spans(data, offsets, K.PLAIN)
            raw = data.tobytes()
            hashes: list[np.ndarray] = []
            bounds = [0]
            for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                mine = list(shingle_hashes(raw, starts[x:y], ends[x:y], words_of_shingle, seed))
                hashes += mine
                bounds.append(bounds[-1] + sum(map(len, mine)))
            made = majority_bits(K.concat_rows(hashes, np.uint64), np.array(bounds))
            yield [batch.column(0).slice(a, b - a), pa.array(made.view(np.int64), pa.int64()), *(batch.column(2 + k).slice(a, b - a) for k in range(len(rest)))]

    return K.map_arrow(docs.select(id_col, text_col, *rest), run, out)


# Links -------------------------------------------------------------------------------------------------------------


def rotated(fp: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Fingerprints with the given block of 16 bits in front."""
    width = np.uint64(BITS // BLOCKS)
    left = block.astype(np.uint64) * width
    return np.where(block == 0, fp, (fp << left) | (fp >> ((np.uint64(BITS) - left) % np.uint64(BITS))))


def trie_pairs(keys: np.ndarray, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, differ: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in sorted distinct `keys` within `budget` bits, from pairs of nodes (ranges) at `depth`.

    A node paired with itself has lo1 == lo2. Levels with too many pairs are taken in chunks, depth first."""
    stack = [(lo1, hi1, lo2, hi2, differ, depth)]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        lo1, hi1, lo2, hi2, differ, depth = stack.pop()
        if len(lo1) > CHUNK:
            half = len(lo1) // 2
            stack += [tuple(x[cut_] for x in (lo1, hi1, lo2, hi2, differ)) + (depth,) for cut_ in (slice(half, None), slice(None, half))]
            continue
        n1, n2 = hi1 - lo1, hi2 - lo2
        leaf = (n1 == 1) & (n2 == 1)
        pair = leaf & (lo1 != lo2)
        if pair.any():
            a, b = lo1[pair], lo2[pair]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
            if near.any():
                yield a[near], b[near]
        go = ~leaf
        if depth >= BITS or not go.any():
            continue
        lo1, hi1, lo2, hi2, differ = (x[go] for x in (lo1, hi1, lo2, hi2, differ))
        if depth not in zeros:
            zeros[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)])
        z = zeros[depth]
        mid1, mid2 = lo1 + z[hi1] - z[lo1], lo2 + z[hi2] - z[lo2]
        own = lo1 == lo2
        other = ~own
        parts = [
            (lo1, mid1, lo2, mid2, differ),
            (mid1, hi1, mid2, hi2, differ),
            (lo1, mid1, mid2, hi2, differ + 1),
            tuple(x[other] for x in (mid1, hi1, lo2, mid2, differ + 1)),
        ]
        lo1, hi1, lo2, hi2, differ = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (hi1 > lo1) & (hi2 > lo2) & (differ <= budget) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        if keep.any():
            stack.append((lo1[keep], hi1[keep], lo2[keep], hi2[keep], differ[keep], depth + 1))


def stars(keys: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each key the place of the least key that the pairs connect it with."""
    root = np.arange(len(keys))
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while not (root[root] == root).all():
                root = root[root]
    return root


def _links_in(rows: list[pa.RecordBatch], budget: int) -> pa.RecordBatch | None:
    """Links (fingerprint, least linked one) in whole groups: columns block, value, depth, a, b, fp. A group is the pair of nodes a and b that lie `depth` bits below a root."""
    block, _, depth, a, b, fp = (np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in rows]) for k in range(6))
    keys = rotated(fp.view(np.uint64), block)
    root16 = (keys >> np.uint64(48)).astype(np.int64)
    order = np.lexsort((keys, b, a, depth, root16, block))
    block, depth, a, b, root16, keys, fp = (x[order] for x in (block, depth, a, b, root16, keys, fp))
    group = np.flatnonzero(np.concatenate([[True], np.any([np.diff(x) != 0 for x in (block, root16, depth, a, b)], axis=0)]))
    ends = np.append(group[1:], len(keys))
    # Sorted within each group, which is all that node ranges need; the first rows of a pair of two nodes are those of a.
    pairs = []
    for d in np.unique(depth).tolist():
        lo, hi = (x[depth[group] == d] for x in (group, ends))
        own = (keys >> np.uint64(48 - d)).astype(np.int64) & ((1 << d) - 1)
        mine = np.concatenate([[0], np.cumsum(own == a)])
        same = a[lo] == b[lo]
        mid = np.where(same, hi, lo + mine[hi] - mine[lo])
        lo2 = np.where(same, lo, mid)
        good = (mid > lo) & (hi > lo2) & ~(same & (hi - lo == 1))
        differ = np.bitwise_count((a[lo] ^ b[lo]).astype(np.uint64)).astype(np.int64)
        pairs.append(trie_pairs(keys, lo[good], mid[good], lo2[good], hi[good], differ[good], BITS // BLOCKS + d, budget))
    root = stars(keys, (p for one in pairs for p in one))
    linked = np.flatnonzero(root != np.arange(len(keys)))
    if not len(linked):
        return None
    return pa.RecordBatch.from_arrays([pa.array(fp[linked], pa.int64()), pa.array(fp[root[linked]], pa.int64())], ["u", "v"])


def links(distinct: DataFrame, column: str = "fingerprint", budget: int = BUDGET, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links u, v that connect exactly what pairs within the budget connect. `distinct` has no fingerprint twice."""
    if budget >= BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find pairs of up to {BLOCKS - 1} bits")
    width = BITS // BLOCKS
    fp = F.col("fp")
    tries = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("block"), (fp if k == 0 else F.shiftleft(fp, width * k).bitwiseOR(F.shiftrightunsigned(fp, BITS - width * k))).alias("key")) for k in range(BLOCKS)]))
    zero = F.lit(0).cast("long")
    rows = distinct.select(F.col(column).alias("fp")).select("fp", tries.alias("t")).select("t.block", F.shiftrightunsigned("t.key", BITS - width).alias("value"), zero.alias("depth"), zero.alias("a"), zero.alias("b"), "fp", "t.key")
    group = ["block", "value", "depth", "a", "b"]
    fitting = []
    for depth in range(0, BITS - width, SUB_BITS):
        large = cut(rows.groupBy(*group).count().where(F.col("count") > split_above).select(*group))
        if large.isEmpty():
            break
        fitting.append(rows.join(large, group, "left_anti"))
        # One level of SUB_BITS bits down: a row meets, for its own node there, all nodes of the other side that are within the budget.
        below = lambda d: F.shiftrightunsigned("key", BITS - width - d).bitwiseAND(F.lit((1 << d) - 1).cast("long"))
        mine = below(depth + SUB_BITS)
        first = below(depth) == F.col("a")
        across = F.when(first, F.col("b")).otherwise(F.col("a"))
        children = F.transform(F.sequence(zero, F.lit((1 << SUB_BITS) - 1).cast("long")), lambda s: F.shiftleft(across, SUB_BITS).bitwiseOR(s))
        near = F.filter(children, lambda s: F.bit_count(s.bitwiseXOR(F.col("mine"))) <= budget)
        pair = F.transform(near, lambda s: F.struct(F.when(F.col("a") == F.col("b"), F.least(s, "mine")).when(first, F.col("mine")).otherwise(s).alias("a"), F.when(F.col("a") == F.col("b"), F.greatest(s, "mine")).when(first, s).otherwise(F.col("mine")).alias("b")))
        down = rows.join(large, group, "left_semi").withColumn("mine", mine).withColumn("o", F.explode(pair))
        rows = cut(down.select("block", "value", F.lit(depth + SUB_BITS).cast("long").alias("depth"), "o.a", "o.b", "fp", "key"))
    for part in fitting:
        rows = rows.unionByName(part)
    rows = K.bounded_batches(rows.select(*group, "fp")).repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups are whole when another follows: hold rows back from the last group's start.
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n > split_above:
                key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
                last = np.array([[held[-1].column(k)[-1].as_py()] for k in range(5)])
                new = np.flatnonzero((key != last).any(axis=0))
                if len(new):
                    if new[0]:
                        held.append(batch.slice(0, int(new[0])))
                    if (made := _links_in(held, budget)) is not None:
                        yield made
                    held, n, batch = [], 0, batch.slice(int(new[0]))
            held.append(batch)
            n += batch.num_rows
        if held and (made := _links_in(held, budget)) is not None:
            yield made

    return rows.mapInArrow(run, K.schema(u="bigint", v="bigint"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words_of_shingle: int, seed: int, budget: int, split_above: int, rest: list[str]) -> DataFrame:
    """id, fingerprint (long), root (the component's fingerprint), component_id and `rest`, by row."""
    prints = cut(fingerprints(docs, id_col, text_col, words_of_shingle, seed, rest))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least_id")))
    roots = star_roots(links(distinct, budget=budget, split_above=split_above))
    named = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = join_dealt(named.select("fingerprint", "root"), least, "root", "fingerprint")
    # All copies of a text, and all empty ones, have one fingerprint.
    return join_dealt(prints, named.select("fingerprint", "root", "component_id"), "fingerprint", id_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of_shingle: int = 3, seed: int = SEED, budget: int = BUDGET, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """id, fingerprint (hex), component_id: one row per document."""
    rows = _classes(docs, id_col, text_col, words_of_shingle, seed, budget, split_above, [])
    return rows.select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep(docs: DataFrame, mark: str, id_col: str, judged: DataFrame) -> DataFrame:
    """Rows of the marked `docs` that stay, without the mark. `judged`: __id, __head (a row's mark), stays, and n, how many rows are alike in all columns: of these one stays.

    Only the rows that go are joined by id, and only repeats that stay are brought together."""
    id_, mark_ = K.fresh(docs.columns, "__judged_id", "__judged_mark")
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(mark_))
    named = lambda rows: rows.select(F.col("__id").alias(id_), F.col("__head").alias(mark_))
    alike = named(judged.where("stays and n > 1"))
    kept = docs.join(named(judged.where("not stays or n > 1")), same, "left_anti")
    if not alike.isEmpty():
        kept = kept.unionByName(docs.join(alike, same, "left_semi").dropDuplicates([id_col, mark]))
    return kept.drop(mark)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of_shingle: int = 3, seed: int = SEED, budget: int = BUDGET, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """`docs` with one document of each component: that with the least id (nulls last), of several rows with that id the one with
    the least hash of its columns. Its columns and only these."""
    rows_, mark = K.marked(docs)
    rows = _classes(rows_, id_col, text_col, words_of_shingle, seed, budget, split_above, [mark])
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(mark).alias("mark"))
    heads = rows.groupBy("root").agg(F.min(row).alias("stays"))
    judged = rows.join(heads, "root").select(F.col(id_col).alias("__id"), F.col(mark).alias("__head"), row.eqNullSafe(F.col("stays")).alias("stays"))
    return keep(rows_, mark, id_col, cut(judged.groupBy("__id", "__head").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))))
