"""Near-duplicates by b-bit MinHash.

A document's set of 3-word shingles has BANDS * ROWS minima. ROWS whole minima at a time make a band's key, by which documents become candidates; of
each minimum only the LOW_BITS low bits are kept beside it, packed into a few words (192 minima of 2 bits: 48 bytes). Two unequal minima agree in their low bits
by chance in a share C = 2 ** -LOW_BITS, so of the share P of agreeing ones the similarity is estimated as (P - C) / (1 - C), counted by bits of the packed words. A candidate is dropped
where the estimate is far below the similarity, and all others are decided on their full sets.

At a similarity of 0.85 a pair shares a band with probability 1 - (1 - 0.85 ** 6) ** 32, that is all but 3 in 10 millions; the estimate has a standard deviation of 0.03,
and a pair is dropped by it beyond SLACK = 5.2 of them, 1 in 10 millions. Both are less for pairs that are more similar.
Documents of one set (copies) are one until the end, and candidates within a band are never emitted as pairs (set_links).

Defined results: null and empty texts have no shingle, are linked with nothing and are components of their own; a text of one or two words has one shingle; repeated rows are copies, and
each of them is returned; a null id takes no part in the least id (null if no other is there) and is kept if that is null; very long texts are one set, hashed in pieces; an
empty table gives no rows; only id and text are read. Sets are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.llm import set_links as S
from palimpsest.operators.graph import star_roots
from palimpsest.operators.relational import join_dealt
from palimpsest.runtime import brief_shuffles, cut, planned_once

WORDS = 3
PERCENT = 85
BANDS = 32
ROWS = 6
LOW_BITS = 2
SLACK = 5.2
#: Hashes of a run of which all minima are taken before the next.
RUN = 1 << 15

_MULTIPLIERS = K.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_LANES = 0x5555555555555555


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hashes of each run (none of them empty), in pieces that stay in a CPU's cache."""
    cuts = np.unique(np.concatenate([bounds, np.arange(0, len(hashes), RUN)]))
    starts, owner = cuts[:-1], np.searchsorted(bounds, cuts[:-1], "right") - 1
    out = np.full((len(bounds) - 1, len(_MULTIPLIERS)), ~np.uint64(0))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + RUN)))
        x, y = starts[a], cuts[b]
        part, at = hashes[x:y], starts[a:b] - x
        first = np.flatnonzero(np.concatenate([[True], np.diff(owner[a:b]) != 0]))
        mine = owner[a:b][first]
        for k, m in enumerate(_MULTIPLIERS):
            # Products of well-mixed hashes with an odd number are as good as mixed anew.
            least = np.minimum.reduceat(np.minimum.reduceat(part * m, at), first)
            out[mine, k] = np.minimum(out[mine, k], least)
        a = b
    return out


def signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of bands from whole minima, and the low bits of all of them, 32 minima a word."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))
    for k in range(BANDS * ROWS):
        keys[:, k // ROWS] = K.mix(keys[:, k // ROWS] + K.mix(least[:, k]))
    per_word = 64 // LOW_BITS
    packed = np.zeros((len(least), BANDS * ROWS // per_word), np.uint64)
    for k in range(BANDS * ROWS):
        packed[:, k // per_word] |= (K.mix(least[:, k]) & np.uint64((1 << LOW_BITS) - 1)) << np.uint64(LOW_BITS * (k % per_word))
    return keys, packed


def sketches(docs: DataFrame, id_col: str, text_col: str, words_of_shingle: int = WORDS) -> DataFrame:
    """__id, set_key, n, keys, prints: one narrow pass. Texts without a shingle have no keys."""
    out = K.schema(__id=docs.schema[id_col].dataType.simpleString(), set_key="bigint", n="bigint", keys="array<bigint>", prints="array<bigint>")

    def run(batch: pa.RecordBatch):
        for a, b, hashes, bounds in S.shingle_hashes(batch.column(1), words_of_shingle):
            own, ends, set_keys = S.sets_of(hashes, bounds)
            full = np.flatnonzero(np.diff(ends))
            keys, packed = signature(minima(K.concat_rows(own, np.uint64), np.append(ends[:-1][full], ends[-1]))) if len(full) else (np.zeros((0, BANDS), np.uint64), np.zeros((0, 1), np.uint64))
            has = (np.diff(ends) > 0).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(has)])
            yield [
                batch.column(0).slice(a, b - a),
                pa.array(set_keys.view(np.int64)),
                pa.array(np.diff(ends)),
                K.lists(keys.ravel().view(np.int64), offsets * BANDS, pa.int64()),
                K.lists(packed.ravel().view(np.int64), offsets * packed.shape[1], pa.int64()),
            ]

    return K.map_arrow(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), run, out)


def most_unlike(percent: int = PERCENT) -> int:
    """Of BANDS * ROWS minima so many may differ in their low bits: the collision-corrected estimate is SLACK standard deviations below the similarity then."""
    k, c = BANDS * ROWS, 2.0**-LOW_BITS
    agree = c + (1 - c) * percent / 100
    return math.floor(k * (1 - agree + SLACK * math.sqrt(agree * (1 - agree) / k)))


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of rows of packed words differ in their low bits."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LANES)).astype(np.int64).sum(axis=1)


def estimate(n_unlike: int) -> float:
    """The similarity that so many unlike minima tell, corrected for chance agreement."""
    c = 2.0**-LOW_BITS
    return (1 - n_unlike / (BANDS * ROWS) - c) / (1 - c)


def near_prints(most: int):
    def near(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k in range(BANDS * ROWS * LOW_BITS // 64):
            x = F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))
            out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LANES)))
        return out <= most

    return near


def proposer(most: int) -> S.Propose:
    def propose(group: np.ndarray, prints: np.ndarray):
        for i, j in S.all_pairs(group):
            ok = unlike(prints[i], prints[j]) <= most
            if ok.any():
                yield i[ok], j[ok]

    return propose


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of_shingle: int = WORDS, percent: int = PERCENT, block: int = S.BLOCK) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per document; linked are documents of at least `percent` hundredths of their shingles in common."""
    with brief_shuffles(docs.sparkSession):
        rows = cut(sketches(docs, id_col, text_col, words_of_shingle))
        # Copies have equal keys and prints: any will do.
        forms = cut(rows.where("n > 0").groupBy("set_key").agg(F.min("__id").alias("owner"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("prints").alias("prints")))
        n, shingles = forms.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        with planned_once(docs.sparkSession, n, 8 * shingles) as parts:
            if parts == 1:  # no join or group of these exchanges anything
                forms = cut(forms.coalesce(1))
            texts = docs.select(F.xxhash64(id_col).alias("place"), F.col(text_col).alias("text"))
            heads = forms.select("set_key", F.xxhash64("owner").alias("place"))
            full = lambda asked: S.full_sets(texts, cut(asked.join(heads, "set_key")), words_of_shingle)
            most = most_unlike(percent)
            roots = star_roots(S.similar_links(forms, full, percent, near_prints(most), proposer(most), block))
    # Of a component the least id (nulls take no part) comes to all its sets, and from these to all documents.
    classes = forms.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", F.col("owner").alias("id"), F.coalesce("root", "set_key").alias("root"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = join_dealt(classes.select("set_key", "root"), least, "root", "set_key").select("set_key", "component_id")
    # Only copies need the join by set; a set that one document has is one row, and a hot one is dealt by id.
    linked = join_dealt(rows.where("n > 0").select("__id", "set_key", "n"), classes, "set_key", "__id").select("__id", "n", "component_id")
    out = linked.unionByName(rows.where("n = 0").select("__id", "n", F.col("__id").alias("component_id")))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
