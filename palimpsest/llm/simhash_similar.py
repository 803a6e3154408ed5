"""Near-duplicates by similarity: anchors let documents meet, SimHash tries propose, shingle sets decide.

At a Jaccard similarity of 0.8 over word shingles SimHashes differ in about 10 of 64 bits, far beyond what blocks of
a fingerprint can find. So documents meet by anchors: each of `ANCHORS` keys is made of `ROWS` minima of its shingles'
hashes, and documents of similarity s share one with probability 1 - (1 - s ** ROWS) ** ANCHORS (0.9998 at 0.8).

A document is first compared with the least holders of its anchors, as far as sizes and fingerprints allow. Holders of an anchor that are of different
classes then are pairs of a trie: the fingerprints of each group are joined with themselves within a budget of
`NEAR_BITS` bits (about four standard deviations above the mean at 0.8). Full sets of 64-bit hashes decide. set_links has the joins, and says how groups are bounded; documents
meet by the anchors that they share, never by what others share.

A caller may give other texts of the documents, those that they had before a stage that changed them: documents that are near copies by either are linked, and so are
the two texts of a row. Rows of one id are told apart by the text that they have now, so each of them is tied to every other text of that id.

Defined results: null and empty texts have no shingle and are copies of each other; repeated rows are copies; the document with the least
id stays (nulls last), of several rows with that id the one with the least hash of its columns; an empty table gives no rows; columns pass through.
Very long texts are hashed in pieces, but a set of shingles is one value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.llm import set_links as S
from palimpsest.llm.simhash_trie import keep, majority_bits, trie_pairs
from palimpsest.operators.graph import star_roots
from palimpsest.operators.relational import join_dealt
from palimpsest.runtime import brief_shuffles, cut, planned_once

WORDS = 5
PERCENT = 80
ANCHORS = 12
ROWS = 3
NEAR_BITS = 20
#: Six standard deviations above the mean at 0.8: a bound for pairs whose sets are compared in any case.
FAR_BITS = 26

_MULTIPLIERS = K.mix(np.arange(1, ANCHORS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def anchors(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """ANCHORS keys per text, each from its place and ROWS minima; texts without a shingle have their places."""
    out = np.tile(np.arange(ANCHORS, dtype=np.uint64), (len(bounds) - 1, 1))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k, m in enumerate(_MULTIPLIERS):
            # Products of well-mixed hashes with an odd number are as good as mixed anew.
            least = np.minimum.reduceat(hashes * m, bounds[:-1][full])
            out[full, k // ROWS] = K.mix(out[full, k // ROWS] + K.mix(least))
    return out


def sketches(docs: DataFrame, id_col: str, tag: Column, text_col: str, words_of_shingle: int = WORDS) -> DataFrame:
    """__id, tag (a long), set_key (a hash of the set of shingles), n (its size), keys (anchors), prints (the SimHash of the set); one narrow pass."""
    out = K.schema(__id=docs.schema[id_col].dataType.simpleString(), tag="bigint", set_key="bigint", n="bigint", keys="array<bigint>", prints="array<bigint>")

    def run(batch: pa.RecordBatch):
        for a, b, hashes, bounds in S.shingle_hashes(batch.column(2), words_of_shingle):
            own, ends, set_keys = S.sets_of(hashes, bounds)
            flat = K.concat_rows(own, np.uint64)
            # Of the sets, as the similarity is: a block that one text repeats must not tell them apart.
            prints = majority_bits(flat, ends)
            yield [
                batch.column(0).slice(a, b - a),
                batch.column(1).slice(a, b - a),
                pa.array(set_keys.view(np.int64)),
                pa.array(np.diff(ends)),
                K.lists(anchors(flat, ends).ravel().view(np.int64), np.arange(b - a + 1) * ANCHORS, pa.int64()),
                K.lists(prints.view(np.int64), np.arange(b - a + 1), pa.int64()),
            ]

    return K.map_arrow(docs.select(F.col(id_col).alias("__id"), tag.alias("tag"), F.col(text_col).alias("text")), run, out)


def near_prints(a: Column, b: Column) -> Column:
    return F.bit_count(F.element_at(a, 1).bitwiseXOR(F.element_at(b, 1))) <= FAR_BITS


def trie_proposer(group: np.ndarray, prints: np.ndarray):
    """Pairs of places in each group whose fingerprints are within NEAR_BITS: the group's trie joined with itself; sets of one fingerprint stand at one leaf."""
    order = np.lexsort((prints[:, 0], group))
    g, keys = group[order], prints[order, 0]
    new = np.concatenate([[True], (np.diff(g) != 0) | (keys[1:] != keys[:-1])])
    leaf = np.flatnonzero(new)
    for i, j in S.all_pairs(np.cumsum(new)):
        yield order[i], order[j]
    size = np.diff(np.append(leaf, len(order)))
    lo = np.flatnonzero(np.concatenate([[True], np.diff(g[leaf]) != 0]))
    hi = np.append(lo[1:], len(leaf))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    if not len(lo):
        return
    for a, b in trie_pairs(keys[leaf], lo, hi, lo, hi, np.zeros(len(lo), np.int64), 0, NEAR_BITS):
        n = size[a] * size[b]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        across = np.repeat(size[b], n)
        yield order[np.repeat(leaf[a], n) + at // across], order[np.repeat(leaf[b], n) + at % across]


def changed(docs: DataFrame, also: DataFrame, id_col: str, text_col: str, mark: str, words_of_shingle: int) -> DataFrame:
    """Sketches of the texts in `also` that their id doesn't have in `docs`, with the marks of the rows of that id: __id, tag, set_key, n, keys, prints."""
    now = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(mark).alias("mark"), F.xxhash64(text_col).alias("now"))
    then = sketches(also.where(F.col(id_col).isNotNull()), id_col, F.xxhash64(text_col), text_col, words_of_shingle).dropDuplicates(["__id", "tag"])
    gone = then.join(now.select("__id", F.col("now").alias("tag")), ["__id", "tag"], "left_anti")
    return gone.drop("tag").join(now.select("__id", F.col("mark").alias("tag")).distinct(), "__id").select("__id", "tag", "set_key", "n", "keys", "prints")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words_of_shingle: int = WORDS, block: int = S.BLOCK, also: DataFrame | None = None) -> DataFrame:
    """`docs` with one document of each group of near-duplicates. Its columns and only these. `also`: other texts of documents, by the same id."""
    rows_, mark = K.marked(docs)
    with brief_shuffles(docs.sparkSession):
        rows = cut(sketches(rows_, id_col, F.col(mark), text_col, words_of_shingle))
        forms = rows.withColumn("other", F.lit(False))
        if also is not None:
            others = cut(changed(rows_, also, id_col, text_col, mark, words_of_shingle))
            forms = forms.unionByName(others.withColumn("other", F.lit(True)))
        row = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("tag").alias("mark"), "other")
        # Copies have equal anchors and fingerprints: any will do.
        distinct = forms.groupBy("set_key").agg(F.min(row).alias("head"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("prints").alias("prints"))
        # Documents meet the earliest, which the others are more likely to be like than they are like one another.
        distinct = cut(distinct.withColumn("owner", F.col("head.id")))
        n, shingles = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        with planned_once(docs.sparkSession, n, 8 * shingles) as parts:
            if parts == 1:  # no join or group of these exchanges anything
                distinct, rows = cut(distinct.coalesce(1)), cut(rows.coalesce(1))
                others = cut(others.coalesce(1)) if also is not None else None
            heads = distinct.select("set_key", "head.id", "head.mark", "head.other")

            def full(asked: DataFrame) -> DataFrame:
                asked = cut(asked.join(heads, "set_key"))
                texts = rows_.select(F.xxhash64(id_col, mark).alias("place"), F.col(text_col).alias("text"))
                if also is not None:
                    texts = texts.unionByName(also.select(F.xxhash64(id_col).alias("place"), F.col(text_col).alias("text")))
                place = F.when(F.col("other"), F.xxhash64("id")).otherwise(F.xxhash64("id", "mark"))
                return S.full_sets(texts, asked.select(place.alias("place"), "set_key"), words_of_shingle)

            edges = S.similar_links(distinct.where("n > 0"), full, percent, near_prints, trie_proposer, block)
            if also is not None:  # the texts of one row
                tie = rows.select("__id", "tag", F.col("set_key").alias("u")).join(others.select("__id", "tag", F.col("set_key").alias("v")), ["__id", "tag"])
                edges = edges.unionByName(tie.select("u", "v").distinct())
            roots = star_roots(edges).withColumnRenamed("node", "set_key")

            named = distinct.join(roots, "set_key", "left").select("set_key", F.col("head").dropFields("other").alias("head"), F.coalesce("root", "set_key").alias("root"))
            stay = named.groupBy("root").agg(F.min("head").alias("stays"))
            named = join_dealt(named.select("set_key", "root"), stay, "root", "set_key").select("set_key", "stays")
            one = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("tag").alias("mark"))
            judged = join_dealt(rows.select("__id", "tag", "set_key"), named, "set_key", "tag").select("__id", F.col("tag").alias("__head"), one.eqNullSafe(F.col("stays")).alias("stays"))
            judged = cut(judged.groupBy("__id", "__head").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    return keep(rows_, mark, id_col, judged)
