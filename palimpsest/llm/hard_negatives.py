"""Hard negatives by full score sorts.

Components become integers, so scores are exact. Anchors and rows are dealt over blocks, and each block of anchors meets each
block of rows in a group of bounded size. Two rounds over these groups:

1. of each anchor's scores in the block those of its own label, of which the first `n_positives` stay; the first of all blocks are its positives;
2. each anchor's scores in the block are sorted by score and id, those of other labels are searched for the upper limit of each positive
by bisection, and the next `k` entries above the lower limit are read; the first of all blocks are the result.

A block gives at most `n_positives` rows an anchor and `k` rows a positive. An anchor block holds `ANCHOR_BLOCK` anchors, so all rows travel
once for as many anchors.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; an anchor's other rows are those of another id; an id that
several rows have is several rows, but anchors alike in id, label and vector are one; rows without an id are no anchors, come last of equal scores and have null ids in the result;
only vectors of equal length are scored; integers beyond 2 ** 26 are held at it, so that inner products of up to 1,024 components fit a long; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.runtime import cut

ANCHOR_BLOCK = 1 << 14
ROW_BLOCK = 1 << 15
#: Blocks of rows at least, so that a small table is work for many tasks.
LEAST_BLOCKS = 24
#: Scores of so many anchors are held at once.
TILE = 64
MOST = 1 << 26
EXACT = 1 << 53


def integer_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, relabel_every: int = 7, n_labels: int = 10) -> DataFrame:
    """id, label, v (array of long) of the rows that take part. Every `relabel_every`-th id has the next of `n_labels` labels."""
    v = F.col(vector_col)
    usable = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.when(F.coalesce(F.pmod(F.col(id_col), F.lit(relabel_every)) == 0, F.lit(False)), (F.col(label_col) + 1) % n_labels).otherwise(F.col(label_col))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("long"))
    return table.where(usable).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2 ** 53, else in longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether each is null."""
    one = column.combine_chunks()
    return one.fill_null(0).to_numpy(zero_copy_only=False), one.is_null().to_numpy(zero_copy_only=False)


def _by_length(anchors: pa.Table, rows: pa.Table):
    """Anchors and rows of equal vector length: places of the anchors, and the rows sorted by id (nulls last) with their matrix."""
    n_a, n_r = (t["v"].combine_chunks().value_lengths().to_numpy() for t in (anchors, rows))
    matrix = lambda t, at, d: t["v"].combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
    ids, none = _ids(rows["id"])
    order = np.lexsort((ids, none))
    for d in np.intersect1d(n_a, n_r).tolist():
        at, own = np.flatnonzero(n_a == d), order[n_r[order] == d]
        yield at, own, matrix(anchors, at, d), matrix(rows, own, d)


def _tiles(anchors: pa.Table, rows: pa.Table):
    """(place of an anchor, its scores, the rows' places sorted by id) for all anchors of the group."""
    for at, own, a, b in _by_length(anchors, rows):
        for x in range(0, len(at), TILE):
            yield from zip(at[x : x + TILE].tolist(), inner_products(a[x : x + TILE], b), [own] * TILE, strict=False)


def first_positives(anchors: pa.Table, rows: pa.Table, n_positives: int) -> pa.Table:
    """anchor, id, score: of each anchor's rows of its label in this block the first `n_positives`."""
    label, own_label = rows["label"].to_numpy(), anchors["label"].to_numpy()
    ids, none = _ids(rows["id"])
    own_ids = anchors["id"].to_numpy()
    keys = anchors["anchor"].to_numpy()
    out: list[tuple] = []
    for k, score, order in _tiles(anchors, rows):
        same = np.flatnonzero((label[order] == own_label[k]) & ((ids[order] != own_ids[k]) | none[order]))
        # Rows lie by id: a stable sort by score is one by score and id.
        top = same[np.argsort(-score[same], kind="stable")[:n_positives]]
        out.append((np.full(len(top), keys[k]), order[top], score[top]))
    anchor, at, score = (K.concat_rows([o[c] for o in out]) for c in range(3))
    return pa.table({"anchor": pa.array(anchor, pa.int64()), "id": rows["id"].take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64())})


def negatives_below(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """anchor, positive (its rank), id, score: for each positive the first `k` rows of another label with low * positive <= 100 * score <= high * positive."""
    label, own_label = rows["label"].to_numpy(), anchors["label"].to_numpy()
    keys, positives = anchors["anchor"].to_numpy(), anchors["scores"].to_pylist()
    out: list[tuple] = []
    for a, score, order in _tiles(anchors, rows):
        other = np.flatnonzero(label[order] != own_label[a])
        falling = other[np.lexsort((np.arange(len(other)), -score[other]))]
        rising = -score[falling]
        # 100 * score <= high * p and >= low * p, in whole numbers.
        p = np.array(positives[a], np.int64)
        first = np.searchsorted(rising, -((high * p) // 100), "left")
        last = np.searchsorted(rising, -(-((-low * p) // 100)), "right")
        for rank, (x, y) in enumerate(zip(first.tolist(), np.minimum(last, first + k).tolist(), strict=True), 1):
            if x < y:
                out.append((np.full(y - x, keys[a]), np.full(y - x, rank), order[falling[x:y]], -rising[x:y]))
    anchor, positive, at, score = (K.concat_rows([o[c] for o in out]) for c in range(4))
    return pa.table({"anchor": pa.array(anchor, pa.int64()), "positive": pa.array(positive, pa.int64()), "id": rows["id"].take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64())})


def mine(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 50, n_positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = 256, relabel_every: int = 7, n_labels: int = 10, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the first `k` rows of another label
    whose score is between `low` and `high` hundredths of the positive's."""
    rows = integer_rows(table, id_col, vector_col, label_col, scale, relabel_every, n_labels)
    anchors = rows.where(F.col("id") % anchor_every == 0).withColumn("anchor", F.xxhash64("id", "label", "v")).dropDuplicates(["anchor"])
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(F.col("id") % anchor_every == 0)).first()
    row_blocks, anchor_blocks = max(LEAST_BLOCKS, -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    # Rows alike in all columns are one after another in a block; which block a row is in doesn't matter to the result.
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks))).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    spread = lambda df: df.withColumn("ab", F.pmod("anchor", F.lit(anchor_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    blocks = dealt.groupBy("ab", "rb")

    one = spread(anchors).groupBy("ab", "rb").cogroup(blocks).applyInArrow(lambda a, r: first_positives(a, r, n_positives), K.schema(anchor="bigint", id="bigint", score="bigint"))
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    positives = cut(one.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_positives))
    known = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    known = cut(anchors.join(known, "anchor").select("anchor", "id", "label", "v", "p"))

    asked = spread(known.select("anchor", "id", "label", "v", F.col("p.score").alias("scores")))
    two = asked.groupBy("ab", "rb").cogroup(blocks).applyInArrow(lambda a, r: negatives_below(a, r, k, low, high), K.schema(anchor="bigint", positive="bigint", id="bigint", score="bigint"))
    best = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = two.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    of = known.select("anchor", F.col("id").alias("anchor_id"), F.explode("p").alias("p")).select("anchor", "anchor_id", F.col("p.rank").cast("long").alias("positive"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(of, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
