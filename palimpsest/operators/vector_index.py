"""Inverted-file index of vectors: cells around centroids, probes in order of distance, exact scores, and exact bounds by angles.

Centroids come from a sample of bounded size that covers all rows (a hash of the id draws it). Each vector lies in the cell of its nearest centroid, and
a borderline one in its second nearest too. A cell has a radius, the largest angle between its centroid and a vector whose first cell it is: by the triangle inequality a
vector of it is at least (angle to the centroid - radius) away from a query. So a search can probe a number of cells (approximate: `calibrate` finds how many a recall needs),
all cells that may hold a score of `least` (exact), or, without either, some cells first and then all that the k-th score found doesn't rule out (exact).

Within scopes, a scope of at most `part` vectors is one cell of its own, and only larger ones are parted by centroids. The index is a table of vectors
sorted by cell, and small tables of centroids, radii and large scopes. A search deals the vectors of a cell over parts and the queries that probe it over blocks, and each part
meets each block in a group of bounded size; vectors of cells that nobody probes stay away. So what travels grows with the probes, not with
queries times items. Scores are those of the full vectors (cosines in doubles); ties go to the least id.

Vectors that are null or not finite, vectors of another length than the longest and null ids are not in it and match nothing; a vector of zeros has a cosine of 0 with everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.relational import join_dealt
from palimpsest.runtime import cut, remove, shared_path

#: Cells at most; their centroids are what is broadcast, so this bounds it (with 64 dimensions to 2 MB).
MOST_CELLS = 4096
#: Vectors of the sample that centroids are learnt from, for each cell.
SAMPLE_PER_CELL = 32
ROUNDS = 8
PART = 1 << 14
BLOCK = 2048
#: A vector is in its second nearest cell too if that one's centroid is at most so much farther (radians).
SPILL = 0.02
#: Scores that a task holds at once, and rows of a batch of routed queries.
TILE = 1 << 20
ROUTED = 1 << 13
#: Rows of a cell where all rows ask, at least: each row travels once for each cell in reach, which may be all.
CELL_ROWS = 1 << 13
#: Where all rows ask, how often each travels at most, as long as that makes no side of a group larger than `MOST_SIDE` rows (32 MB at 64 dimensions).
COPIES = 16
MOST_SIDE = 1 << 16
#: Scopes and cells whose sizes are broadcast.
FEW = 1 << 16
#: The cell of a scope without cells.
WHOLE = -1
#: Radians that bounds are widened by, for what rounding does to angles.
SLOP = 1e-6


@dataclass
class VectorIndex:
    """path: of the tables. centers: unit vectors, one a cell. radius: of each cell. full: whether it has vectors. part: how many vectors of a cell meet at once; scopes of so many have no cells."""

    spark: SparkSession
    path: str
    centers: np.ndarray
    radius: np.ndarray
    full: np.ndarray
    part: int

    def rows(self) -> DataFrame:
        """cell, first (whether it is the vector's nearest one), id, g (its scope), v (unit vector) and kept columns."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def large_scopes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/large")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, in doubles, without a detour by Python values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def angles(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centers.T, -1, 1))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: each stands beside all cells."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def best(q: np.ndarray, t: np.ndarray, k: int, bar: Callable[[np.ndarray, slice], None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the k greatest of each row of q @ t.T, the greatest first; of scores that are equal to nine digits the first column. `bar` sets what can't be one (of some rows) to -inf.

    A tile of scores stands at once, never all of them."""
    found = []
    n, m = len(q), len(t)
    step = max(1, TILE // max(m, 1))
    for at in range(0, n, step):
        score = q[at : at + step] @ t.T
        score[np.isnan(score)] = -np.inf
        bar(score, slice(at, at + step))
        least = np.partition(score, m - k, axis=1)[:, m - k, None] - 2e-9 if m > k else -np.inf
        i, j = np.nonzero((score >= least) & np.isfinite(score))
        value = score[i, j]
        order = np.lexsort((j, -np.round(value, 9), i))
        i, j, value = i[order], j[order], value[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[place < k] + at, j[place < k], value[place < k]))
    return tuple(np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64 if x < 2 else float) for x in range(3))


def learn(sample: np.ndarray, n_cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means; the first ones are spread over the sorted sample, so the same sample gives the same ones."""
    sample = unit(sample[np.lexsort(sample.T[::-1])]) if len(sample) else sample
    centers = sample[np.linspace(0, len(sample) - 1, min(n_cells, len(sample))).astype(int)] if len(sample) else sample
    for _ in range(rounds):
        if len(centers) < 2:
            break
        own = np.argmax(sample @ centers.T, axis=1)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        moved = centers.copy()
        moved[held] = unit(np.add.reduceat(sample[order], first, axis=0))
        if np.allclose(moved, centers, atol=1e-9):
            break
        centers = moved
    return centers


def _assign(rows: DataFrame, centers: np.ndarray, spill: float) -> DataFrame:
    """rows (id, g, large, v, ...) with unit vectors, cell, first and angle: one row for the nearest cell, and one for the second where it is about as near. Rows of small scopes lie in cell WHOLE."""
    known = rows.sparkSession.sparkContext.broadcast(centers)
    names = [c for c in rows.columns if c not in ("v", "large")]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            v, large = unit(matrix(batch.column("v"))), batch.column("large").to_numpy(zero_copy_only=False)
            a = angles(v, known.value)
            order = np.argsort(a, axis=1, kind="stable")[:, :2]
            near = np.take_along_axis(a, order, 1)
            both = large & (near[:, 1] - near[:, 0] <= spill) if order.shape[1] > 1 and spill > 0 else np.zeros(len(v), bool)
            at = np.concatenate([np.arange(len(v)), np.flatnonzero(both)])
            second = np.arange(len(at)) >= len(v)
            cell = np.where(large[at], order[at, second.astype(int)], WHOLE).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * v.shape[1], pa.int32()), pa.array(v[at].ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in names], flat, pa.array(cell), pa.array(~second), pa.array(near[at, second.astype(int)])], schema.fieldNames())

    return rows.select(*names, "large", "v").mapInArrow(run, schema)


def usable(vector: str) -> Column:
    """Whether a vector is there and all of it finite."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _scope(within: str | None) -> Column:
    return F.lit(0).cast("long") if within is None else F.xxhash64(within)


def write_index(items: DataFrame, path: str | None = None, item_id: str = "id", vector: str = "embedding", within: str | None = None, keep: list[str] | None = None, n_cells: int | None = None, spill: float = SPILL, part: int = PART, sample_per_cell: int = SAMPLE_PER_CELL) -> VectorIndex:
    """An index of the items at the path (a fresh one in the shared folder). `keep`: columns that searches may filter by. Cells: about the square root of the items, `MOST_CELLS` at most."""
    spark = items.sparkSession
    path = path or shared_path(spark, "vector-index")
    rows = items.where(usable(vector) & F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), _scope(within).alias("g"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c) for c in keep or []])
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    rows = rows.where(F.size("v") == (dims or 0))
    if within is None:
        large = spark.createDataFrame([(0,)] if n > part or n_cells else [], "g long")
    else:
        large = rows.groupBy("g").count().where(F.col("count") > part).select("g")
    large.write.parquet(f"{path}/large")
    large = spark.read.parquet(f"{path}/large").withColumn("large", F.lit(True))
    n_cells = max(1, min(n_cells or round(n**0.5), MOST_CELLS))
    # A draw by hash covers all rows; of what it draws at most twice the bound is taken.
    bound = n_cells * sample_per_cell
    draw = int(min(1.0, 1.5 * bound / max(n, 1)) * (1 << 20)) + 1
    sample = matrix(rows.where(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 20)) < draw).select("v").limit(2 * bound).toArrow()["v"])
    centers = learn(sample, n_cells) if len(sample) else np.zeros((1, dims or 1))
    dealt = cut(_assign(rows.join(F.broadcast(large) if within is None else large, "g", "left").withColumn("large", F.coalesce("large", F.lit(False))), centers, spill))
    # A range of a hash beside the cell parts a large cell over files.
    dealt.drop("angle").repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
    dealt.where(F.col("cell") >= 0).groupBy("cell").agg(F.max(F.when(F.col("first"), F.col("angle"))).alias("radius")).coalesce(1).write.parquet(f"{path}/radii")
    spark.createDataFrame([(k, part, c.tolist()) for k, c in enumerate(centers)], "cell int, part int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that lies at the path. Its centroids come to the driver: `MOST_CELLS` rows at most."""
    known = spark.read.parquet(f"{path}/centers").orderBy("cell").toArrow()
    radius, full = np.zeros(len(known)), np.zeros(len(known), bool)
    for r in spark.read.parquet(f"{path}/radii").collect():
        radius[r["cell"]], full[r["cell"]] = r["radius"] or 0.0, True
    return VectorIndex(spark, path, matrix(known["center"]), radius, full, known["part"][0].as_py())


# Search ------------------------------------------------------------------------------------------------------------

#: What a group makes of its queries (query, v) and items (id, v).
Judge = Callable[[pa.Table, pa.Table], pa.Table]


def _route(asked: DataFrame, index: VectorIndex, within: str | None, cells_of: Callable[[np.ndarray, dict], np.ndarray], whole: bool = True) -> DataFrame:
    """asked (query, g, v, ...) with a row for each cell that `cells_of` marks, from angles (queries by cells) and what is known of cells. Queries of small scopes have the one cell there, if `whole`."""
    known = index.spark.sparkContext.broadcast((index.centers, index.radius, index.full))
    large = index.large_scopes().withColumn("large", F.lit(True))
    asked = asked.join(F.broadcast(large) if within is None else large, "g", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    names = [c for c in asked.columns if c != "large"]
    schema = T.StructType([asked.schema[c] for c in names] + [T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, radius, full = known.value
        for batch in _slices(batches):
            if batch.num_rows:
                a = angles(unit(matrix(batch.column("v"))), centers)
                large = batch.column("large").to_numpy(zero_copy_only=False)
                own_columns = {c: batch.column(c).to_numpy() for c in ("reach", "own") if c in batch.schema.names}
                i, cell = np.nonzero(cells_of(a, {"radius": radius, "full": full, **own_columns}) & full[None, :] & large[:, None])
                small = np.flatnonzero(~large) if whole else np.zeros(0, np.int64)
                i, cell = np.concatenate([i, small]), np.concatenate([cell, np.full(len(small), WHOLE)]).astype(np.int32)
                own = batch.select(names)
                for at in range(0, len(i), ROUTED):
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(i[at : at + ROUTED])).columns, pa.array(cell[at : at + ROUTED])], schema.fieldNames())

    return asked.select(*names, "large").mapInArrow(run, schema)


def nearest_cells(a: np.ndarray, full: np.ndarray, probes: int) -> np.ndarray:
    """Marks the `probes` nearest cells that aren't empty."""
    a = np.where(full[None, :], a, np.inf)
    marks = np.zeros(a.shape, bool)
    np.put_along_axis(marks, np.argsort(a, axis=1, kind="stable")[:, :probes], True, 1)
    return marks


def meet(routed: DataFrame, items: DataFrame, index: VectorIndex, within: str | None, judge: Judge, schema: T.StructType, block: int = BLOCK, extra: tuple[str, ...] = ()) -> DataFrame:
    """What `judge` makes of the queries and the items of each scope and cell that they were sent to. items: rows of the index, as far as they are wanted; `extra`: columns that both have beside."""
    key = ["g", "cell"]
    blocks = routed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    both = items.groupBy(*key).agg(F.ceil(F.count("*") / index.part).cast("int").alias("parts")).join(blocks, key)
    both = cut(both)
    # Without scopes there are as many rows as cells at most.
    few = within is None or both.count() <= FEW
    beside = lambda rows, own: rows.join(F.broadcast(both), key) if few else join_dealt(rows, both, key, own)
    mine = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = beside(routed, "query").withColumn("block", mine("query", "blocks")).withColumn("part", every("parts")).select(*key, "part", "block", "query", "v", *extra)
    t = beside(items, "id").withColumn("part", mine("id", "parts")).withColumn("block", every("blocks")).select(*key, "part", "block", "id", "v", *extra)
    groups = [*key, "part", "block"]
    return q.groupBy(*groups).cogroup(t.groupBy(*groups)).applyInArrow(judge, schema)


def _best(k: int, least: float | None, schema: T.StructType) -> Judge:
    def judge(q: pa.Table, t: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        if not q.num_rows or not t.num_rows:
            return pa.table([pa.array([], q.schema.field("query").type), pa.array([], t.schema.field("id").type), pa.array([], pa.float64())], names)
        t = t.sort_by("id")
        ids, own = q["query"].to_numpy(), t["id"].to_numpy()

        def bar(score: np.ndarray, at: slice) -> None:
            score[ids[at, None] == own[None, :]] = -np.inf
            if least is not None:
                score[score < least - 5e-10] = -np.inf

        i, j, value = best(unit(matrix(q["v"])), unit(matrix(t["v"])), k, bar)
        if least is not None:
            good = np.round(value, 9) >= least
            i, j, value = i[good], j[good], value[good]
        return pa.table([q["query"].take(pa.array(i)), t["id"].take(pa.array(j)), pa.array(value)], names)

    return judge


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query; an item that lies in two cells counts once."""
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return once.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query", vector: str = "embedding", within: str | None = None, where: Column | None = None, probes: int | None = None, least: float | None = None, first: int = 4, block: int = BLOCK) -> DataFrame:
    """query, id, score, rank: the k nearest items by cosine (ties: least id), never the query itself, as `retrieval.knn` has them.

    With `probes` of that many cells; with `least` all that score so much; with neither the exact ones, of `first` cells and all that may still hold a better one. `within`: only items equal in what the
    index was written with. `where`: of the items, over the index's kept columns."""
    asked = queries.where(usable(vector) & F.col(query_id).isNotNull() & (F.size(vector) == index.centers.shape[1])).select(F.col(query_id).alias("query"), _scope(within).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    items = index.rows() if where is None else index.rows().where(where)
    schema = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField("id", items.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    judge = _best(k, least, schema)
    found = lambda routed, items: meet(routed, items, index, within, judge, schema, block)
    if probes is not None:
        return _top(found(_route(asked, index, within, lambda a, x: nearest_cells(a, x["full"], probes)), items), k)
    # Where bounds decide which cells to look at, the first cell of a vector is enough.
    items = items.where("first")
    if least is not None:
        reach = float(np.arccos(np.clip(least - 1e-9, -1, 1))) + SLOP
        return _top(found(_route(asked, index, within, lambda a, x: a - x["radius"][None, :] <= reach), items), k)
    near = cut(_top(found(_route(asked, index, within, lambda a, x: nearest_cells(a, x["full"], first)), items), k))
    if len(index.centers) <= first:
        return near
    kth = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    # A tie with the k-th score may have a lesser id.
    open_ = asked.join(kth, "query", "left").withColumn("reach", F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.col("kth") - 1e-9)), F.lit(4.0)) + SLOP).drop("kth")
    rest = _route(open_, index, within, lambda a, x: (a - x["radius"][None, :] <= x["reach"][:, None]) & ~nearest_cells(a, x["full"], first), whole=False)
    return _top(near.select("query", "id", "score").unionByName(found(rest.drop("reach"), items)), k)


def calibrate(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.9, most_queries: int = 256, **options) -> int:
    """The fewest probes, of powers of two, with which the k nearest of a bounded sample of the queries (drawn by hash) are found to that share."""
    query_id = options.get("query_id", "query")
    n = queries.count()
    share = min(1.0, most_queries / max(n, 1))
    some = cut(queries.where(F.pmod(F.xxhash64(query_id, F.lit("calibrate")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    right = cut(search(index, some, k, **options).select("query", "id"))
    wanted, probes, cells = right.count(), 1, int(index.full.sum())
    while probes < cells:
        if search(index, some, k, probes=probes, **options).join(right, ["query", "id"], "left_semi").count() >= recall * wanted:
            return probes
        probes *= 2
    return max(cells, 1)


def largest(rows: DataFrame, within: str | None) -> int:
    """Rows of the largest scope."""
    return rows.count() if within is None else rows.groupBy(within).count().agg(F.max("count")).first()[0] or 0


def side(n: int, least: int) -> int:
    """Rows of a group's side where n rows meet all of n: with sides of a fixed number what travels grows with the square of n, and so each row goes to `COPIES` groups of n / `COPIES` rows."""
    return max(least, min(-(-n // COPIES), MOST_SIDE))


def nearest(queries: DataFrame, items: DataFrame, k: int, least: float | None = None, within: str | None = None) -> DataFrame:
    """The exact k nearest (query, id, score, rank) by an index that is written for this one search. queries: query, embedding; items: id, embedding; `least` leaves out lower scores, and then the cells that hold none."""
    n = largest(items, within)
    # No more than a part lies in no cells.
    index = write_index(items, within=within, spill=0.0, part=side(n, PART), n_cells=-(-n // side(n, CELL_ROWS)) if n > PART else None)
    out = cut(search(index, queries, k, within=within, least=least, block=side(largest(queries, within), PART)))
    remove(items.sparkSession, index.path)
    return out


# Self-join by a threshold ------------------------------------------------------------------------------------------


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the least column that they are connected with, -1 for those without a link."""
    n, m = near.shape
    step = max(1, TILE // max(m, 1))
    column = np.where(near.any(axis=0), np.arange(m), m)
    row = np.full(n, m)
    while True:
        moved = column.copy()
        for at in range(0, n, step):
            tile = near[at : at + step]
            row[at : at + step] = np.where(tile, column[None, :], m).min(axis=1, initial=m)
            moved = np.minimum(moved, np.where(tile, row[at : at + step, None], m).min(axis=0, initial=m))
        if (moved == column).all():
            break
        column = moved
    return np.where(row == m, -1, row), np.where(column == m, -1, column)


def tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """left @ right.T, some rows at a time: the first one's place, and scores."""
    step = max(1, TILE // max(len(right), 1))
    for at in range(0, len(left), step):
        yield at, left[at : at + step] @ right.T


def threshold_join(rows: DataFrame, tau: float, judge: Judge, schema: T.StructType, extra: tuple[str, ...] = (), part: int = 4096, n_cells: int | None = None, once: bool = False) -> DataFrame:
    """What `judge` makes of rows (id, scope, v, and `extra`) in reach of each other: each row with those of its scope in each cell that may hold a cosine of tau, itself included, never all with all.

    judge(left, right): tables query, v and id, v, each with `extra`. All pairs of at least tau meet, each from both sides; with `once` rows of two cells meet from one side only, and both tables have `own`, the cell of each row."""
    n_cells = n_cells or -(-2 * largest(rows, "scope") // part)
    index = write_index(rows, vector="v", within="scope", keep=list(extra), spill=0.0, part=part, n_cells=n_cells)
    items, asked = index.rows(), rows.where(usable("v")).select(F.col("id").alias("query"), F.xxhash64("scope").alias("g"), F.col("v").cast("array<double>").alias("v"), *extra)
    if once:
        items, extra = items.withColumn("own", F.col("cell")), (*extra, "own")
        asked = items.select(F.col("id").alias("query"), "g", "v", *extra)
    reach = float(np.arccos(np.clip(tau, -1, 1))) + SLOP
    later = lambda a, x: np.arange(a.shape[1])[None, :] >= x["own"][:, None] if once else True
    routed = _route(asked.where(F.size("v") == index.centers.shape[1]), index, "scope", lambda a, x: (a - x["radius"][None, :] <= reach) & later(a, x))
    out = cut(meet(routed, items, index, "scope", judge, schema, block=part, extra=extra))
    remove(rows.sparkSession, index.path)
    return out
