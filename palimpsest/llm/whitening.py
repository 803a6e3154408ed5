"""Whitening of embeddings by merging singular value decompositions.

Entries become integers, so counts, sums and deviations are exact. A partition holds n, the integer sums S, and the singular values and right vectors
of its rows less their mean, all dimensions of them. Two such states are merged without loss: the singular values times the vectors of both and one more row, the
difference of the means times sqrt(n1 * n2 / (n1 + n2)), are decomposed again. Batches merge within a partition, partitions merge in groups of FAN, level by level
on executors, until one state is left. Its vectors are the components, and its singular values squared, over n, their eigenvalues.

A second pass projects each row; the covariance of what comes out is merged the same way and tells how far it is from the identity. States have
the size of a square of the dimensions, whatever the number of rows; only the last one comes to the driver.

Defined results: rows whose vector is null, or has null or non-finite entries, are dropped; vectors of another length are a population of their own with its own n, sums
and components; a population of fewer dimensions than asked has as many components; a component without variance (below 1e-13 of all) is 0 in whitened and explained and is left out of
identity_error; integers beyond 2 ** 31 are held at it; a deviation beyond a long is null; repeated rows count each; an empty table gives no rows; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.runtime import cut

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
FAN = 16
MOST = float(1 << 31)
NO_VARIANCE = 1e-13

#: Columns of the two kinds of state.
STATE = {"part": "bigint", "dims": "int", "n": "bigint", "sums": "array<bigint>", "values": "array<double>", "vectors": "array<double>"}
SPREAD = {"part": "bigint", "dims": "int", "n": "bigint", "means": "array<double>", "moments": "array<double>"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def integer_rows(table: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, x (array of long), dims."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))).cast("long") + F.lit(shift).cast("long"))
    return table.where(usable).select(F.col(id_col).alias("id"), x.alias("x")).withColumn("dims", F.size("x"))


# States ------------------------------------------------------------------------------------------------------------

State = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def decomposed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors, as many as there are dimensions at most."""
    if a.shape[0] > a.shape[1]:  # a triangle has the same ones, and is small
        a = np.linalg.qr(a, mode="r")
    _, values, vectors = np.linalg.svd(a, full_matrices=False)
    return values, vectors


def state_of(x: np.ndarray) -> State:
    """n, sums, singular values and vectors of integer rows."""
    n, sums = len(x), x.sum(axis=0)
    # n * x - S is exact as long as it fits; n of a batch is small.
    return (n, sums, *decomposed((n * x - sums) / n))


def merged(a: State, b: State) -> State:
    """The state of both sets of rows."""
    (n1, s1, e1, v1), (n2, s2, e2, v2) = a, b
    # Of integers, so that nothing is lost where means are large and near each other.
    apart = np.array([float(int(x) * n2 - int(y) * n1) for x, y in zip(s1, s2, strict=True)]) / (float(n1) * float(n2))
    row = apart * np.sqrt(float(n1) * float(n2) / float(n1 + n2))
    return (n1 + n2, s1 + s2, *decomposed(np.concatenate([e1[:, None] * v1, e2[:, None] * v2, row[None, :]])))


Spread = tuple[int, np.ndarray, np.ndarray]


def spread_of(w: np.ndarray) -> Spread:
    """n, means, and sums of products of rows less their means."""
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merged_spread(a: Spread, b: Spread) -> Spread:
    (n1, m1, c1), (n2, m2, c2) = a, b
    n, apart = n1 + n2, m2 - m1
    return n, m1 + apart * (n2 / n), c1 + c2 + np.outer(apart, apart) * (n1 * (n2 / n))


def _flat(state: tuple) -> list[list]:
    return [np.asarray(x).ravel().tolist() for x in state]


def _whole(row: dict) -> State:
    d = row["dims"]
    return row["n"], np.array(row["sums"], np.int64), np.array(row["values"]), np.array(row["vectors"]).reshape(-1, d)


def _whole_spread(row: dict) -> Spread:
    k = len(row["means"])
    return row["n"], np.array(row["means"]), np.array(row["moments"]).reshape(k, k)


def merge_levels(states: DataFrame, whole: Callable[[dict], tuple], merge: Callable, fan: int = FAN) -> DataFrame:
    """One state for each number of dims, by groups of `fan` states of neighbouring parts, level by level. Parts are numbered from 0."""
    schema = states.schema

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        state = whole(rows[0])
        for r in rows[1:]:
            state = merge(state, whole(r))
        n, *rest = state
        return pa.table([[rows[0]["part"] // fan], [rows[0]["dims"]], [n], *[[x] for x in _flat(rest)]], schema=group.schema)

    states = cut(states)
    while (states.agg(F.max("part")).first()[0] or 0) > 0:
        states = cut(states.groupBy("dims", F.floor(F.col("part") / fan).alias("up")).applyInArrow(run, schema))
    return states


def _states(rows: DataFrame, columns: list[str], first: Callable, merge: Callable, kinds: dict[str, str]) -> DataFrame:
    """A state of each partition and number of dims. `columns`: dims, and the rows' lists."""
    out = pa.schema([(name, _ARROW[kind]) for name, kind in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple] = {}
        for batch in batches:
            dims, lists = batch.column(0).to_numpy(), batch.column(1)
            for d in np.unique(dims).tolist():
                own = lists.filter(pa.array(dims == d))
                state = first(own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
                held[d] = merge(held[d], state) if d in held else state
        part = TaskContext.get().partitionId()
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, [part, d, s[0], *_flat(s[1:])], strict=True)) for d, s in held.items()], out)

    return K.bounded_batches(rows.select(*columns)).mapInArrow(run, K.schema(**kinds))


def fit(rows: DataFrame) -> DataFrame:
    """The state of all rows (id, x, dims) of each number of dims."""
    return merge_levels(_states(rows.where("dims > 0"), ["dims", "x"], state_of, merged, STATE), _whole, merged)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the sum of (n * x - S) ** 2, exact; None where it passes a long."""
    least, most = int((n * x.min(axis=0).astype(object) - sums).min()), int((n * x.max(axis=0).astype(object) - sums).max())
    if max(abs(least), abs(most)) ** 2 * x.shape[1] < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    found = [sum(int(n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in found]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each row that stays and each component."""
    rows = integer_rows(table, id_col, vector_col, scale, shift)
    models = {}
    for r in fit(rows).collect():
        n, sums, values, vectors = _whole(r.asDict())
        power = values**2
        total = power.sum()
        k = min(components, r["dims"])
        vectors = np.concatenate([vectors, np.zeros((max(0, k - len(vectors)), r["dims"]))])[:k]
        power = np.concatenate([power, np.zeros(max(0, k - len(power)))])[:k]
        has = power > NO_VARIANCE * total
        explained = np.where(has, power / total if total else 0.0, 0.0)
        models[r["dims"]] = (n, sums, vectors.T, np.where(has, np.sqrt(n / np.where(has, power, 1.0)), 0.0), explained, has)
    known = table.sparkSession.sparkContext.broadcast(models)
    out = K.schema(id=rows.schema["id"].dataType.simpleString(), dims="int", n="bigint", deviation="bigint", w="array<double>", explained="array<double>")

    def project(batch: pa.RecordBatch):
        dims = batch.column(2).to_numpy()
        for d in np.unique(dims[dims > 0]).tolist():
            n, sums, vectors, factor, explained, _ = known.value[d]
            at = pa.array(np.flatnonzero(dims == d))
            x = batch.column(1).take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
            exact = n * x - sums if int(np.abs(x).max()) * n < 1 << 62 else (n * x.astype(object) - sums.astype(object))
            w = ((exact.astype(np.float64) / n) @ vectors) * factor
            k = w.shape[1]
            offsets = np.arange(len(at) + 1) * k
            yield [batch.column(0).take(at), pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), n), pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), K.lists(w.ravel(), offsets, pa.float64()), K.lists(np.tile(explained, len(at)), offsets, pa.float64())]

    done = cut(K.map_arrow(rows, project, out))
    spread = merge_levels(_states(done, ["dims", "w"], spread_of, merged_spread, SPREAD), _whole_spread, merged_spread)
    errors = []
    for r in spread.collect():
        n, _, moments = _whole_spread(r.asDict())
        has = models[r["dims"]][5]
        off = np.abs(moments / n - np.eye(len(has)))[np.ix_(has, has)]
        errors.append((r["dims"], float(off.max(initial=0.0))))
    error = F.lit(0.0)
    for d, e in errors:
        error = F.when(F.col("dims") == d, F.lit(e)).otherwise(error)
    done = done.select("id", "n", "deviation", error.alias("identity_error"), F.posexplode(F.arrays_zip("w", "explained")).alias("component", "z"))
    return done.select(F.col("id").alias(id_col), (F.col("component") + 1).alias("component"), "n", "deviation", F.col("z.w").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
