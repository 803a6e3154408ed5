import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import queries as Q
from palimpsest.llm import whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def brute(rows, k=8):
    """id -> (n, deviation, whitened, explained) of one length of vectors, by the covariance's own eigenvectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[n * r[j] - sums[j] for j in range(d)] for r in x], float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check(out, rows, k=8, tolerance=1e-9):
    n, deviation, white, explained = brute(rows, k)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], []).append(r)
    assert len(out) == len(rows) * k
    signs = None
    for place, (i, _) in enumerate(rows):
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {r["n"] for r in mine} == {n} and {r["deviation"] for r in mine} == {deviation[place]}
        w = np.array([r["whitened"] for r in mine])
        signs = np.sign(w * white[place]) if signs is None else signs
        assert np.allclose(w, white[place] * signs, atol=tolerance)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)
        assert {r["identity_error"] for r in mine} == {mine[0]["identity_error"]} and mine[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("partitions,fan", [(1, 16), (7, 2), (40, 3)])
def test_by_eigenvectors(spark, monkeypatch, partitions, fan):
    monkeypatch.setattr(W.merge_levels, "__defaults__", (fan,))
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 12)) * np.linspace(3, 0.4, 12) + 50
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).collect(), rows)


def test_given_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(Q.queries()["op12_whitening"](spark, sf).collect(), rows)


def test_merging_loses_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(99_000, 101_000, (500, 9))
    whole = W.state_of(x)
    parts = [W.state_of(x[a:b]) for a, b in ((0, 3), (3, 4), (4, 100), (100, 500))]
    state = W.merged(W.merged(parts[0], parts[1]), W.merged(parts[2], parts[3]))
    assert state[0] == 500 and (state[1] == x.sum(axis=0)).all()
    assert np.allclose(state[2], whole[2], rtol=1e-12)
    assert np.allclose(np.abs((state[3] * whole[3]).sum(axis=1)), 1, atol=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(40, 3)))]
    good += [good[0]]  # a repeated row counts
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan")] * 3), (53, [1.0, float("-inf"), 0.0])]
    df = spark.createDataFrame(good + bad + [(None, [1.0, 2.0]), (60, [3.0, 5.0]), (61, []), (70, [4.0])], SCHEMA)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "x", "dims", "component", "w", "n", "z", "explained")])
    out = W.whiten(df).collect()
    assert {r["vec_id"] for r in out} == {*range(40), None, 60, 70}
    n, deviation, white, explained = brute(good, 3)
    mine = sorted((r for r in out if r["vec_id"] == 0), key=lambda r: r["component"])
    assert len(mine) == 6 and {r["n"] for r in mine} == {41} and {r["deviation"] for r in mine} == {deviation[0]}
    assert np.allclose(np.abs([r["whitened"] for r in mine[::2]]), np.abs(white[0]))
    # Two rows have one component with variance, one row has none.
    two = sorted((r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in out if r["vec_id"] == 60)
    assert two == [(1, 1.0, 1.0), (2, 0.0, 0.0)]
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in out if r["vec_id"] == 70] == [(1, 0.0, 0.0, 0, 0.0)]
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[1 << 32, 0], [0, 5]])
    assert W.deviations(x, 2, x.sum(axis=0)) == [None, None]
    assert W.deviations(np.array([[100_001, 7]]), 3, np.array([300_000, 9])) == [9 + 144]
