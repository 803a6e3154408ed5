import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import hard_negatives as H

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, k=3, n_positives=5, every=50):
    """The contract, row by row, in whole numbers. Nulls come last of equal scores."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, [max(-H.MOST, min(H.MOST, math.floor(256 * float(np.float32(x))))) for x in v], label))
    out, seen = [], set()
    for a in kept:
        key = (a[0], tuple(a[1]), a[2])
        if a[0] is None or a[0] % every or key in seen:
            continue
        seen.add(key)
        scored = sorted(((-sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0] is None, b[0] or 0, b[2]) for b in kept if len(b[1]) == len(a[1]) and b[0] != a[0]))
        name = lambda s: None if s[1] else s[2]
        for p in [s for s in scored if s[3] == a[2]][:n_positives]:
            found = [s for s in scored if s[3] != a[2] and -50 * p[0] <= -100 * s[0] <= -95 * p[0]][:k]
            out += [(a[0], name(p), rank, name(s), -p[0], -s[0]) for rank, s in enumerate(found, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(n=400, dims=6, seed=1, labels=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rng.choice((-1.0, 0.0, 1.0)) for _ in range(dims)]
        rows.append((i, [b + rng.choice((0.0, 0.0, 0.25, 0.1)) for b in base], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("blocks", [(1 << 14, 1 << 15), (3, 17)])
def test_by_brute_force(spark, blocks):
    rows = table()  # coarse values: many equal scores
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert len(want) > 20
    assert found(H.mine(df, anchor_block=blocks[0], row_block=blocks[1])) == want


def test_odd_rows(spark):
    rows = table(160, labels=2)
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] + [0.0] * 5, 1), (204, [1.0] * 6, None)]
    rows += [(None, [1.0, 1.0, 0.0, 0.0, 1.0, 0.0], 0), (None, [1.0, 1.0, 0.0, 0.0, 1.0, 0.0], 1)]  # no id
    rows += [(250, [], 0), (251, [], 1), (252, [], 0), (300, [1.0, 2.0], 1), (301, [1.0, 2.0], 1), (302, [0.9, 1.5], 0)]  # other lengths
    rows += [rows[50], rows[51], rows[51], rows[100]]  # repeated rows, anchors among them
    rows += [(350, [3e38, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (351, [-3e38, 1.0, 0.0, 0.0, 0.0, 0.0], 0)]  # held at a bound
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "anchor", "rank", "score", "ab", "rb", "p", "positive")])
    assert found(H.mine(clash)) == brute(rows)
    assert H.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.mine(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).count() == 0
    assert [f.dataType.simpleString() for f in H.mine(df).schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_large_integers_are_exact():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-H.MOST, H.MOST, (3, 20)), rng.integers(-H.MOST, H.MOST, (4, 20))
    assert H.inner_products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
