import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from palimpsest.llm import bbit_minhash as B
from palimpsest.llm import queries as Q

from .fixtures import SCHEMA, documents, frame


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([" ".join(w)]) if w else frozenset())


def brute(rows, percent=85):
    """(id, n, component, kept) by all pairs; rows (id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by_size = sorted((len(s), k) for k, s in enumerate(sets) if s)
    for y, (n, j) in enumerate(by_size):
        for x in range(y - 1, -1, -1):
            m, i = by_size[x]
            if 100 * m < percent * n:
                break
            a, b = sets[i], sets[j]
            common = len(a & b)
            if 100 * common >= percent * (n + m - common):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    least = {}
    for k, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(k)] = min(id_, least.get(find(k), id_))
    return sorted(((i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(seed=3, groups=14, edits=(0, 1, 2, 3, 5, 9)):
    """Texts, their copies with word edits around the similarity, and a chain whose ends are far apart."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((2, 3, 20, 90, 300)))]
        texts.append(" ".join(base))
        for e in edits:
            new = list(base)
            for _ in range(e):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(100)]
    for k in range(6):
        texts.append(" ".join(chain[5 * k : 5 * k + 100]))
        chain += [word() for _ in range(5)]
    return texts


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [3, 1024])
def test_components_by_brute_force(spark, block):
    rng = random.Random(9)
    rows = [(k, t) for k, t in enumerate(edited())]
    # One large group in which the least id is far from most others, and many are linked by each other only.
    base = [str(k) for k in range(120)]
    for k in range(60):
        new = list(base)
        for _ in range(rng.randint(0, 5)):
            new[rng.randrange(120)] = f"x{rng.randrange(10)}"
        rows.append((1000 + k, " ".join(new)))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA).repartition(3)
    assert found(B.near_duplicates(df, block=block)) == brute(rows)


def test_odd_rows(spark):
    rows = documents()
    assert found(B.near_duplicates(frame(spark, clash=True))) == brute([r[:2] for r in rows])
    assert B.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text_ids = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", None), ("c", "u")], T.StructType([T.StructField("key", T.StringType()), T.StructField("body", T.StringType())]))
    assert found(B.near_duplicates(text_ids, "key", "body")) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("c", 1, "c", True)]


def test_given_documents_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(Q.queries()["op13_bbit_minhash"](spark, sf)) == brute(rows)


def test_minima_in_runs(monkeypatch):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    bounds = np.array([0, 1, 7, 2000, 4999, 5000])
    whole = np.stack([[(hashes[x:y] * m).min() for m in B._MULTIPLIERS] for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
    for run in (16, 1000, 1 << 15):
        monkeypatch.setattr(B, "RUN", run)
        assert (B.minima(hashes, bounds) == whole).all()


def test_low_bits_estimate_the_similarity():
    rng = np.random.default_rng(2)
    errors, dropped = [], 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        b = a.copy()
        b[:32] = rng.integers(0, 1 << 63, 32, dtype=np.uint64)  # 368 of 432: 0.852
        _, packed = B.signature(B.minima(np.concatenate([a, b]), np.array([0, 400, 800])))
        n = int(B.unlike(packed[:1], packed[1:])[0])
        errors.append(B.estimate(n) - 368 / 432)
        dropped += n > B.most_unlike()
    assert dropped == 0
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_very_long_text(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    near = list(base)
    for k in range(0, 300_000, 100):
        near[k] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:150_000]))]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    assert [(r.doc_id, r.component_id) for r in B.near_duplicates(df).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3)]
