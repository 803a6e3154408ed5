import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import fair_mix as M

from .fixtures import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[k % 3]) for k, s in enumerate(names)}
    left, open_, got = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not over:
            return got | {s: level * w[s] for s in open_}
        for s in over:
            got[s] = float(epochs * sizes[s])
            left -= got[s]
        open_ -= over
    return got


def brute(rows):
    sizes, queue = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        queue[s].append((hashlib.md5(f"{'' if i is None else i}:7".encode()).hexdigest(), (i is None, i or 0), n, i))
    out = Counter()
    aim = targets(sizes)
    for s, q in queue.items():
        start = 0
        for _, _, n, i in sorted(q):
            taken = sum(max(0, min(n, math.floor(aim[s]) - e * sizes[s] - start)) for e in range(2))
            out[i, n, sizes[s], round(aim[s], 6), taken] += 1
            start += n
    return out


def results(df):
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


def test_brute_force(spark, sf):
    rows = documents()
    assert results(M.mix(frame(spark, clash=True))) == brute([(r[0], r[1], r[3]) for r in rows])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = results(M.mix(docs))
    assert got == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    by_source = M.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in by_source)


def test_entries_are_sorted_and_add_up(spark):
    mixed = M.mix(frame(spark)).cache()
    rows = M.entries(mixed).collect()
    assert [r["virtual_finish"] for r in rows] == sorted(r["virtual_finish"] for r in rows)
    assert sum(r["taken_words"] for r in rows) == sum(r["taken"] for r in mixed.collect())
    assert all(r["virtual_start"] < 1 for r in rows)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 3, None: 5}, {"a": 0, "b": 0}, {"a": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_empty_table(spark):
    assert M.mix(frame(spark, [])).count() == 0
    assert M.entries(M.mix(frame(spark, []))).count() == 0
