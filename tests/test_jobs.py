"""How many jobs steps of a loop take: the driver plans each anew and keeps what it knows of its stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bbit_minhash, simhash_similar
from palimpsest.llm import set_links as S
from palimpsest.operators import needles as N
from palimpsest.operators.graph import star_roots
from palimpsest import runtime
from palimpsest.runtime import brief_shuffles


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = f()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("alone", [0, 65_536])
def test_few_links_take_few_jobs(spark, alone):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(300) if k % 50] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(120)] + [(5000, k) for k in range(5001, 5300)]
    root = {x: x for p in links for x in p}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
        if all(root[u] == root[v] for u, v in links):
            break
    edges = spark.createDataFrame(links, "u bigint, v bigint")
    found, n = jobs(spark, f"stars-{alone}", lambda: star_roots(edges, hub=64, alone=alone))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: r for x, r in root.items() if x != r}
    assert not alone or n <= 20


def test_bits_of_all_columns_are_two_small_actions(spark):
    rows = [(k * 7919 - 10**6, -k * 104729) for k in range(1000)]
    df = spark.createDataFrame(rows, "place bigint, set_key bigint")
    (places, keys), n = jobs(spark, "bits", lambda: S.bitmaps(df))
    for marks, column in ((places, 0), (keys, 1)):
        own = np.array([r[column] for r in rows])
        assert len(S.in_bitmap(own, marks)) == len(rows)
        assert np.bitwise_count(marks).sum() == len(set(np.mod(own, 64 * len(marks)).tolist()))
    assert n <= 4


def test_texts_of_plans_are_brief_within_loops(spark):
    before = spark.conf.get("spark.sql.maxPlanStringLength"), spark.conf.get("spark.sql.ui.explainMode")
    with brief_shuffles(spark):
        assert int(spark.conf.get("spark.sql.maxPlanStringLength")) <= 4096 and spark.conf.get("spark.sql.ui.explainMode") == "simple"
    assert (spark.conf.get("spark.sql.maxPlanStringLength"), spark.conf.get("spark.sql.ui.explainMode")) == before


def test_small_tables_are_planned_once(spark):
    names = ["spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage", "spark.sql.shuffle.partitions"]
    seen = lambda: [spark.conf.get(x) for x in names]
    before = seen()
    for rows, size, expected in [
        (0, 0, ["false", "false", "1"]),
        (4096, 0, ["false", "false", "1"]),
        (4097, 0, ["false", before[1], "2"]),
        (10, 33 << 20, ["false", before[1], "2"]),
        (16 * 4096, 0, ["false", before[1], str(min(16, int(before[2])))]),
        (16 * 4096 + 1, 0, before),
        (10, 1 << 30, before),
    ]:
        with runtime.planned_once(spark, rows, size):
            assert seen() == expected
        assert seen() == before


def test_plans_stay_adaptive_where_partitions_are_many(spark, monkeypatch):
    """A session may hold the number of partitions: what it holds is put together by adaptive plans only."""
    kind, put, held = type(spark.conf), type(spark.conf).set, "spark.sql.shuffle.partitions"
    before = spark.conf.get(held)
    spark.conf.set(held, "211")
    monkeypatch.setattr(kind, "set", lambda self, key, value: None if key == held else put(self, key, value))
    try:
        with runtime.planned_once(spark, 60_000):
            assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    finally:
        put(spark.conf, held, before)


@pytest.mark.parametrize(("name", "most"), [("simhash_similar", 60), ("bbit_minhash", 50)])
def test_near_dedup_of_a_small_table_takes_few_jobs(spark, name, most):
    """Copies by one word, so that full sets are asked for and links are followed."""
    rng = random.Random(7)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(60)]
    texts += [[*t[:60], "other", *t[61:]] for t in texts[:30]] + [[*t[:30], "again", *t[31:]] for t in texts[:20]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    if name == "bbit_minhash":
        found, n = jobs(spark, name, lambda: bbit_minhash.near_duplicates(docs, "doc_id", "text"))
        assert {r["doc_id"] for r in found.where("kept").collect()} == set(range(60))
    else:
        found, n = jobs(spark, name, lambda: simhash_similar.survivors(docs, also=docs))
        assert {r["doc_id"] for r in found.collect()} == set(range(60))
    assert n <= most, n


@pytest.mark.parametrize("piece", [1 << 16, 40])
def test_many_needles_are_one_pass(spark, monkeypatch, piece):
    """Passes over the texts don't grow with the needles."""
    monkeypatch.setattr(N, "PIECE", piece)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdü東𝄞", k=rng.randint(1, 9)))
    rows = [*((k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(120)), (200, None), (201, ""), (3, "abc"), (3, "abc")]
    docs = spark.createDataFrame(rows, "id long, text string")
    wanted = [*{(t or "")[:12] for _, t in rows}, *{(t or "")[-5:] for _, t in rows}, "a", "zzz", "bc", None]
    monkeypatch.setattr(N, "parts_of", lambda *_: pytest.fail("a pass for each part"))
    want = sorted((i, x) for i, t in rows for x in {x for x in wanted if x} if x in (t or ""))
    needles = spark.createDataFrame([(x,) for x in wanted], "x string")
    assert sorted((r["id"], r["needle"]) for r in N.hits(docs, needles, part_bytes=2000).collect()) == want
    assert sorted(r["needle"] for r in N.said(docs, needles, part_bytes=2000).collect()) == sorted({x for _, x in want})
    counted = N.tally(docs, needles, F.count("*").alias("n"), F.max("id").alias("last"), part_bytes=2000).collect()
    assert sorted((r["needle"], r["n"], r["last"]) for r in counted) == sorted((x, len(own), max(own)) for x in {x for _, x in want} for own in [[i for i, y in want if y == x]])
