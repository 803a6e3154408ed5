"""Indexes of vectors and texts, and needles, against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from palimpsest.operators import graph as G
from palimpsest.operators import needles as N
from palimpsest.operators import retrieval as R
from palimpsest.operators import text_index as T
from palimpsest.operators import vector_index as V
from palimpsest.operators import words as W
from palimpsest.runtime import exists


def vectors(spark, n=300, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims)) * 2
    rows = [(k, f"s{k % 3}", (centers[k % 12] + rng.normal(size=dims)).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, scope string, embedding array<double>")


def nearest(rows, asked, k, same=False, least=-2.0):
    m = np.array([r[2] for r in rows])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    out = []
    for q in asked:
        s = np.round(m @ m[q], 9)
        best = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != q and s[j] >= least and (not same or rows[j][1] == rows[q][1]))[:k]
        out += [(rows[q][0], i, r) for r, (_, i) in enumerate(best, 1)]
    return sorted(out)


def found(df):
    return sorted((r["query"], r["id"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("part,block", [(1 << 14, 2048), (7, 5)])
def test_exact_search(spark, part, block):
    rows, df = vectors(spark)
    index = V.write_index(df, n_cells=14, part=part)
    asked = df.where("id % 25 = 0").select(F.col("id").alias("query"), "scope", "embedding")
    ids = range(0, 300, 25)
    assert found(V.search(index, asked, 6, block=block)) == nearest(rows, ids, 6)
    assert found(V.search(index, asked, 6, least=0.6, block=block)) == nearest(rows, ids, 6, least=0.6)
    assert found(V.search(index, asked, 6, block=block, probes=14)) == nearest(rows, ids, 6)
    scoped = V.write_index(df, n_cells=14, within="scope", part=part)
    assert found(V.search(scoped, asked, 4, within="scope", block=block)) == nearest(rows, ids, 4, same=True)


def test_probes_give_recall_for_a_share_of_the_rows(spark):
    rows, df = vectors(spark, 2000, 6, seed=4)
    index = V.read_index(spark, V.write_index(df, n_cells=40).path)
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query"), "embedding")
    right = {x[:2] for x in nearest(rows, range(0, 2000, 10), 10)}
    assert {x[:2] for x in found(R.knn(asked, df, 10))} == right
    probes = V.calibrate(index, asked, 10, 0.95)
    got = {x[:2] for x in found(V.search(index, asked, 10, probes=probes))}
    assert len(got & right) >= 0.9 * len(right)
    assert probes <= 16 < 40
    few = V.search(index, asked, 10, probes=1)
    assert len({x[:2] for x in found(few)} & right) < len(right)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (6, [1.0, 1.0]), (7, [1.0]), (None, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for n in (None, 3):
        index = V.write_index(df, n_cells=n)
        got = V.search(index, df.select(F.col("id").alias("query"), "embedding"), 9)
        assert sorted((r["query"], r["id"], round(r["score"], 3)) for r in got.collect() if r["query"] == 1) == [(1, 2, 0.0), (1, 6, 1.0)]
        assert {r["query"] for r in got.collect()} == {1, 2, 6}
    empty = V.write_index(df.where("false"))
    assert V.search(empty, df.select(F.col("id").alias("query"), "embedding"), 3).count() == 0


def test_forest_connects_what_a_matrix_links():
    rng = np.random.default_rng(3)
    for _ in range(20):
        near = rng.random((9, 11)) < 0.12
        i, j = V.forest(near)
        root = list(range(20))
        for a, b in zip(*np.nonzero(near), strict=True):
            while root[a] != root[9 + b]:
                low, high = sorted((root[a], root[9 + b]))
                root = [low if r == high else r for r in root]
        for a in range(9):
            assert (i[a] < 0) == (not near[a].any())
            if i[a] >= 0:
                assert root[a] == root[9 + i[a]]
        for x in range(11):
            for y in range(11):
                if j[x] >= 0 and j[y] >= 0:
                    assert (j[x] == j[y]) == (root[9 + x] == root[9 + y])


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def texts(n=400, seed=2):
    """Some words are in nearly all texts, others in few."""
    rng = random.Random(seed)
    weights = [1 / (k + 1) ** 1.5 for k in range(len(WORDS))]
    return [(k, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 30)))) for k in range(n)]


def queries(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.sample(WORDS, rng.randint(1, 8)))) for k in range(40)]
    return spark.createDataFrame([*rows, (90, ""), (91, "unheard"), (92, "alpha unheard"), (93, None)], "query long, text string")


@pytest.mark.parametrize("block", [4, 256])
def test_ranked_search_is_exact(spark, block):
    docs = spark.createDataFrame([*texts(), (1000, None), (1001, "Alpha, TAU!")], "id long, text string")
    index = T.read_index(spark, T.write_index(docs, block=block).path)
    asked = queries(spark)
    plain = lambda df: sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert plain(T.search(index, asked, 7)) == plain(R.bm25(docs, asked, 7, all_terms=False))
    assert plain(T.search(index, asked, 7, all_terms=True)) == plain(R.bm25(docs, asked, 7))
    assert plain(T.channel(index, asked, 5)) == plain(R.sparse_channel(docs, asked, 5))


def test_ranked_search_opens_few_postings(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["the"] * rng.randint(1, 3) + ["of"] * rng.randint(0, 2) + ["and"] + [f"w{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(20)])) for k in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(q, "the of and " + " ".join(rows[q][1].split()[-4:])) for q in range(20)], "query long, text string")
    # Blocks that are small beside the table, as those of a large one are.
    index = T.write_index(docs, block=8)
    opened, every = T.opened_postings(index, asked, 10)
    assert opened * 3 <= every
    plain = lambda df: sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert plain(T.search(index, asked, 10)) == plain(R.bm25(docs, asked, 10, all_terms=False))


def test_matches_as_for_one_query(spark):
    from palimpsest.functions.text import web_match

    docs = spark.createDataFrame([*texts(150), (500, None), (501, "")], "id long, text string")
    asked = [(1, "alpha"), (2, '"beta alpha"'), (3, "gamma or delta -alpha"), (4, "-alpha"), (5, ""), (6, 'alpha "unheard"'), (7, "or alpha"), (8, "epsilon or -beta"), (9, '"alpha alpha" beta'), (10, "alpha or beta or gamma -zeta -eta"), (11, "unheard")]
    got = {}
    for r in T.match(T.write_index(docs, block=8), spark.createDataFrame(asked, "query long, text string")).collect():
        got.setdefault(r["query"], []).append(r["id"])
    for q, text in asked:
        assert sorted(got.get(q, [])) == sorted(r["id"] for r in docs.where(web_match(F.col("text"), text)).collect()), text


@pytest.mark.parametrize("part_bytes", [8 << 20, 200])
def test_needles(spark, part_bytes):
    rows = [*texts(60), (70, None), (71, ""), (72, "ünïcode tau"), (72, "ünïcode tau")]
    docs = spark.createDataFrame(rows, "id long, text string")
    wanted = ["alpha", "a", "ta eta", "ïco", "zzz", "", None, "alpha", "omicron"]
    needles = spark.createDataFrame([(x,) for x in wanted], "x string")
    want = sorted((i, n) for i, t in rows for n in {x for x in wanted if x} if n in (t or ""))
    assert sorted((r["id"], r["needle"]) for r in N.hits(docs, needles, part_bytes=part_bytes).collect()) == want
    assert {r["needle"] for r in N.said(docs, needles, part_bytes=part_bytes).collect()} == {n for _, n in want}
    assert all(sum(len(x.encode()) + N.OVERHEAD for x in p) <= 200 for p in N.parts_of(needles, 200))
    assert N.hits(docs, needles.where("false")).count() == 0


def test_the_best_in_tiles_are_those_of_all_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    q, t = V.unit(rng.normal(size=(37, 8))), V.unit(rng.normal(size=(90, 8)))
    t[50:60] = t[:10]  # ties go to the first
    t[70] = np.nan
    want = [(i, j) for i in range(37) for j in np.lexsort((np.arange(90), -np.round(np.where(np.isnan(q[i] @ t.T), -np.inf, q[i] @ t.T), 9)))[:5]]
    for tile in (90, 500, 1 << 20):
        monkeypatch.setattr(V, "TILE", tile)
        i, j, score = V.best(q, t, 5, lambda score, at: None)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
        assert np.allclose(score, (q[i] * t[j]).sum(axis=1))


def test_a_group_never_holds_all_of_its_scores():
    rng = np.random.default_rng(4)
    table = lambda name, n: pa.table({name: np.arange(n) + (n == 512) * 100_000, "v": list(rng.normal(size=(n, 16)))})
    q, t = table("query", 512), table("id", V.PART)
    tracemalloc.start()
    try:
        out = V._best(10, None, None)(q, t)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == 5120
    assert peak < 512 * V.PART * 8, peak  # one matrix of scores; it was several


def test_pairs_that_are_alike_by_groups(spark):
    rng = np.random.default_rng(5)
    v = V.unit(rng.normal(size=(120, 6)))
    rows = spark.createDataFrame([(k, k % 3, v[k].tolist()) for k in range(120)], "id long, scope int, v array<double>")
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if a % 3 == b % 3 and v[a] @ v[b] >= 0.5}
    got = G.alike(rows, 0.5).collect()
    assert {(r["lo"], r["hi"]) for r in got} == want and len(got) == len(want)


def test_an_index_of_many_words_keeps_no_second_copy(spark):
    docs = spark.createDataFrame([(k, " ".join(chr(97 + (k + j) % 26) * (1 + j % 7) for j in range(60))) for k in range(3000)], "id long, text string").coalesce(1)
    index = T.write_index(docs)
    assert not exists(spark, f"{index.path}/postings")
    # More rows than a task holds at once: all of them arrive, in one block each.
    held = {(r["term"], r["block"]): r["n"] for r in index.blocks().collect()}
    assert len(held) == index.blocks().count()
    want = W.word_counts(docs).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in want} == {r["term"]: r["df"] for r in index.terms().collect()}
    assert sum(held.values()) == sum(len(set(r["text"].split())) for r in docs.collect()) > 1 << 16


def exchanged(spark, f):
    """What f gives, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    out = f()
    return out, written() - before


def test_texts_travel_once_and_only_the_best_of_a_task_after_that(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["the", "of", "and"] + rng.choices("abcdefghijklmnopqrstuvwxyz", k=3) + [f"w{''.join(rng.choices('abcdef', k=3))}" for _ in range(30)])) for k in range(2000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4).cache()
    docs.count()
    asked = spark.createDataFrame([(q, "the of and a b " + rows[q][1].split()[-1]) for q in range(20)], "query long, text string").coalesce(1)
    index, n = exchanged(spark, lambda: T.write_index(docs, block=16))
    # A row of each text, and of each term of each task; there are 62,000 postings.
    terms = index.terms().count()
    assert 2000 <= n <= 2100 + 8 * terms, n
    found, n = exchanged(spark, lambda: T.search(index, asked, 10).collect())
    # All texts hold words of each query: 40,000 candidates.
    assert len(found) == 200 and n < 6000, n
    strict, n = exchanged(spark, lambda: T.channel(index, asked, 10).collect())
    assert n < 12_000, n
    plain = lambda rows: sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in rows)
    assert plain(found) == plain(R.bm25(docs, asked, 10, all_terms=False).collect())
    assert plain(strict) == plain(R.sparse_channel(docs, asked, 10).collect())


def test_many_queries_are_asked_in_several_passes(spark, monkeypatch):
    docs = spark.createDataFrame([*texts(300), (7, "alpha tau"), (None, "alpha mu")], "id long, text string")
    index = T.write_index(docs, block=32)
    want = {x: sorted(map(tuple, T.search(index, queries(spark), 6, all_terms=x).collect()), key=repr) for x in (False, True)}
    monkeypatch.setattr(T, "ASKED", 50)
    monkeypatch.setattr(T, "BESIDE", 3)
    for x in (False, True):
        assert sorted(map(tuple, T.search(index, queries(spark), 6, all_terms=x).collect()), key=repr) == want[x] != []


def test_where_all_ask_each_row_travels_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 256)
    monkeypatch.setattr(V, "CELL_ROWS", 16)
    n = 3000
    v = V.unit(np.random.default_rng(7).normal(size=(n, 48)))  # bounds rule out next to nothing
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "id long, embedding array<double>").cache()
    found, sent = exchanged(spark, lambda: V.nearest(rows.withColumnRenamed("id", "query"), rows, 1).collect())
    # To cells of 16 rows each went 188 times, whatever the table.
    assert sent <= n * 100, sent
    score = v @ v.T
    np.fill_diagonal(score, -1)
    assert {r["query"]: r["id"] for r in found} == dict(enumerate(score.argmax(axis=1).tolist()))


def test_pairs_that_meet_from_one_side(spark):
    v = V.unit(np.random.default_rng(8).normal(size=(600, 5)))
    # Of two scopes the second has no cells; null vectors and repeated ids are in it too.
    rows = [(k, int(k >= 560), v[k].tolist()) for k in range(600)] + [(3, 0, v[3].tolist()), (700, 0, None)]
    df = spark.createDataFrame(rows, "id long, scope int, v array<double>").cache()
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("same", BooleanType())])

    def judge(left, right):
        score = V.unit(V.matrix(left["v"])) @ V.unit(V.matrix(right["v"])).T if left.num_rows and right.num_rows else np.zeros((0, 0))
        i, j = np.nonzero(score >= 0.5)
        same = left["own"].to_numpy()[i] == right["own"].to_numpy()[j] if "own" in left.schema.names else np.ones(len(i), bool)
        return pa.table({"a": left["query"].to_numpy()[i], "b": right["id"].to_numpy()[j], "same": same})

    both, all_sent = exchanged(spark, lambda: V.threshold_join(df, 0.5, judge, schema, part=64).collect())
    once, sent = exchanged(spark, lambda: V.threshold_join(df, 0.5, judge, schema, part=64, once=True).collect())
    assert {(r["a"], r["b"]) for r in both} == {(x, y) for r in once for x, y in ((r["a"], r["b"]), (r["b"], r["a"]))}
    assert any(not r["same"] for r in once) and sent < 0.8 * all_sent, (sent, all_sent)
    across = [(r["a"], r["b"]) for r in once if not r["same"] and 3 not in (r["a"], r["b"])]
    assert len(across) == len({(min(p), max(p)) for p in across})
