"""The whole recall on a small store, by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import recall as P

NOW = datetime.datetime(2024, 6, 1)


def day(k):
    return NOW - datetime.timedelta(days=k)


MEMORIES = [
    # id, scope, status, tier, content, episode, from, to, vector
    (1, "u", "canonical", "semantic", "green tea is kept in the cellar", 1, day(10), None, [1.0, 0.0]),
    (2, "u", "canonical", "episodic", "coffee beans", 2, day(100), None, [0.9, 0.1]),
    (3, "u", "hypothesis", "semantic", "green tea may be black", 3, day(1), None, [1.0, 0.1]),
    (4, "u", "canonical", "semantic", "green tea of long ago", 4, day(300), day(200), [1.0, 0.0]),
    (5, "v", "canonical", "semantic", "green tea of another scope", 5, day(5), None, [1.0, 0.0]),
    (6, "u", "canonical", "semantic", "only the graph leads here", 6, day(5), None, None),
]


@pytest.fixture(scope="module")
def store(spark):
    memories = spark.createDataFrame(MEMORIES, "id long, scope string, status string, tier string, content string, episode long, valid_from timestamp_ntz, valid_to timestamp_ntz, embedding array<double>")
    facts = spark.createDataFrame([(101, "u", "likes", "Green Tea", 0.9), (102, "v", "likes", "green tea", 0.8), (103, "u", "green", "tea", 0.7)], "id long, scope string, predicate string, object string, confidence double")
    entities = spark.createDataFrame([(1001, 1, "canonical"), (1002, 6, "canonical"), (1003, 2, "hypothesis")], "id long, episode long, status string")
    edges = spark.createDataFrame([(1001, 1002)], "src long, dst long")
    return P.Store(memories, facts, entities, edges)


def asked(spark, text="green tea", vector=(1.0, 0.0)):
    return spark.createDataFrame([(7, "u", text, list(vector))], "query long, scope string, text string, embedding array<double>")


def rrf(*ranks, age=None, divergent=False):
    r = 1.0 if age is None else math.exp(-0.01 * age)
    r = 1 - r + 0.01 if divergent else r
    return sum(1 / (60 + k) for k in ranks) * (1 + 0.3 * r)


def test_candidates(spark, store):
    got = {r["id"]: r for r in P.candidates(store, asked(spark), F.lit(NOW)).collect()}
    # Memory 1 by all of vector, words and graph (its own episode); 2 by vector only; fact 101 by its object; 6 by the graph only. 3 is a hypothesis, 4 over, 5 of another scope.
    assert set(got) == {1, 2, 6, 101}
    assert got[1]["fused_score"] == pytest.approx(rrf(1, 1, age=10)) and set(got[1]["signals"]) == {"dense", "sparse", "graph"}
    assert got[2]["fused_score"] == pytest.approx(rrf(2, age=100)) and set(got[2]["signals"]) == {"dense"}
    assert got[101]["fused_score"] == pytest.approx(rrf(1)) and got[101]["signals"] == {"entity": 0.9} and got[101]["score"] == 0.9
    assert got[6]["fused_score"] == 0 and got[6]["signals"] == {"graph": 0.5}
    assert [i for i, _ in sorted(((i, r["place"]) for i, r in got.items()), key=lambda x: x[1])] == [1, 101, 2, 6]


def test_divergent_takes_what_is_supposed_and_prefers_the_old(spark, store):
    got = {r["id"]: r for r in P.candidates(store, asked(spark), F.lit(NOW), "divergent", rounds=0).collect()}
    assert 3 in got
    assert got[2]["fused_score"] == pytest.approx(rrf(3, age=100, divergent=True))


def test_second_round_where_nothing_is_found(spark, store):
    nothing = spark.createDataFrame([(7, "u", "unheard of words and coffee", None)], "query long, scope string, text string, embedding array<double>")
    assert {r["id"] for r in P.candidates(store, nothing, F.lit(NOW), "fast").collect()} == {2}  # any word will do
    none = spark.createDataFrame([(7, "u", "unheard", None)], "query long, scope string, text string, embedding array<double>")
    assert P.candidates(store, none, F.lit(NOW), "fast").count() == 0
    embed = lambda text: F.when(F.contains(text, F.lit("details")), F.array(F.lit(0.0), F.lit(1.0)))
    more = P.candidates(store, none, F.lit(NOW), "fast", rounds=1, embed=embed)
    assert sorted((r["id"], set(r["signals"]) == {"dense"}) for r in more.collect()) == [(1, True), (2, True)]


def test_recall_packs_to_the_budget(spark, store):
    every = P.recall(store, asked(spark), F.lit(NOW)).collect()
    assert {(r["id"], r["place"]) for r in every} == {(1, 1), (2, 2), (6, 3), (101, 4)}  # best first, second best last
    few = P.recall(store, asked(spark), F.lit(NOW), budget=60).collect()
    assert {r["id"] for r in few} < {r["id"] for r in every} and sum(r["tokens"] for r in few) <= 60
    assert P.recall(store, asked(spark), F.lit(NOW), "divergent").count() >= 4
