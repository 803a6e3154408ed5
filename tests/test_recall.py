"""Recall from the channels to the packed context, in plain Python beside the registered queries."""

import datetime as dt
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.operators import retrieval as V
from palimpsest.plans import QUERIES

NOW = dt.datetime(2024, 3, 1)


def toks(t):
    return [w for w in re.split("[^a-z]+", (t or "").lower()) if w]


def channels(spark, d):
    vec = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    rows = defaultdict(dict)
    for q, a in vec.items():
        if q % 50 == 0:
            scored = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), i) for i, b in vec.items() if i != q)[:20]
            for rank, (s, i) in enumerate(scored, 1):
                rows[q].setdefault(i, []).append((rank, -s))
    words = {i: Counter(toks(r["text"])) for i, r in docs.items()}
    size = {i: sum(c.values()) for i, c in words.items()}
    mean = sum(size.values()) / len(size)
    for item, text in bench.items():
        terms = set(toks(text))
        df = {t: sum(t in c for c in words.values()) for t in terms}
        score = {}
        for i, c in words.items():
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in terms if t in c)
            if any(t in c for t in terms):
                score[i] = s
        for rank, (s, i) in enumerate(sorted((-round(s, 9), i) for i, s in score.items())[:20], 1):
            rows[item * 50].setdefault(i, []).append((rank, -s))
    return rows, docs


def expected(rows, docs, diverse, budget=4000):
    out = {}
    for q, found in rows.items():
        items = []
        for i, hits in found.items():
            raw = sum(1 / (60 + rank) for rank, _ in hits)
            age = (NOW - (dt.datetime(2024, 1, 1) + dt.timedelta(hours=i))).total_seconds() / 86400
            items.append((raw * (1 + 0.3 * (math.exp(-0.01 * max(age, 0)) if i in docs else 0)), i))
        items = [(s, i) for s, i in sorted(items, key=lambda x: (-round(x[0], 12), x[1]))[:30] if i in docs]
        if diverse:
            sets = {i: set(toks(docs[i]["text"])) for _, i in items}
            picked, left = [], list(items)
            while left:
                near = lambda i: max((len(sets[i] & sets[p]) / max(len(sets[i]), 1) for _, p in picked), default=0.0)
                best = max(left, key=lambda x: (round(0.5 * x[0] - 0.5 * near(x[1]), 12), -items.index(x)))
                picked.append(best)
                left.remove(best)
            items = picked
        kept, used, tiers, heads = [], 0, Counter(), set()
        for s, i in items:
            text = docs[i]["text"]
            tier = "semantic" if docs[i]["lang"] == "en" else "episodic"
            tokens, head = len(text) // 4 + 1 + 5, text[:100].lower().strip(" ")
            if head in heads:
                continue
            heads.add(head)
            if tiers[tier] + tokens > {"semantic": 0.4, "episodic": 0.3}[tier] * budget:
                continue
            if used + tokens > budget:
                break
            kept.append((i, round(s, 6), tokens))
            used, tiers[tier] = used + tokens, tiers[tier] + tokens
        for k, (i, s, n) in enumerate(kept, 1):
            place = 1 if k == 1 else len(kept) if k == 2 else k - 1
            out[q, i] = (place, s, n)
    return out


@pytest.mark.parametrize("name,diverse", [("context_pack", False), ("mmr", True)])
def test_packed_context_by_hand(spark, sf, name, diverse):
    want = expected(*channels(spark, sf), diverse)
    got = {(r["query"], r["id"]): (r["place"], r["score"], r["tokens"]) for r in QUERIES[name](spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (place, score, n) in want.items():
        assert got[k][0] == place and got[k][2] == n and got[k][1] == pytest.approx(score, abs=2e-6)


def test_knn_by_blocks_and_ids_of_any_type(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{k:02}", "ab"[k % 2], [float(x) for x in rng.normal(size=4)]) for k in range(30)] + [("none", "a", None)]
    items = spark.createDataFrame(rows, "id string, g string, embedding array<double>")
    asked = items.where("id < 'i08' or id = 'none'").withColumnRenamed("id", "query")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v}
    group = {i: g for i, g, _ in rows}
    for within in (None, "g"):
        want = {}
        for q in sorted(unit)[:8]:
            scored = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q and (within is None or group[i] == group[q]))[:3]
            want |= {(q, i): k for k, (_, i) in enumerate(scored, 1)}
        for block, item_block in ((2048, 1 << 16), (3, 7)):
            got = V.knn(asked, items, 3, within=within, block=block, item_block=item_block).collect()
            assert {(r["query"], r["id"]): r["rank"] for r in got} == want
    assert V.knn(asked.where("false"), items, 3).count() == 0 and V.knn(asked, items.where("false"), 3).count() == 0


def test_second_questions_are_those_of_the_scalar_form(spark):
    cases = [("alpha beta gamma delta", [0.01]), ("short one", [0.01]), ("a vs the rest", [0.9]), ("plain words", [0.9]), ("this and that", [0.9] * 3), ("nothing", [])]
    q = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "query int, text string")
    found = spark.createDataFrame([(k, float(s)) for k, (_, ss) in enumerate(cases) for s in ss], "query int, score double")
    got = {r["query"]: r["text"] for r in V.follow_up_queries(q, found).collect()}
    assert got == {k: f for k, (t, ss) in enumerate(cases) if (f := V.follow_up(t, sorted(ss, reverse=True)))}
