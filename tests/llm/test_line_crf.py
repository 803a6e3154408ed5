import itertools
import math
import subprocess
import sys
import zlib

import numpy as np

from palimpsest.llm import line_crf as C

from .fixtures import documents, frame


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 5, 7, 13])
    score, stay = rng.normal(size=13) * 2, 0.7
    marginal, together, log_z = C.chains(score, first, stay)
    for d, (a, b) in enumerate(itertools.pairwise(first)):
        total, good, same = 0.0, np.zeros(b - a), np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(s for s, k in zip(score[a:b], y, strict=True) if k) + stay * sum(p == q for p, q in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
            same[1:] += w * np.array([p == q for p, q in itertools.pairwise(y)])
        assert np.allclose(marginal[a:b], good / total) and np.allclose(together[a:b], same / total) and np.isclose(log_z[d], math.log(total))


def test_gradient_raises_the_likelihood():
    rng = np.random.default_rng(3)
    first = np.arange(0, 301, 5)
    good = rng.integers(0, 2, 60)
    x = rng.normal(size=(300, C.WIDTH)) + 0.2 * np.repeat(good, 5)[:, None]
    model = C.fit(x, first, good, epochs=60)
    _, _, z = C.chains(x @ model.weights, first, model.stay)
    likelihood = (x @ model.weights * np.repeat(good, 5)).reshape(-1, 5).sum(1) + 4 * model.stay - z
    assert likelihood.mean() > 5 * math.log(0.5) / 2


def test_held_out_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = C.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in C.score(docs, model).collect()}
    rows = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == docs.count()
    pairs = [(a > b) + (a == b) / 2 for q, a in rows if q == 1 for p, b in rows if p == 0]
    assert sum(pairs) / len(pairs) > 0.97
    assert sum((s >= 0.3) == (q == 1) for q, s in rows) / len(rows) > 0.95


def test_edges(spark):
    docs = frame(spark, clash=True)
    labels = spark.createDataFrame([(100 + k, 1, 0) for k in range(40)] + [(9, 0, 0), (None, 1, 0), (12, None, 0), (7, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    rows = C.score(docs, C.train(docs, labels)).collect()
    assert len(rows) == len(documents()) and all(0 <= r["score"] <= 1 and r["n_lines"] >= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
    assert C.score(frame(spark, []), C.train(docs, labels)).count() == 0
    none = C.train(docs, labels.where("false"))
    assert {r["score"] for r in C.score(docs, none).collect()} == {1.0}


def test_score_by_brute_force(spark):
    """Marginals by enumeration over all labellings of short documents, weighted by the bytes of their lines."""
    docs = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(["One line.", "a b c\n\n### $$$ !!!\nGood words here, in a row.", "x\ny\nz\nx", "é ü\n日本語 words", None, ""])])
    rng = np.random.default_rng(5)
    model = C.Crf(rng.normal(size=C.WIDTH), 0.4, 0.5)
    for r in C.score(docs, model).collect():
        text = {d: t for d, t, *_ in [tuple(x) for x in docs.collect()]}[r["doc_id"]] or ""
        data = np.frombuffer(text.encode(), np.uint8)
        x, _, _ = C.line_features(data, np.array([0, len(data)]))
        lines = [len(line.encode()) for line in text.split("\n") if line.split()] or [1]
        s = x @ model.weights
        total, good = 0.0, np.zeros(len(lines))
        for y in itertools.product((0, 1), repeat=len(lines)):
            w = math.exp(sum(v for v, k in zip(s, y, strict=True) if k) + model.stay * sum(p == q for p, q in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
        assert r["n_lines"] == len(lines) and np.isclose(r["score"], (good / total) @ lines / sum(lines), atol=1e-5)


def test_the_sample_is_bounded_in_lines(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    long = spark.createDataFrame([(10**6 + k, "a line\n" * 5000) for k in range(20)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(long)
    marks = labels.select("doc_id", "quality").union(spark.createDataFrame([(10**6 + k, 0) for k in range(20)], "doc_id long, quality int"))
    one, other = C.train(docs, labels, train_lines=2000), C.train(both, marks, train_lines=2000)
    assert one.fitted and other.fitted and np.allclose(one.weights, other.weights)


def test_long_chains_by_steps():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 9, 10, 1000):
        for scale, stay in ((1, 0.4), (30, 3.0), (5, -2.0)):
            score = rng.normal(size=n) * scale
            odds = C.forward_odds(score, stay) + C.forward_odds(score[::-1], stay)[::-1] - score
            marginal, _, _ = C.chains(score, np.array([0, n]), stay)
            assert np.allclose(1 / (1 + np.exp(-np.clip(odds, -60, 60))), marginal, atol=1e-9)


def test_texts_of_many_lines_in_runs(spark):
    rng = np.random.default_rng(7)
    model = C.Crf(rng.normal(size=C.WIDTH) / 4, 0.6, 0.5)
    lines = ["x", "", "Some words, and more of them.", "### ||| !!!", "été 12 12", "x"]
    rows = [(k, "\n".join(rng.choice(lines, size=n)), "en", "s", 1) for k, n in enumerate((1, 5, 40, 300, 1000, 7))] + [(90, "\n" * 500, "en", "s", 1), (91, None, "en", "s", 1)]
    whole, runs = ({r["doc_id"]: r for r in C.score(frame(spark, rows), model, run_lines=n).collect()} for n in (10**6, 16))
    for k, r in whole.items():
        assert r["n_lines"] == runs[k]["n_lines"] and r["n_bad_lines"] == runs[k]["n_bad_lines"]
        assert np.isclose(r["score"], runs[k]["score"], atol=1e-6)


def test_memory_of_a_text_of_millions_of_lines():
    code = """
import resource, numpy as np
from palimpsest.llm import line_crf as C
model = C.Crf(np.random.default_rng(1).normal(size=C.WIDTH) / 4, 0.6, 0.5)
text = np.frombuffer(b"a\\nb\\nc\\nd\\n" * (20_000_000 // 8), np.uint8)
mean, n, bad = C.long_text(text, model, C.RUN_LINES)
assert n == 10_000_000 and 0 <= mean <= 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-500:]
    assert float(done.stdout) < 1000
