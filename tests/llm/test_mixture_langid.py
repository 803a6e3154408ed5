import zlib

import numpy as np
import pytest

from palimpsest.llm import mixture_langid as L

from .fixtures import documents, frame


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and len(r["text"]) > 20]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    one = {lang: next(r["text"] for r in rows if r["lang"] == lang and 1500 < len(r["text"]) < 4000) for lang in ("en", "de", "fr")}
    mixed = spark.createDataFrame([(1, one["en"][:1000] + " " + one["de"][:1000]), (2, one["fr"]), (3, one["en"][:1400] + " " + one["fr"][:500])], "doc_id long, text string")
    m = {r["doc_id"]: r for r in L.identify(mixed, model).collect()}
    assert set(m[1]["languages"]) == {"en", "de"} and m[2]["languages"] == ["fr"] and m[2]["score"] == 1.0
    assert m[3]["languages"][:2] == ["en", "fr"] and m[3]["score"] == pytest.approx(0.72, abs=0.12)


def test_em_reaches_the_best_proportions():
    rng = np.random.default_rng(1)
    p, n = rng.random((2, 30)), rng.integers(1, 9, 30).astype(float)
    share, value = L.proportions(p, n, steps=500)
    grid = max(float(n @ np.log(np.array([a, 1 - a]) @ p)) for a in np.linspace(0, 1, 2001))
    assert value == pytest.approx(grid, abs=1e-2) and share.sum() == pytest.approx(1)


def test_edges(spark):
    docs = frame(spark, clash=True)
    model = L.train(docs)
    assert model.languages == sorted(x for x in {r[2] for r in documents()} if x and x != "xx") or "xx" in model.languages
    rows = L.identify(docs, model).collect()
    assert len(rows) == len(documents())
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {4, 5, 6, 8} <= und and 7 not in und
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = L.accepted(docs, model)
    assert kept.dtypes == docs.dtypes and 1 in {r[0] for r in kept.select("doc_id").collect()}
    assert not {4, 5, 6, 8} & {r[0] for r in kept.select("doc_id").collect()}
    assert {r["lang_pred"] for r in L.identify(docs, L.train(docs.where("false"))).collect()} == {"und"}
    assert L.identify(frame(spark, []), model).count() == 0


def test_the_sample_is_bounded_per_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs, train_docs=40)
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95


def plain_trigrams(text):
    """Buckets of byte trigrams of the folded text, by the letter."""
    out = []
    data = bytearray(text.encode())
    for k, b in enumerate(data):
        if 0x41 <= b <= 0x5A:
            data[k] = b + 32
        elif b < 0x80 and not 0x61 <= b <= 0x7A:
            data[k] = 32
        elif k and 0x80 <= b <= 0x9E and b != 0x97 and data[k - 1] == 0xC3:
            data[k] = b + 32
    padded = " " + "".join(map(chr, data)) + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    for k in range(len(padded) - 2):
        a, b, c = map(ord, padded[k : k + 3])
        out.append(((a << 16 | b << 8 | c) * 0x9E3779B1 % (1 << 32)) >> (32 - L.BITS))
    return out


def test_prediction_by_brute_force(spark):
    """Learning and choosing anew with plain loops: counts by language, likelihoods, mixtures on a grid of steps."""
    docs = frame(spark)
    rows = [(r[0], r[1], r[2]) for r in documents()]
    counts = {}
    for i, text, lang in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            own = counts.setdefault(lang, [L.SMOOTHING] * L.BUCKETS)
            for g in plain_trigrams(text or ""):
                own[g] += 1
    languages = sorted(counts)
    logs = [[float(np.log(x / sum(counts[lang]))) for x in counts[lang]] for lang in languages]

    def predict(text):
        grams = plain_trigrams(text)
        value = lambda share: sum(np.log(sum(s * np.exp(logs[k][g]) for k, s in share.items())) for g in grams)
        chosen = {max(range(len(languages)), key=lambda k: (value({k: 1.0}), -k)): 1.0}
        best = value(chosen)
        price = L.PENALTY * 0.5 * np.log(max(2, len(grams)))
        while len(chosen) < len(languages):
            mixed = [sum(s * np.exp(logs[k][g]) for k, s in chosen.items()) for g in grams]
            pull = {k: sum(np.exp(logs[k][g]) / m for g, m in zip(grams, mixed, strict=True)) for k in range(len(languages)) if k not in chosen}
            more = max(pull, key=lambda k: (pull[k], -k))
            if pull[more] <= len(grams):
                break
            share = dict.fromkeys([*chosen, more], 1 / (len(chosen) + 1))
            for _ in range(L.STEPS):
                new = dict.fromkeys(share, 0.0)
                for g in grams:
                    parts = {k: s * np.exp(logs[k][g]) for k, s in share.items()}
                    for k in parts:
                        new[k] += parts[k] / sum(parts.values()) / len(grams)
                done = max(abs(new[k] - share[k]) for k in share) < 1e-4
                share = new
                if done:
                    break
            if value(share) - best <= price:
                break
            chosen, best = share, value(share)
        top = min(chosen, key=lambda k: (-chosen[k], k))
        return languages[top], chosen[top]

    got = L.identify(docs, L.train(docs)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, want in ((r, rows_of) for r in got for rows_of in [[t for i, t, _ in rows if i == r["doc_id"]]]):
        text = want[0]
        if r["doc_id"] is None or len(set(want)) > 1 or len(text or "") > 3000:
            continue
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        if text not in by_text:
            by_text[text] = predict(text)
        assert r["lang_pred"] == by_text[text][0] and r["score"] == pytest.approx(by_text[text][1], abs=1e-6), text
    assert len(by_text) > 50
