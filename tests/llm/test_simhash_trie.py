import random
import re
from collections import Counter

import numpy as np
import xxhash

from palimpsest.llm import simhash_trie as S
from palimpsest.operators.graph import star_roots

from .fixtures import documents, frame


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """By brute force: place -> class root."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(prints))]


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = classes(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True))


def test_brute_force(spark, sf):
    assert Counter(map(tuple, S.near_duplicates(frame(spark, clash=True)).collect())) == brute([(r[0], r[1]) for r in documents()])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(map(tuple, S.near_duplicates(docs).collect()))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_links_connect_all_near_pairs_also_in_cut_groups(spark):
    rng = random.Random(3)
    keys = {rng.getrandbits(64) for _ in range(150)}
    for k in list(keys)[:40]:
        for _ in range(6):
            k ^= 1 << rng.randrange(64)  # chains
            keys.add(k)
    keys |= {0, 1, 3, (1 << 64) - 1}
    keys |= {(5 << 48) | rng.getrandbits(6) for _ in range(40)}
    keys = sorted(keys)
    roots = classes(keys)
    want = {}
    for k, r in zip(keys, roots, strict=True):
        want.setdefault(r, set()).add(k)
    df = spark.createDataFrame([(int(np.uint64(k).astype(np.int64)),) for k in keys], "fingerprint long")
    for above in (10**6, 2):
        found = {}
        for r in star_roots(S.links(df, split_above=above)).collect():
            found.setdefault(r["root"], {r["root"]}).add(r["node"])
        got = {frozenset(x % (1 << 64) for x in g) for g in found.values()}
        assert got == {frozenset(g) for g in want.values() if len(g) > 1}


def test_trie_pairs_are_exactly_the_near_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(40))
    n = np.array([0]), np.array([len(keys)])
    got = {tuple(sorted(p)) for a, b in S.trie_pairs(keys, n[0], n[1], n[0], n[1], np.array([0]), 0) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(a, b) for b in range(len(keys)) for a in range(b) if (int(keys[a]) ^ int(keys[b])).bit_count() <= 3}


def test_one_of_each_class_survives(spark):
    docs = frame(spark, clash=True)
    kept = S.survivors(docs)
    assert kept.dtypes == docs.dtypes
    rows = [(r[0], r[1]) for r in documents()]
    assert kept.count() == len(set(classes([fingerprint(t) for _, t in rows])))
    assert {r[0] for r in kept.select("doc_id").collect()} >= {1, 9, 12}


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    assert S.survivors(frame(spark, [])).count() == 0
