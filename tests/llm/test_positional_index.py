import re
from collections import Counter

from palimpsest.llm import positional_index as P

from .fixtures import documents, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def toks(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    w = toks(text)
    hit, found = set(), set()
    for i, t in items:
        x = toks(t)
        n = min(window, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in wins:
                hit.update(range(k, k + n))
                found.add("" if i is None else str(i))
    return len(w), len(hit), len(found), tuple(sorted(found))


def items():
    d = documents()
    return [(7, " ".join(d[0][1].split()[5:30])), (71, "ONE... two"), (8, None), (9, "?!"), (10, " ".join(d[9][1].split()[100:110])), (10, "x"), (None, " ".join(d[30][1].split()[:3]))]


def results(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in df.collect())


def test_brute_force_in_one_and_many_parts(spark, sf):
    it = spark.createDataFrame(items(), "item_id long, text string")
    want = Counter((r[0], *brute(r[1], items())) for r in documents())
    assert results(P.decontaminate(frame(spark, clash=True), it)) == want
    assert results(P.decontaminate(frame(spark), it, max_part_bytes=150)) == want
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = results(P.decontaminate(docs, bench))
    assert got == Counter((r["doc_id"], *brute(r["text"], rows)) for r in docs.collect())
    assert sum(k[2] > 0 for k in got) > 0


def test_index_table_gives_every_phrase(spark, tmp_path):
    docs, it = frame(spark), spark.createDataFrame(items(), "item_id long, text string")
    P.build_index(docs).write.parquet(f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    got = Counter(map(tuple, P.phrase_matches(stored, it).collect()))
    assert got == Counter(map(tuple, P.phrase_matches(P.build_index(docs), it).collect()))
    want = set()
    for i, t, *_ in documents():
        w = toks(t)
        for item, phrase in items():
            x = toks(phrase)
            n = min(10, len(x))
            want |= {(i, "" if item is None else str(item), k, n) for k in range(len(w) - n + 1) for j in range(len(x) - n + 1) if n and w[k : k + n] == x[j : j + n]}
    assert set(got) == want


def test_contamination_in_flight_agrees(spark):
    docs, it = frame(spark, clash=True), spark.createDataFrame(items(), "item_id long, text string")
    for size in (P.MAX_PART_BYTES, 150):
        rows = P.contamination(docs, it, into="__c", max_part_bytes=size)
        assert rows.columns == [*docs.columns, "__c"]
        got = Counter((r["doc_id"], r["__c"]["n_words"], sum(s["end"] - s["start"] for s in r["__c"]["spans"]), len(r["__c"]["items"]), tuple(r["__c"]["items"])) for r in rows.collect())
        assert got == results(P.decontaminate(docs, it))


def test_proximity(spark):
    docs = frame(spark, [(1, "red big fox ran", "en", "a", 1), (2, "red fox", "en", "a", 1), (3, "fox red", "en", "a", 1), (4, "red a b c fox", "en", "a", 1)])
    it = spark.createDataFrame([(1, "Red Fox")], "item_id long, text string")
    index = P.build_index(docs)
    assert {r["doc"] for r in P.phrase_matches(index, it).collect()} == {2}
    assert {(r["doc"], r["n_words"]) for r in P.proximity_matches(index, it, slop=2).collect()} == {(1, 3), (2, 2)}
    # However far apart they may be, they stand in one document.
    assert {(r["doc"], r["n_words"]) for r in P.proximity_matches(index, it, slop=10**6).collect()} == {(1, 3), (2, 2), (4, 5)}


def test_empty_tables(spark):
    it = spark.createDataFrame(items(), "item_id long, text string")
    assert P.decontaminate(frame(spark, []), it).count() == 0
    none = P.decontaminate(frame(spark), it.where("false")).collect()
    assert len(none) == len(documents()) and not any(r["contaminated"] for r in none)


def test_proximity_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    texts = ["a b x b x c", "a x x x b c", "a a b b c c"] + [" ".join(rng.choices("abcx", k=12)) for _ in range(40)]
    docs = frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)])
    phrases = ["a b c", "a a b", "c b"]
    it = spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string")
    for slop in (0, 1, 2):
        want = {}
        for (d, t), (i, p) in itertools.product(enumerate(texts), enumerate(phrases)):
            w, p = t.split(), p.split()
            for at in itertools.combinations(range(len(w)), len(p)):
                if [w[k] for k in at] == p and all(y - x <= slop + 1 for x, y in itertools.pairwise(at)):
                    n = at[-1] - at[0] + 1
                    want[d, str(i), at[0]] = min(n, want.get((d, str(i), at[0]), n))
        got = P.proximity_matches(P.build_index(docs), it, slop=slop).collect()
        assert {(r["doc"], r["item"], r["start"]): r["n_words"] for r in got} == want and len(got) == len(want)


def test_clean_keeps_rows_and_columns(spark):
    docs, it = frame(spark, clash=True), spark.createDataFrame(items(), "item_id long, text string")
    kept = P.clean(docs, it)
    assert kept.dtypes == docs.dtypes
    assert Counter((r[0], r[1]) for r in kept.select("doc_id", "text").collect()) == Counter((r[0], r[1]) for r in documents() if not brute(r[1], items())[1])
