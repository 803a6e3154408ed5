import re
from collections import Counter

from palimpsest.llm import quality_rules as Q

from .fixtures import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def expected(rows):
    return Counter((i, *brute(t)) for i, t in rows)


def test_measurements_by_brute_force(spark, sf):
    got = Q.ledger(frame(spark, clash=True)).collect()
    assert Counter(tuple(r)[:6] for r in got) == expected((r[0], r[1]) for r in documents())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(tuple(r)[:6] for r in Q.ledger(docs).collect()) == expected(tuple(r) for r in docs.select("doc_id", "text").collect())


def test_bits_policies_and_ablations(spark):
    rows = Q.ledger(frame(spark)).cache()
    for r in rows.collect():
        bits = {n for k, n in enumerate(Q.RULE_NAMES) if r["failures"] >> k & 1}
        assert ("too_few_words" in bits) == (r["n_words"] < 50)
        assert ("repeated_windows" in bits) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = Q.apply_policy(rows, Q.DEFAULT).where("kept").count()
    found = {(r["policy"], r["without_rule"]): r for r in Q.ablations(rows).collect()}
    for p in Q.POLICIES:
        for k, n in enumerate(Q.RULE_NAMES):
            if p.mask >> k & 1:
                without = sum((r["failures"] & p.mask & ~(1 << k)).bit_count() <= p.tolerate for r in rows.collect())
                assert found[p.version, n]["kept_without"] == without
    assert found[Q.DEFAULT.version, "too_few_words"]["kept"] == kept


def test_junk_fails_and_prose_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = Q.apply_policy(Q.ledger(docs), Q.Policy("x", Q.DEFAULT.mask & ~Q.mask_of("too_few_words"))).join(docs.select("doc_id", "quality"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.9
    assert sum(bad) / len(bad) < 0.2


def test_empty_table(spark):
    assert Q.ledger(frame(spark, [])).count() == 0
    assert Q.ablations(Q.ledger(frame(spark, []))).count() == 0
