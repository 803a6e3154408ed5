import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from palimpsest.llm import set_links as S
from palimpsest.llm import simhash_similar as Z

from .fixtures import SCHEMA, documents


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else frozenset())


def similar_classes(texts, tied=(), similarity=0.8):
    """For each text the first that links connect it with, all pairs by brute force; texts without words are copies. Pairs of places in `tied` are linked."""
    sets, root, tied = [shingles(t) for t in texts], list(range(len(texts))), set(tied)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for y in range(len(sets)):
        for x in range(y):
            a, b = sets[x], sets[y]
            if (x, y) in tied or a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                low, high = sorted((find(x), find(y)))
                root[high] = low
    return [find(x) for x in range(len(sets))]


def copies(seed=3):
    """Texts with exact copies, word edits that leave 0.6 to 1 of the shingles, and a chain whose ends are far apart."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((4, 30, 120, 400)))]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 6):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    chain = [word() for _ in range(100)]
    for k in range(6):
        texts.append(" ".join(chain[8 * k : 8 * k + 100]))
        chain += [word() for _ in range(8)]
    return texts


@pytest.mark.parametrize("block", [3, 1024])
def test_survivors_by_brute_force(spark, block):
    texts = copies()
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in Z.survivors(df, block=block).collect()) == sorted(set(similar_classes(texts)))


def test_odd_rows(spark):
    rows = [tuple(r) for r in documents()] + [(None, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1)]
    rows += [(70, "one two three four five six", None, None, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(r) for r in Z.survivors(df).collect()]
    assert not set(out) - set(rows)
    roots = similar_classes([r[1] for r in rows])
    assert len(out) == len(set(roots))
    assert out.count((70, "one two three four five six", None, None, None)) == 1
    assert (1, "a b c d e f", "en", "s", 1) in out and (None, "a b c d e f", "en", "s", 1) not in out
    assert Z.survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names(spark):
    names = ["cluster", "set_key", "mark", "__mark", "tag", "deal", "other", "root", "head", "__id", "__head", "stays", "n", "__judged_id", "__judged_mark"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", *names)])
    df = spark.createDataFrame([("b", "x y z", *names), ("a", "x y z", *names), ("a", "x y z", *names), ("c", None, *names)], schema)
    out = Z.survivors(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == ["a", "c"] and all(r[c] == c for r in out.collect() for c in names)


def test_anchors_meet():
    rng = np.random.default_rng(1)
    both, rest = rng.integers(0, 1 << 62, 800).astype(np.uint64), rng.integers(0, 1 << 62, 200).astype(np.uint64)
    a, b = np.concatenate([both, rest[:100]]), np.concatenate([both, rest[100:]])
    x, y = Z.anchors(a, np.array([0, 900]))[0], Z.anchors(b, np.array([0, 900]))[0]
    assert (x == y).any()


def test_a_near_copy_that_repeats_a_block(spark):
    rng = random.Random(7)
    rows = []
    for k in range(20):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(204)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[:29] * 30))]
        assert len(shingles(rows[-1][1]) & shingles(rows[-2][1])) >= 0.9 * len(shingles(rows[-1][1]) | shingles(rows[-2][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in Z.survivors(docs).collect()) == list(range(0, 40, 2))


def test_near_copies_by_what_documents_were(spark):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(12))
    came, now = [], []
    for k in range(10):
        lines = [line() for _ in range(12)]
        other = [*lines[:11], line()]
        came += [(2 * k, "\n".join(lines)), (2 * k + 1, "\n".join(other))]
        now += [came[-2], (2 * k + 1, other[11])]
    now.append((99, "words of its own that nobody else has at all"))
    df, also = (spark.createDataFrame(x, "doc_id long, text string") for x in (now, came))
    assert sorted(r[0] for r in Z.survivors(df).collect()) == [*range(20), 99]
    assert sorted(r[0] for r in Z.survivors(df, also=also).collect()) == [*range(0, 20, 2), 99]
    # A text that an id had twice is one.
    assert sorted(r[0] for r in Z.survivors(df, also=also.union(also)).collect()) == [*range(0, 20, 2), 99]
    assert Z.survivors(df.where("false"), also=also).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_large_groups_of_near_copies(spark, block):
    """Copies that are all like one another, and some that are only like a few: classes within one cluster."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(150)]
    texts = []
    for k in range(60):
        new = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 7))):
            new[rng.randrange(150)] = word()
        texts.append(" ".join(new))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in Z.survivors(df, block=block).collect()) == sorted(set(similar_classes(texts)))


def test_sets_are_decided_in_parts(spark, monkeypatch):
    """A share of the full sets is on disk at a time, and the parts link what one would."""
    texts, made = copies(), []
    written = S.written
    monkeypatch.setattr(S, "written", lambda df, path: (out := written(df, path), made.append(out.count()))[0])
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in Z.survivors(df).collect()) == (want := sorted(set(similar_classes(texts))))
    whole = max(made)
    made.clear()
    monkeypatch.setattr(S, "PART_BYTES", 1 << 10)
    assert sorted(r["doc_id"] for r in Z.survivors(df, block=3).collect()) == want
    assert max(made) < 0.75 * whole


def test_shuffles_end_with_their_action(spark):
    """Shuffle files of a finished action don't stay until garbage is collected; what follows still reads the frames."""
    import glob

    from palimpsest.runtime import brief_shuffles, cut, shared_path, written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data"))
    before = spark.conf.get(key)
    with brief_shuffles(spark):
        had = files()
        a = cut(spark.range(1000).groupBy("id").count())
        b = written(spark.range(1000).repartition(3, "id"), shared_path(spark, "brief"))
        assert a.join(b, "id").count() == 1000 == a.count() and a.toArrow().num_rows == 1000
        assert not files() - had
    assert spark.conf.get(key) == before
