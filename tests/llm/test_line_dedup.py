import random
from collections import Counter

from palimpsest.llm import line_dedup as D

from .fixtures import SCHEMA, documents, frame

P = [f"passage {k} with quite a few words that many documents share here" for k in range(6)]


def rows():
    return [
        (1, "\n".join(["alpha beta gamma delta one", P[0], P[1], "ok", P[2], "the end of the first one"]), "en", "a", 1),
        (2, "\n".join(["something of its own stands here", P[0], P[1], "ok", P[2], "and its own last line too"]), "en", "a", 1),
        (3, "\n".join([P[2], "own line of the third document", P[0]]), "en", "a", 1),  # moved
        (4, "\n".join(["alpha beta gamma delta one", P[0], P[1], "ok", P[2], "the end of the first one"]), "en", "a", 1),  # a copy
        (5, "ok\nvery short things here now", "en", "a", 1),
        (6, P[3] + "\n" + P[3] + "\nx", "en", "a", 1),
        (7, P[3] + " \r\n\n" + P[3], "en", "a", 1),
        (8, None, "en", "a", 1),
        (9, "", "en", "a", 1),
        (10, "\n \n", "en", "a", 1),
        (11, P[0], "en", "a", 1),
        (11, P[0], "en", "a", 1),
        (None, P[0] + "\nno id at all", "en", "a", 1),
        (12, P[4] + "\n" + P[5], "en", "a", 1),
        (12, P[4] + "\nother text of the same id", "en", "a", 1),
    ]


def test_what_goes_and_what_stays(spark):
    got = {}
    for r in D.dedup_lines(frame(spark, rows())).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_deleted_lines"]))
    assert got[1] == [(rows()[0][1], 0)]
    assert got[2] == [("something of its own stands here\nand its own last line too", 4)]
    assert got[3] == [("own line of the third document", 2)]
    assert got[4] == [("", 6)]
    assert got[5] == [(rows()[4][1], 0)]
    assert got[6] == [(rows()[5][1], 0)]
    assert got[7] == [("", 2)]
    assert got[8] == [(None, 0)] and got[9] == [("", 0)] and got[10] == [("\n \n", 0)]
    assert got[11] == [("", 1)] * 2
    assert got[None] == [("no id at all", 1)]
    assert sorted(n for _, n in got[12]) == [0, 1]


def brute(docs):
    """Every pair of documents compared directly: the lines of five words or more that an earlier document has must go."""
    out = {}
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    seen = set()
    for k in order:
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in (docs[k][1] or "").split("\n")]
        out[docs[k][0]] = [x for x in lines if len(x.split()) >= 5 and x in seen]
        seen |= set(lines)
    return out


def test_all_shared_lines_go_and_no_others(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shared = brute(list(texts.items()))
    for r in D.dedup_lines(docs).collect():
        before, after = Counter(texts[r["doc_id"]].split("\n")), Counter((r["text"] or "").split("\n"))
        gone = before - after
        assert not after - before - Counter([""])
        # The first holder may have a line less often than a later one; each line goes at least once.
        assert {x.strip() for x in gone if len(x.split()) >= 5} == set(shared[r["doc_id"]])
    assert any(shared.values())


def test_patience():
    assert D.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    # A repeated line is aligned where it stands beside an anchor.
    assert D.align([([0], [4]), ([1, 7], [5, 9])]) == [(0, 4), (1, 5)]
    assert D.blocks([(0, 4), (1, 5), (3, 6)]) == [[0, 1], [3]]


def test_edges(spark):
    docs = frame(spark, clash=True)
    got = D.dedup_lines(docs)
    assert got.count() == len(documents())
    assert Counter(got.columns) == Counter([*docs.columns, "n_lines", "n_deleted_lines", "n_deleted_words"])
    assert D.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def gone(later, first):
    """What goes of one later document beside one earlier."""
    at = lambda lines, line: [k for k, x in enumerate(lines) if x == line]
    shared = [{"at": at(later, x), "first_at": at(first, x), "n_words": len(x.split()), "n_docs": 2, "first": 0} for x in sorted({*later} & {*first})]
    return D.deletions(shared, sum(len(x.split()) for x in later))


def test_a_short_line_that_crosses_a_long_one():
    own = [f"own text {k} of which this document has a lot more" for k in range(9)]
    assert gone([P[0], "Home", *own], ["Home", P[0]]) == [0]
    assert gone(["All rights reserved.", "Home", P[0], *own], [P[0], "All rights reserved.", "Home"]) == [2]


def test_a_repeated_long_line():
    own = [f"own text {k} of which this document has a lot more" for k in range(9)]
    assert gone(["Home", P[0], *own, P[0]], [P[0], "x", "Home"]) == [1, 11]
    assert gone(["Home", P[0], *own], [P[0], "x", P[0], "y", "Home"]) == [1]


def test_a_block_of_short_lines_with_scattered_first_holders(spark):
    items = [f"item {k}" for k in range(30)]
    own = [f"own text {{}} {k} of which each document has a lot more than of lists" for k in range(20)]
    docs = [(k + 1, "\n".join([f"a document {k} with one line of the list", *items[k::7]]), "en", "a", 1) for k in range(7)]
    docs += [(k, "\n".join([*items, *(x.format(k) for x in own)]), "en", "a", 1) for k in (8, 9)]
    got = {r["doc_id"]: r["n_deleted_lines"] for r in D.dedup_lines(frame(spark, docs)).collect()}
    assert got == dict.fromkeys(range(1, 9), 0) | {9: 30}


def test_what_any_earlier_document_has_in_a_run_of_five_words(spark):
    rng = random.Random(5)
    lines = ["a", "b", "c c", "d d", "e e e", "f f f f", "g g g g g", ""]
    texts = [[rng.choice(lines) if rng.random() < 0.7 else f"own line {k} {n} is not shared" for n in range(rng.randrange(5, 40))] for k in range(80)]

    def run_at(text, x, other):
        """Words of the longest run through a place that the other text has too."""
        best = 0
        for y, line in enumerate(other):
            if line == text[x] and line:
                a = b = 0
                while x - a > 0 and y - a > 0 and text[x - a - 1] == other[y - a - 1] != "":
                    a += 1
                while x + b + 1 < len(text) and y + b + 1 < len(other) and text[x + b + 1] == other[y + b + 1] != "":
                    b += 1
                best = max(best, sum(len(t.split()) for t in text[x - a : x + b + 1]))
        return best

    want = {}
    for k, text in enumerate(texts):
        most = [max((run_at(text, x, other) for other in texts[:k]), default=0) for x in range(len(text))]
        words = [len(t.split()) for t in text]
        copied = sum(w for w, m in zip(words, most, strict=True) if m >= 5) >= 0.5 * sum(words)
        if at := [x for x, m in enumerate(most) if m >= 5 or (m and copied)]:
            want[k] = at
    docs = [(k, "\n".join(text), "en", "a", 1) for k, text in enumerate(texts)]
    got = {r["__id"]: r["gone"] for r in D.plan_deletions(frame(spark, docs)).collect()}
    assert got == want


def test_many_equal_lines_take_one_pass(spark):
    import time

    n = 100_000
    start = time.perf_counter()
    assert len(D.deletions([{"at": list(range(n)), "first_at": [3], "n_words": 6, "n_docs": 2, "first": 1, "n_lines": 1}], 6 * n)) == n
    assert time.perf_counter() - start < 10
    rows = [(1, "one two three four five six"), (2, "one two three four five six\n" * n + "and words of its own are here")]
    got = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "and words of its own are here"}
