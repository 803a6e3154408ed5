import re
from collections import Counter

from palimpsest.llm import license_scan as S

from .fixtures import documents, frame


def normal(text):
    return re.findall(r"[^\W_]+", text.lower())


def bag(w):
    return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter((x, "") for x in w)


def brute(text, threshold=0.8):
    """All units and windows against all templates, nothing pruned."""
    lines = (text or "").split("\n")
    w, starts = [], [0]
    for x in lines:
        w += normal(x)
        starts.append(len(w))
    units, first = {(starts[k], starts[k + 1]) for k in range(len(lines))} | {(0, len(w))}, None
    for k, x in enumerate([*lines, ""]):
        if x.strip():
            first = k if first is None else first
        elif first is not None:
            units.add((starts[first], starts[k]))
            first = None
    found = []
    templates = [(name, bag(normal(t))) for name, texts in S.TEMPLATES.items() for t in texts]
    for a, b in units:
        own = bag(w[a:b])
        scored = [(-2 * (own & t).total() / max(1, own.total() + t.total()), name) for name, t in templates]
        if b > a and -min(scored)[0] >= threshold:
            found.append((min(scored)[0], a - b, min(scored)[1], a, b))
    for name, t in templates:
        n = t.total() + 1
        for a in range(len(w) - 1):
            own = bag(w[a : a + n])
            # Windows begin with a bigram of the template.
            if (w[a], w[a + 1]) in t and (own & t).total() / t.total() >= threshold:
                found.append((-(own & t).total() / t.total(), -n, name, a, min(len(w), a + n)))
    kept = []
    for m in sorted(found, key=lambda m: m[:4]):
        if all(m[4] <= x[3] or x[4] <= m[3] for x in kept):
            kept.append(m)
    top = kept[0] if kept else (None, None, None)
    return top[2], top[0] and round(-top[0], 9), len(kept), tuple(sorted({m[2] for m in kept}))


def comment(text, width=9):
    w = text.split()
    return "\n".join("# " + " ".join(w[k : k + width]) for k in range(0, len(w), width))


def rows():
    mit, whole = S.TEMPLATES["MIT"][2:4]
    prose = "some other words that stand here and there in a longer run of prose which has no licence at all in it " * 3
    return [
        *[r for r in documents() if r[0] != 9],
        (300, "Some words here.\nReleased under the MIT License.", "en", "a", 1),
        (301, "some\n\n" + mit.replace(", ", ",\n") + "\n\nmore", "en", "a", 1),
        (302, "RELEASED under the  MIT license!!!", "en", "a", 1),
        (303, "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "en", "a", 1),
        (304, mit + " and some more words that follow here", "en", "a", 1),
        (305, "All rights reserved by none of those who stand here", "en", "a", 1),
        (306, prose + "Released under the MIT License. " + prose, "en", "a", 1),
        (307, "// x\n" + comment("Copyright 2020 A " + whole) + "\n#\n" + prose, "en", "a", 1),
        (308, prose + whole + " " + prose, "en", "a", 1),
        (309, comment(S.TEMPLATES["GPL-2.0"][1]) + "\n" + prose, "en", "a", 1),
        (310, comment(S.TEMPLATES["AGPL-3.0"][0]), "en", "a", 1),
        (311, S.TEMPLATES["BSD-2-Clause"][1], "en", "a", 1),
        (312, S.TEMPLATES["BSD-3-Clause"][3], "en", "a", 1),
        (313, comment(S.TEMPLATES["LGPL-2.1"][0]) + "\n\n" + comment(S.TEMPLATES["Apache-2.0"][3]), "en", "a", 1),
    ]


def results(df):
    return Counter((r["doc_id"], r["license"], r["dice"] and round(r["dice"], 9), r["n_matches"], tuple(r["licenses"])) for r in df.collect())


def test_brute_force(spark, sf):
    assert results(S.scan(frame(spark, rows(), clash=True))) == Counter((r[0], *brute(r[1])) for r in rows())
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000")
    got = results(S.scan(docs))
    assert got == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    assert sum(k[1] is not None for k in got) > 3


def test_named(spark):
    got = {r["doc_id"]: r for r in S.scan(frame(spark, rows())).collect()}
    assert got[300]["license"] == "MIT" and got[301]["license"] == "MIT" and got[302]["dice"] == 1.0
    assert got[303]["licenses"] == ["CC-BY-NC-4.0", "Proprietary"]
    want = {304: "MIT", 306: "MIT", 307: "MIT", 308: "MIT", 309: "GPL-2.0", 310: "AGPL-3.0", 311: "BSD-2-Clause", 312: "BSD-3-Clause"}
    assert {k: got[k]["licenses"] for k in want} == {k: [v] for k, v in want.items()}
    assert got[313]["licenses"] == ["Apache-2.0", "LGPL-2.1"] and got[313]["n_matches"] == 2
    assert S.scan(frame(spark, [])).count() == 0
