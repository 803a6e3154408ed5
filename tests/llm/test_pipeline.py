import zlib
from collections import Counter

import pytest

import corpus_pipeline as C
from palimpsest.llm import mixture_langid as L
from palimpsest.llm.queries import oracle_sql, queries

from .fixtures import SCHEMA, documents, frame
from .test_fair_mix import brute as mix_brute
from .test_line_dedup import brute as shared_lines
from .test_positional_index import brute as hits
from .test_simhash_similar import similar_classes


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Supplied documents with planted copies, near copies, passages, and the fixture's odd rows."""
    d = str(tmp_path_factory.mktemp("world"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*SCHEMA.fieldNames())
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if 150 < len(r[1].split()) < 400][:12]
    passage = " ".join("passage" + str(k % 61) for k in range(55))
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    extra = [(5000 + k, r[1], r[2], r[3], r[4]) for k, r in enumerate(long[:4])]
    extra += [(6000 + k, r[1].replace("\n", " ") + " tail", r[2], r[3], r[4]) for k, r in enumerate(long[4:8])]
    extra += [(7000 + k, r[1] + "\n" + passage, r[2], r[3], r[4]) for k, r in enumerate(long[8:10])]
    extra += [(8000, long[10][1][:300] + "\n" + bench[0][1] + "\n", "en", "src1", 1)]
    extra += [(90000 + k, *r[1:]) for k, r in enumerate(documents()) if r[0] != 9]
    spark.createDataFrame(rows + extra, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return d, bench


def test_each_stage_on_its_own_input(spark, world, tmp_path):
    d, bench = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    state = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        new = [tuple(r) for r in out.select(*names).collect()]
        if k < 4:
            assert out.columns == names
        before, after = Counter(state), Counter(new)
        if name == "language_id":
            assert not after - before
            assert all(not L.has_letter(r[1]) or len(r[1]) < 200 or r[0] is None or r[0] >= 90000 for r in before - after)
            assert all(L.has_letter(r[1]) for r in after)
        elif name == "line_dedup":
            shared = shared_lines([r for r in state if r[0] is not None and Counter(x[0] for x in state)[r[0]] == 1])
            for r in new:
                if r[0] in shared:
                    assert not {x for x in shared[r[0]] if state_count(state, r[0], x) == 1} & {x.strip() for x in r[1].split("\n")}
            assert not {5000, 5001, 5002, 5003} & {r[0] for r in new}
        elif name == "near_dedup":
            assert not after - before
            # Documents that line dedup changed stand for both their texts.
            once = lambda rows: {r[0]: r for r in rows if r[0] is not None and Counter(x[0] for x in rows)[r[0]] == 1}
            came, now = once([tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select(*names).collect()]), once(state)
            place = {r: i for i, r in reversed(list(enumerate(state)))}
            two = [(place[r], came[i][1]) for i, r in now.items() if i in came and came[i][1] != r[1]]
            assert len(two) > 3
            roots = similar_classes([r[1] for r in state] + [t for _, t in two], [(i, len(state) + k) for k, (i, _) in enumerate(two)])[: len(state)]
            kept = [i for i, r in enumerate(state) if r in after]
            assert len(new) == len(set(roots)) and {roots[i] for i in kept} == set(roots)
            for root in set(roots):
                ids = [state[i][0] for i in range(len(state)) if roots[i] == root and state[i][0] is not None]
                assert not ids or min(ids) in {r[0] for r in new}
        elif name == "decontaminate":
            assert after == Counter(r for r in state if hits(r[1], bench)[1] == 0)
            assert 8000 not in {r[0] for r in new}
        else:
            assert after == before
            got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out.collect())
            assert got == mix_brute([(r[0], r[1], r[3]) for r in state])
        docs, state = out.select(*names), new


def state_count(state, doc, line):
    return next(Counter(x.strip() for x in r[1].split("\n"))[line] for r in state if r[0] == doc)


def test_run_and_empty_tables(spark, world, tmp_path):
    d, _ = world
    assert C.run(spark, d).count() > 100
    e = f"{tmp_path}/empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{e}/benchmark.parquet")
    assert C.run(spark, e).count() == 0


def test_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    want = {
        "op2_simhash_trie": ["doc_id", "fingerprint", "component_id"],
        "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op4_line_crf": ["doc_id", "held_out", "score", "predicted"],
        "op6_license_scan": ["doc_id", "license"],
        "op8_mixture_langid": ["doc_id", "held_out", "lang_pred", "score"],
        "op9_line_dedup": ["doc_id", "n_lines"],
    }
    for name, columns in want.items():
        df = queries()[name](spark, d)
        assert df.columns[: len(columns)] == columns and df.count() == n
    assert set(oracle_sql()) <= set(queries())
    rows = queries()["op8_mixture_langid"](spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_stages_keep_columns_of_any_name(spark, world):
    d, _ = world
    docs = frame(spark, [r for r in documents() if r[0] != 9], clash=True)
    for name, stage in C.STAGES:
        out = stage(spark, docs, d)
        passed = [c for c in docs.columns if name != "mix" or c not in ("size", "source_size", "target", "virtual_start", "virtual_finish", "taken")]
        if name != "mix":
            assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "clash" for r in rows for c in passed if c not in SCHEMA.fieldNames()), name
