"""Readers and sinks, by round trips."""

import json

from pyspark.sql import functions as F

from palimpsest.sources import readers, sinks


def chunk(text, size):
    out = []
    for p in [x.strip(" ") for x in __import__("re").split(r"\n\s*\n", text)]:
        for piece in [p[k : k + size] for k in range(0, len(p), size)]:
            if out and len(out[-1]) + 2 + len(piece) <= size:
                out[-1] += "\n\n" + piece
            else:
                out.append(piece)
    return out


def test_chunks(spark):
    text = "one two\n\nthree\n \nfour five six seven eight nine ten\n\n\n\nx"
    for size in (5, 12, 20, 100):
        got = spark.createDataFrame([(text,)], "t string").select(readers.chunks(F.col("t"), size)).first()[0]
        assert got == chunk(text, size)
    assert spark.createDataFrame([("",)], "t string").select(readers.chunks(F.col("t"))).first()[0] == []


def test_vault(spark, tmp_path):
    for name, text in {"a/x.md": "ax", "b/c/y.md": "by", "z.md": "top", "a/no.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r["path"], r["top"], r["text"]) for r in readers.vault(spark, str(tmp_path)).collect()}
    assert got == {("a/x.md", "a", "ax"), ("b/c/y.md", "b", "by"), ("z.md", "", "top")}
    assert readers.vault(spark, str(tmp_path), exclude=("a",)).count() == 2 and readers.vault(spark, str(tmp_path), include=("b",)).count() == 1


def test_triples_and_vectors(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"subject": "a", "predicate": "Has Full Name", "object": "b", "confidence": 0.9, "source_file": "f"}, {"subject": "a", "predicate": "x", "object": "b", "confidence": 0.4}]))
    assert [(r["predicate"], r["class"]) for r in readers.triples(spark, f"{tmp_path}/t.json", aliases={"full_name": "name"}, identity=("name",)).collect()] == [("name", "identity")]
    (tmp_path / "v.tsv").write_text("a\t[1.0,2.0]\nb\t[3.0]\n")
    loaded = readers.vectors_tsv(spark, f"{tmp_path}/v.tsv")
    items = spark.createDataFrame([("a", None), ("b", [9.0]), ("c", None)], "id string, embedding array<float>")
    assert {r["id"]: r["embedding"] for r in readers.fill_vectors(items, loaded).collect()} == {"a": [1.0, 2.0], "b": [9.0], "c": None}


def test_log_tail_and_resume(spark, tmp_path):
    (tmp_path / "l.log").write_text("".join(f"line {k}\n" for k in range(20)) + "\n")
    assert [r["line"] for r in readers.log_tail(spark, f"{tmp_path}/l.log", 3).collect()] == ["line 17", "line 18", "line 19"]
    todo, done = spark.createDataFrame([(1, "abc"), (2, "a")], "id int, text string"), spark.createDataFrame([(1,)], "id int")
    assert [r["id"] for r in readers.not_done(todo, done).collect()] == [2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "user:a", "x")], "id int, scope string, v string")
    _, events = sinks.with_events(df, "memory.fact.stored")
    again = sinks.with_events(df, "memory.fact.stored")[1]
    assert events.first() == again.first() and events.first()["subject"] == "1"
    sinks.append(df, f"{tmp_path}/t")
    sinks.append(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    sinks.overwrite_partitions(df.withColumn("d", F.lit(1)).union(df.withColumn("d", F.lit(2))), f"{tmp_path}/p", ["d"])
    sinks.overwrite_partitions(df.withColumn("v", F.lit("new")).withColumn("d", F.lit(2)), f"{tmp_path}/p", ["d"])
    assert {(r["d"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {(1, "x"), (2, "new")}
    runs = spark.createDataFrame([(1,), (1,), (2,)], "run_id int")
    assert [r[0] for r in sinks.deliver_once(runs, spark.createDataFrame([(2,)], "run_id int")).collect()] == [1]
