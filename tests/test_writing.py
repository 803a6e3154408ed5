"""The verbs that write, on hand-written rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import writing as W

NOW = datetime(2024, 1, 31)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_record(spark):
    df = spark.createDataFrame([(1, "user:a", "<system-reminder>x</system-reminder> hello"), (2, "user:a", "<system-reminder>x</system-reminder>"), (3, "user:a", None)], "id int, scope string, content string")
    good, bad, events = W.record(df)
    assert rows(good, "id", "content") == [(1, "hello")]
    assert rows(bad, "id", "reason") == [(2, "empty_content"), (3, "empty_content")]
    assert rows(events, "type", "subject", "scope") == [("episode.recorded", "1", "user:a")]


def test_add(spark):
    episodes = spark.createDataFrame([("e", "user:a")], "id string, scope string")
    known = spark.createDataFrame([(6,)], "id int")
    facts = [(1, "user:a", "  It  Works. ", "e"), (2, "user:a", " ", "e"), (3, "user:a", "[redacted]", "e"), (4, "user:a", "x", "f"), (5, "user:b", "x", "e"), (6, "user:a", "x", "e")]
    good, bad, events = W.add(spark.createDataFrame(facts, "id int, scope string, statement string, source_episode_id string"), episodes, known)
    assert rows(good, "id", "statement_key") == [(1, "it works")]
    assert rows(bad, "id", "reason") == [(2, "empty_statement"), (3, "reserved_statement"), (4, "episode_missing"), (5, "scope_mismatch"), (6, "id_taken")]
    assert events.count() == 1


def test_invalidate(spark):
    facts = spark.createDataFrame([(1, "a", None, None), (2, "a", NOW - timedelta(1), 1), (3, "a", None, None)], "id int, scope string, valid_to timestamp_ntz, superseded_by int")
    asked = spark.createDataFrame([(1, "a", 9), (1, "a", 3), (2, "a", None), (3, "b", None), (7, "a", None)], "fact_id int, scope string, superseded_by int")
    out, bad, events = W.invalidate(facts, asked, F.lit(NOW).cast("timestamp_ntz"))
    assert rows(out, "id", "valid_to", "superseded_by") == sorted([(1, NOW, 3), (2, NOW - timedelta(1), 1), (3, None, None)], key=repr)
    assert rows(bad, "fact_id", "reason") == [(2, "already_ended"), (3, "scope_mismatch"), (7, "fact_missing")]
    assert events.count() == 1


def test_retire_and_insert(spark):
    kind = "name string, status string, valid_to timestamp_ntz"
    old = spark.createDataFrame([("a", "hypothesis", None), ("b", "canonical", None)], kind)
    new = spark.createDataFrame([("b", "hypothesis", None), ("c", "hypothesis", None)], kind)
    out = W.retire_and_insert(old, new, ["name"], F.lit(NOW).cast("timestamp_ntz"))
    assert rows(out, "name", "status", "valid_to") == sorted([("a", "hypothesis", NOW), ("b", "canonical", None), ("c", "hypothesis", None)], key=repr)
