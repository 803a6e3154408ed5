"""Scalar functions against hand-written cases."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.functions import text as X


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def of(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("text,key", [("  Uses  Postgres.  ", "uses postgres"), ("A!?", "a"), ("", ""), ("Ends, here;:", "ends, here")])
def test_statement_key(spark, text, key):
    assert of(spark, X.statement_key, text) == key


def test_keys_and_prefixes(spark):
    assert of(spark, X.slug, "  Hello, World! (2) ") == "hello-world-2"
    assert of(spark, X.slug, "!!!") == "untitled"
    assert of(spark, X.source_system, "brain:a:b") == "brain" and of(spark, X.source_system, None) == "unknown" and of(spark, X.source_system, ":x") == "unknown"
    assert of(spark, X.nested_prefix, "mind:notes/a/b.md") == "notes"
    assert of(spark, X.scope_level, "user:u1") == "user" and of(spark, X.scope_level, "u1") == "user" and of(spark, X.scope_ident, "ws:a:b") == "a:b"
    assert of(spark, lambda c: X.predicate_name(c, {"full_name": "name"}), " Has Full-Name ") == "name" and of(spark, X.predicate_name, "is_happy") == "happy"
    assert of(spark, X.entity_label, " tool ") == "Tool" and of(spark, X.entity_label, "gizmo") == "Other"


@pytest.mark.parametrize("predicate,name", [("name", "identity"), ("works_on_x", "project"), ("has_friend", "relationship"), ("medical_note", "health"), ("tool_used", "skill"), ("colour", "fact")])
def test_predicate_class(spark, predicate, name):
    assert of(spark, lambda c: X.predicate_class(c, ("name", "age")), predicate) == name


@pytest.mark.parametrize("text,trivial", [("ok thanks", True), ("use Postgres for X", False), ("eleven char", True), ("twelve chars", False), ("Sounds good, thank you!!", True), (None, True), ("yes please do that thing", False)])
def test_trivial_turns(spark, text, trivial):
    assert of(spark, X.is_trivial_turn, text) is trivial


def test_scaffolding(spark):
    text = "Hi <system-reminder a='b'>secret\nlines</system-reminder> there <command-name>"
    assert of(spark, X.strip_scaffolding, text) == "Hi  there"


def test_words(spark):
    assert of(spark, lambda c: X.tokens(c, 3), "éabc abc abcé The") == ["abc", "abc", "abc", "the"]
    assert of(spark, lambda c: X.top_words(c, 2), "bbb aaa aaa ccc bbb ddd") == ["bbb", "aaa"]
    sets = [(["a", "b"], ["b", "c"], 1 / 3), ([], [], 1.0), (["a"], [], 0.0)]
    for a, b, want in sets:
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        assert df.select(X.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("text,mood", [("great progress, excited and focused", ("energetic", 1.0, 0.9)), ("tired and sad", ("tired", -1.0, 0.1)), ("nothing here", ("neutral", 0.0, 0.5))])
def test_mood(spark, text, mood):
    assert tuple(of(spark, X.mood, text)) == pytest.approx(mood)


def test_routing_and_intent(spark):
    assert of(spark, X.route, "Apply for a job") == "career"
    assert of(spark, X.route, "a jobless postgres") == "personal"
    assert of(spark, X.route, "my case study") == "content"
    assert of(spark, X.intent, "how's it going") == "status" and of(spark, X.intent, "make a plan") == "decompose" and of(spark, X.intent, "hm") == "none"


def test_extraction(spark):
    assert of(spark, X.decisions, "We decided to stay. Then picked x, and went with the blue one;") == ["to stay", "the blue one"]
    got = [tuple(x) for x in of(spark, X.triples, "Ada uses Spark. This is fine. Bob is an engineer.")]
    assert ("Ada", "uses", "Spark") in got and ("Bob", "is", "engineer") in got and not any(s == "This" for s, _, _ in got)


def test_scores(spark):
    one = lambda c: value(spark, c)
    assert one(S.brier(F.lit(0.8), F.lit(False))) == pytest.approx(0.64) and one(S.brier(F.lit(0.8), F.lit(True))) == pytest.approx(0.04)
    assert one(S.brier(F.lit(None).cast("double"), F.lit(True))) is None
    assert one(S.half_life(F.lit(0.5), F.lit(60.0), 30.0)) == pytest.approx(0.125)
    assert one(S.recency(F.lit(0.0))) == 1.0 and one(S.recency(F.lit(None).cast("double"))) == pytest.approx(1.0)
    assert one(S.clamp01(F.lit("1.7"))) == 1.0 and one(S.clamp01(F.lit("x"))) == 0.5
    assert one(S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.70710678)
    assert one(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_hash_embedding(spark):
    v = of(spark, lambda c: S.hash_embedding(c, 12), "hello")
    words = [int(hashlib.sha256(f"hello:{k}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) / 2**31 - 1 for k in range(2) for i in range(8)][:12]
    norm = sum(x * x for x in words) ** 0.5
    assert v == pytest.approx([x / norm for x in words])


def test_ids(spark):
    ulid = "mem_01ARZ3NDEKTSV4RRFFQ69G5FAV"
    assert of(spark, S.is_typed_id, ulid) and not of(spark, S.is_typed_id, ulid + "X") and not of(spark, S.is_typed_id, "mem_" + "U" * 26)
    assert of(spark, S.id_prefix, ulid) == "mem"
    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    want = 0
    for c in "01ARZ3NDEK":
        want = want * 32 + alphabet.index(c)
    assert of(spark, S.id_millis, ulid) == want


@pytest.mark.parametrize(
    "kind,after,last,minutes,hhmm,days,dom,want",
    [
        ("every", "2024-01-01 10:00", "2024-01-01 09:58", 15, None, None, None, "2024-01-01 10:13"),
        ("every", "2024-01-01 10:00", "2024-01-01 09:58", 1, None, None, None, "2024-01-01 10:03"),
        ("daily", "2024-01-01 10:00", None, None, "09:30", None, None, "2024-01-02 09:30"),
        ("daily", "2024-01-01 08:00", None, None, "09:30", None, None, "2024-01-01 09:30"),
        ("weekly", "2024-01-03 10:00", None, None, "09:00", [0, 4], None, "2024-01-05 09:00"),
        ("weekly", "2024-01-01 09:00", None, None, "09:00", [0], None, "2024-01-08 09:00"),
        ("monthly", "2024-01-29 00:00", None, None, "06:00", None, 28, "2024-02-28 06:00"),
        ("monthly", "2024-12-29 00:00", None, None, "06:00", None, 28, "2025-01-28 06:00"),
    ],
)
def test_cadence(spark, kind, after, last, minutes, hhmm, days, dom, want):
    at = lambda s: s and datetime.fromisoformat(s)
    df = spark.createDataFrame([(kind, at(after), at(last), minutes, hhmm, days, dom)], "k string, a timestamp_ntz, l timestamp_ntz, m int, h string, d array<int>, o int")
    assert df.select(S.next_due(*[F.col(c) for c in "kalmhdo"])).first()[0] == at(want)
