"""Machines of streams against what the same log gives as a table, in several cuts and over stops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lifecycles as Y
from palimpsest.runtime import shared_path
from palimpsest.streaming import projections as P
from palimpsest.streaming import stateful as S
from palimpsest.streaming.projections import read_log, write_log


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_events_over_stops(spark):
    rng = random.Random(1)
    kinds = ["stored", "stored", "consolidated", "invalidated"]
    log = [(k, f"s{rng.randrange(3)}", rng.randrange(6), rng.choice(kinds), f"b{k}") for k in range(120)]
    schema = "seq long, scope string, id long, kind string, body string"
    df = spark.createDataFrame(log, schema)
    path, (out, offsets) = shared_path(spark, "log"), S.fresh_paths(spark, "last")
    last = {}
    for seq, scope, id_, kind, body in log:
        gone = kind == "invalidated"
        last[scope, id_] = (scope, id_, seq, None if gone else kind, None if gone else body, gone)
    for lo, hi in ((0, 50), (50, 51), (51, 120)):  # the stream ends after each part, and goes on with the next
        write_log(df.where(f"seq >= {lo} and seq < {hi}"), path, files=2, order="seq")
        got = S.current_state(read_log(spark, path, schema=df.schema), ["scope", "id"], "seq", out, offsets, "kind", ("invalidated",))
    assert rows(got.select("scope", "id", "seq", "kind", "body", "tombstone")) == sorted(last.values(), key=str)
    write_log(df.where("seq < 20"), path, files=1, order="seq")  # what comes again changes nothing
    got = S.current_state(read_log(spark, path, schema=df.schema), ["scope", "id"], "seq", out, offsets, "kind", ("invalidated",))
    assert rows(got.select("scope", "id", "seq", "kind", "body", "tombstone")) == sorted(last.values(), key=str)


@pytest.mark.parametrize("files", [1, 5])
def test_plans_as_settled_tables(spark, files):
    rng = random.Random(2)
    tasks = [(k, k % 7, rng.choice(["pending", "pending", "dispatched", "running", "completed"]), rng.randint(1, 2), 2) for k in range(70)]
    verdicts = [(k, rng.random() < 0.4) for k in range(70) if rng.random() < 0.7]
    rng.shuffle(verdicts)
    log = [(p, seq, "task", i, s, a, m, None) for seq, (i, p, s, a, m) in enumerate(tasks)]
    log += [(i % 7, 100 + seq, "verdict", i, None, None, None, ok) for seq, (i, ok) in enumerate(verdicts)]
    df = spark.createDataFrame(log, S.COMMANDS)
    got = S.settled(read_log(spark, write_log(df, shared_path(spark, "log"), files, "seq"), schema=S.COMMANDS), *S.fresh_paths(spark, "plans"))
    table = Y.settle(spark.createDataFrame(tasks, "id long, plan_id long, status string, attempt int, max_attempts int"), spark.createDataFrame(verdicts, "id long, passed boolean"))
    assert rows(got.select("plan_id", "id", "status", "attempt")) == rows(table.select("plan_id", "id", "status", "attempt"))


@pytest.mark.parametrize("files", [1, 4])
def test_approvals_run_out(spark, files):
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    log, want = [], {}
    for k in range(40):
        log.append((k, "asked", day(k % 5), day(k % 5 + 3)))
        want[k] = "expired"
        if k % 2 == 0:
            late = k % 4 == 0
            log += [(k, "granted" if k % 3 else "denied", day(k % 5 + (4 if late else 1)), None), (k, "denied", day(k % 5 + 2), None)]
            want[k] = "denied" if late or k % 3 == 0 else "granted"
    log += [(100, "asked", day(20), day(30)), (101, "granted", day(20), None)]
    want[100] = "pending"
    log = [(i, seq, c, at, e) for seq, (i, c, at, e) in enumerate(sorted(log, key=lambda r: (r[2], r[0])))]
    # One file a step: what comes after the watermark is late.
    df = spark.createDataFrame(log, S.REQUESTS).coalesce(1)
    got = S.approvals(read_log(spark, write_log(df, shared_path(spark, "log"), files, "seq"), schema=S.REQUESTS), *S.fresh_paths(spark, "approvals"))
    assert {r["id"]: r["state"] for r in got.collect()} == want
    assert {r["id"]: r["at"] for r in got.where(F.col("state") == "expired").collect()} == {k: day(k % 5 + 3) for k, s in want.items() if s == "expired"}


def _events(spark, ids):
    return spark.createDataFrame([(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), i % 3, "a", float(i), "{}") for i in ids], P.EVENTS)


def test_a_log_that_begins_with_a_file_without_rows(spark):
    path = shared_path(spark, "log")
    _events(spark, []).coalesce(1).write.parquet(path)
    write_log(_events(spark, range(20)), path, 2)
    got = P.current_state(read_log(spark, path), shared_path(spark, "state"), shared_path(spark, "offsets"))
    assert rows(got.select("user_id", "event_id")) == [(0, 18), (1, 19), (2, 17)]


def test_reminders_are_the_first_of_each_key_in_any_order_of_files(spark):
    path = shared_path(spark, "log")
    for ids in (range(40, 60), range(10, 40)):
        write_log(_events(spark, ids).repartition(3), path, 1)
    got = P.remind_once(read_log(spark, path), ["user_id", "event_type"], shared_path(spark, "reminded"), shared_path(spark, "offsets"))
    assert rows(got.select("user_id", "event_id")) == [(0, 12), (1, 10), (2, 11)]
