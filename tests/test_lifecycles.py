from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from palimpsest.operators import attention as A
from palimpsest.operators import graph as G
from palimpsest.operators import lifecycles as Y
from palimpsest.operators import relational as R

NOW = datetime(2024, 5, 1)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_a_plan_from_proposal_to_its_end(spark):
    plans = spark.createDataFrame([(1, "proposed"), (2, "proposed")], "id int, status string")
    tasks = spark.createDataFrame([(11, 1, 1, "pending", 0, 1), (12, 1, 2, "pending", 0, 1), (21, 2, 1, "pending", 0, 1)], "id int, plan_id int, ordinal int, status string, attempt int, max_attempts int")
    asked = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    plans, judged = Y.approve(plans, asked)
    assert rows(plans, "id", "status") == [(1, "approved"), (2, "proposed")]
    assert rows(judged, "id", "error") == [(1, None), (9, "plan_missing")]
    assert rows(Y.next_tasks(plans, tasks), "plan_id", "id") == [(1, 11)]
    running = tasks.withColumn("status", F.when(F.col("id") == 11, "running").otherwise(F.col("status")))
    assert Y.next_tasks(plans, running).count() == 0
    failed = spark.createDataFrame([(11, False)], "id int, passed boolean")
    again = Y.settle(running, failed)
    assert rows(again, "id", "status", "attempt") == [(11, "running", 1), (12, "pending", 0), (21, "pending", 0)]
    over = Y.settle(again, failed)
    assert rows(over, "id", "status", "attempt") == [(11, "failed", 1), (12, "skipped", 0), (21, "pending", 0)]
    assert rows(Y.verify_goals(over.withColumnRenamed("plan_id", "goal_id")), "goal_id", "verified") == [(1, False), (2, False)]
    assert Y.settle(tasks.where("false"), failed).count() == 0


def test_prompts_activate_behind_gate_and_approval(spark):
    v = spark.createDataFrame([("p", 1, "a", "active"), ("p", 2, "b", "candidate"), ("p", 3, "c", "candidate"), ("q", 1, "d", "candidate")], "name string, version int, content string, status string")
    asked = spark.createDataFrame([("p", 2), ("p", 3), ("q", 1), ("z", 1)], "name string, version int")
    gates = spark.createDataFrame([("p", 2, "pass"), ("p", 3, "pass"), ("q", 1, "held")], "name string, version int, verdict string")
    approvals = spark.createDataFrame([("p", 2, "granted"), ("p", 3, "pending")], "name string, version int, state string")
    out, judged = Y.activate(v, asked, gates, approvals)
    assert rows(out, "name", "version", "status") == [("p", 1, "retired"), ("p", 2, "active"), ("p", 3, "candidate"), ("q", 1, "candidate")]
    assert rows(judged, "name", "version", "error") == [("p", 2, None), ("p", 3, "not_approved"), ("q", 1, "gate_not_passed"), ("z", 1, "version_missing")]
    new = spark.createDataFrame([("p", "x"), ("n", "y")], "name string, content string")
    assert rows(Y.propose(v, new).where("content in ('x', 'y')"), "name", "version", "status") == [("n", 1, "candidate"), ("p", 4, "candidate")]


def test_approvals_are_decided_once(spark):
    a = spark.createDataFrame([(1, 1, "pending", NOW + timedelta(1), None), (2, 1, "pending", NOW, None), (3, 1, "denied", NOW + timedelta(1), None)], "id int, scope int, state string, expires_at timestamp_ntz, decided_at timestamp_ntz")
    asked = spark.createDataFrame([(1, "granted", 1), (1, "denied", 2), (2, "granted", 1), (3, "granted", 1), (4, "granted", 1)], "id int, verdict string, n int")
    out, judged = Y.decide(a, asked, F.lit(NOW).cast("timestamp_ntz"))
    assert rows(out, "id", "state") == [(1, "granted"), (2, "pending"), (3, "denied")]
    assert rows(judged, "id", "n", "error") == [(1, 1, None), (1, 2, "already_decided"), (2, 1, "expired"), (3, 1, "already_decided"), (4, 1, "approval_missing")]


def test_reports_of_scopes_without_findings(spark):
    e = spark.createDataFrame([(1, "a", NOW), (2, "b", NOW), (3, "b", NOW - timedelta(9))], "id int, scope string, created_at timestamp_ntz")
    none = spark.createDataFrame([], "scope string, phrase string, n long, statement string, status string, confidence double")
    themes = spark.createDataFrame([("a", "tea", 3)], "scope string, phrase string, n long")
    out = A.report(e, themes, none, none, F.lit(NOW - timedelta(2)).cast("timestamp_ntz"), 10)
    assert rows(out, "scope", "episodes_scanned", "n_findings", "findings") == [("a", 1, 1, "theme 0.65: Recurring theme: tea (3 links)"), ("b", 1, 0, "")]


def test_names_and_nulls(spark):
    said = spark.createDataFrame([(1, "The Red Fox ran."), (2, None), (3, "")], "id int, content string")
    names = spark.createDataFrame([("fox",), ("red fox",), ("the fox",), (None,), ("?",)], "name string")
    assert rows(A.unmentioned(names, said), "name") == [("?",), ("the fox",), (None,)]
    labels = spark.createDataFrame([(1, "goal", "Foxes and foxes"), (2, "goal", "a b")], "id int, kind string, label string")
    assert rows(A.mentions(labels, said), "id", "mentions") == [(1, 0)]


def test_a_graph_without_edges(spark):
    nodes = spark.createDataFrame([(1, "e", [1.0, 0.0]), (2, "f", [0.9, 0.1]), (3, None, [0.0, 1.0]), (4, "e", None)], "id long, episode string, embedding array<double>")
    none = spark.createDataFrame([], "edge_id long, src long, dst long")
    assert rows(G.densify(nodes, none, strong=0.9, together=0.9), "lo", "hi", "method") == [(1, 2, "similarity"), (2, 3, "orphan_rescue")]
    assert rows(G.bridges(nodes.where("embedding is not null"), none.select("src", "dst")), "component", "src", "dst") == [(2, 2, 1), (3, 3, 1)]


def test_not_in_as_sql_has_it(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    other = lambda *v: spark.createDataFrame([(x,) for x in v], "b int")
    assert rows(R.not_in(df, "a", other(1)), "a") == [(2,)]
    assert R.not_in(df, "a", other(1, None)).count() == 0 and R.not_in(df, "a", other()).count() == 3


def test_the_first_of_outcomes_with_one_id(spark):
    decisions = spark.createDataFrame([(k, 0.5 if k else 0.9) for k in range(50)], "id long, confidence double")
    # The row that counts lies in another partition than the one that doesn't, and comes later.
    twice = [(k * 10 + 1, k, n == 0, n) for n in (1, 0) for k in range(50)]
    outcomes = spark.createDataFrame(twice, "id long, decision_id long, matched boolean, place int").repartition(5)
    got = Y.record_outcomes(decisions, outcomes, F.lit(NOW).cast("timestamp_ntz"), ["place"])
    assert rows(got, "id", "surprise") == rows(spark.createDataFrame([(k, 0.25 if k else 0.01) for k in range(50)], "id long, s double"), "id", "s")


def test_outcomes_that_say_nothing(spark):
    """As min(id) and arg_min(matched, id) have it: rows without an id are none, and of those without a verdict the id counts."""
    decisions = spark.createDataFrame([(k, 0.5 * k) for k in range(1, 5)], "id long, confidence double")
    seen = [(10, 1, None, 1), (11, 1, True, 2), (None, 1, False, 0), (None, 2, True, 3), (30, 3, None, 4), (40, 4, None, 5), (40, 4, False, 6), (40, 4, True, 7)]
    outcomes = spark.createDataFrame(seen, "id long, decision_id long, matched boolean, place int").repartition(5)
    got = Y.record_outcomes(decisions, outcomes, F.lit(NOW).cast("timestamp_ntz"), ["place"])
    want = [(1, 10, 0.25, NOW), (2, None, None, None), (3, 30, None, NOW), (4, 40, 4.0, NOW)]
    assert rows(got, "id", "outcome_id", "surprise", "reviewed_at") == want
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table oc as select * from (values {', '.join(str(x).replace('None', 'null') for x in seen)}) t(id, decision_id, matched, place)")
    assert con.sql("select decision_id, min(id), arg_min(matched, id) from oc group by 1 order by 1").fetchall() == [(1, 10, True), (2, None, None), (3, 30, None), (4, 40, False)]
