"""Operators against hand-written fixtures."""

import hashlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import consolidation as C
from palimpsest.operators import decisions as D
from palimpsest.operators import graph as G
from palimpsest.operators import relational as R
from palimpsest.operators import retrieval as V
from palimpsest.operators import temporal as T

NOW = datetime(2024, 1, 31)


def at(t):
    return F.lit(t).cast("timestamp_ntz")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bitemporal_switch(spark):
    df = spark.createDataFrame([(1, NOW - timedelta(7), NOW, 2), (2, NOW, None, None)], "id int, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by int")
    assert rows(T.as_of(df, at(NOW)), "id") == [(2,)]
    assert rows(T.as_of(df, at(NOW - timedelta(3))), "id") == [(1,)]
    assert T.validity(df, "superseded").count() == 1 and T.validity(df, "all").count() == 2
    assert rows(T.last_of_chain(df), "id", "current") == [(1, 2), (2, 2)]


def test_identity_race_and_gate(spark):
    df = spark.createDataFrame([(k, "name", c, NOW + timedelta(k)) for k, c in enumerate((0.70, 0.90, 0.90, 0.80))], "id int, p string, confidence double, created_at timestamp_ntz")
    got = rows(T.running_winners(df, ["p"], ["created_at", "id"]), "id", "status", "superseded_by")
    assert got == [(0, "hypothesis", 1), (1, "canonical", None)]
    gate = spark.createDataFrame([(1, "a", 0.74, NOW), (2, "b", 0.75, NOW), (3, "c", 0.9, NOW)], "id int, p string, confidence double, created_at timestamp_ntz")
    assert rows(T.running_winners(gate, ["p"], ["id"]), "id", "status") == [(1, "hypothesis"), (2, "canonical"), (3, "canonical")]


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert rows(R.upsert(old, new, ["id"]), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(R.insert_ignore(old, new, ["id"]), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(R.keep_first(old.union(new), ["id"], [F.desc("v")]), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(R.repoint(old, "id", spark.createDataFrame([(1, 9)], "old int, new int")), "id") == [(2,), (9,)]


def test_gap_days_and_segments(spark):
    df = spark.createDataFrame([(1, NOW), (2, NOW + timedelta(days=3, hours=23)), (3, NOW + timedelta(days=7, hours=23))], "id int, ts timestamp_ntz").withColumn("k", F.lit(1))
    assert rows(R.gap_sessions(df, ["k"], "ts", "4 DAYS"), "id", "session") == [(1, 0), (2, 0), (3, 1)]
    low = {2, 4}
    seg = spark.createDataFrame([(1, k, k in low) for k in range(5)], "k int, i int, s boolean")
    assert rows(R.segments(seg, ["k"], "i", F.col("s")), "i", "segment") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_hash_chain_and_tamper(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "c")], "run string, n int, body string")
    chain = R.hash_chain(df, ["run"], "n", F.col("body"))
    prev, want = "0" * 64, []
    for n, body in ((1, "a"), (2, "b"), (3, "c")):
        entry = hashlib.sha256((prev + hashlib.sha256(body.encode()).hexdigest()).encode()).hexdigest()
        want.append((n, prev, entry))
        prev = entry
    assert sorted(rows(chain, "n", "prev_hash", "entry_hash")) == want
    good = chain.join(df, ["run", "n"])
    assert rows(R.first_break(good, ["run"], "n", F.col("body")), "broken_at") == [(None,)]
    bad = good.withColumn("body", F.when(F.col("n") == 2, "x").otherwise(F.col("body")))
    assert rows(R.first_break(bad, ["run"], "n", F.col("body")), "broken_at") == [(2,)]


def test_run_lengths_and_interleave(spark):
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate([True, True, False, True])], "k int, n int, f boolean")
    assert rows(R.run_lengths(df, ["k"], ["n"], F.col("f")), "n", "consecutive") == [(0, 1), (1, 2), (2, 0), (3, 1)]
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "k int, n int, kind string")
    assert rows(R.interleave(df, ["k"], "kind", ["n"], ["b", "a"]), "n", "place") == [(1, 2), (2, 4), (3, 1)]


@pytest.fixture(scope="module")
def cycle(spark):
    return spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 4, 4), (5, 1, 2), (6, 7, 8)], "edge_id int, src int, dst int").withColumn("rel_type", F.lit("r"))


def test_cycle_graph(spark, cycle):
    degree = {r["node"]: r["degree"] for r in G.degree(cycle).collect()}
    assert degree == {1: 3, 2: 3, 3: 2, 4: 2, 7: 1, 8: 1}
    seed = spark.createDataFrame([(1,)], "node int")
    assert rows(G.k_hop(cycle, seed, 5), "node", "depth") == [(2, 1), (3, 2)]
    assert rows(G.k_hop(cycle, seed, 5, directed=False), "node", "depth") == [(2, 1), (3, 1)]
    assert rows(G.components(cycle), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (7, 7), (8, 7)]
    merged = G.merge_edges(cycle, spark.createDataFrame([(2, 1)], "old int, new int"))
    assert rows(merged, "edge_id", "src", "dst") == [(2, 1, 3), (3, 3, 1), (6, 7, 8)]
    assert rows(G.neighbours(cycle, spark.createDataFrame([(4,)], "node int")), "other", "direction") == [(4, "in"), (4, "out")]


def test_long_path_is_one_component(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.components(path).select("component").distinct().count() == 1


def test_cooccurrence_by_blocks(spark):
    m = spark.createDataFrame([("g", k) for k in range(5)] + [("h", 0), ("h", 1), ("h", 1)], "group string, node int")
    want = [(a, b, 2 if (a, b) == (0, 1) else 1) for a in range(5) for b in range(a + 1, 5)]
    assert rows(G.cooccurrence(m, block=2), "lo", "hi", "n") == rows(G.cooccurrence(m), "lo", "hi", "n") == want


def test_cooccurrence_of_large_groups(spark, tmp_path):
    import duckdb

    from palimpsest.plans import ORACLES, QUERIES

    lines = [(1, k) for k in range(150)] + [(2, k) for k in range(0, 300, 3)] + [(3, 5), (3, 6), (3, 6), (4, 7), (None, 8), (None, 9)]
    m = spark.createDataFrame(lines, "l_orderkey long, l_partkey long")
    m.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["densify_cooccurrence"]).fetchall())
    assert len(want) == 14_900
    assert sorted(tuple(r) for r in QUERIES["densify_cooccurrence"](spark, str(tmp_path)).collect()) == want
    assert sorted(tuple(r) for r in G.cooccurrence(m, "l_orderkey", "l_partkey", block=16).collect()) == want


def test_cooccurrence_grows_in_tasks(spark, monkeypatch):
    """Where there are more rows, there are more tasks, and not larger ones."""
    m = spark.createDataFrame([(k // 4, k % 97) for k in range(4000)], "group long, node long")
    want = sorted(tuple(r) for r in G.cooccurrence(m).collect())
    monkeypatch.setattr(G, "TASK_ROWS", 100)
    out = G.cooccurrence(m)
    assert out.rdd.getNumPartitions() == 60 and sorted(tuple(r) for r in out.collect()) == want
    assert sorted(tuple(r) for r in G.cooccurrence(m, block=2).collect()) == want


def test_trigrams_are_counted_within_rows(spark, tmp_path):
    """Odd texts as SQL has them, repeated and null keys too, and no row for a trigram."""
    import duckdb

    from palimpsest.plans import ORACLES, QUERIES

    said = ["The cat sat", None, "", "ab", "abc", "\u00c9t\u00c9 \u00e9t\u00e9 \u0391\u03a3 \u0391\u03a3 x", "the CAT sat on the cat", "\U0001f600\U0001f600\U0001f600 cat", "aaaaaaa", "caf\u00c9 the cat"]
    lines = [(c, k, "user", said[(k * (c + 1) + c) % len(said)]) for c in range(4) for k in range(10)] + [(None, k, "user", "the cat") for k in range(3)] + [(9, k, "user", "one and the same") for k in (0, 1, 1, 1)]
    spark.createDataFrame(lines, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = Counter(con.execute(ORACLES["eval_trigram"]).fetchall())
    out = QUERIES["eval_trigram"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in out.collect()) == want
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_context_lines(spark, cycle):
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(9)], "id int, name string")
    line = {r["node"]: r["line"] for r in G.context_lines(nodes, cycle, 2).collect()}
    assert line[1] == "-> n2; <- n3; -> n2"


def test_rrf_three_channels(spark):
    ch = lambda ids: spark.createDataFrame([(1, i, k + 1, 1.0) for k, i in enumerate(ids)], "query int, id int, rank int, score double")
    rec = spark.createDataFrame([(1, 1.0)], "id int, recency double")
    got = {r["id"]: r for r in V.rrf({"a": ch([1, 2]), "b": ch([2, 1]), "c": ch([2])}, rec).collect()}
    assert got[2]["fused_score"] == pytest.approx(1 / 62 + 2 / 61) and got[2]["channels"] == "a,b,c"
    assert got[1]["fused_score"] == pytest.approx((1 / 61 + 1 / 62) * 1.3)


def pack(items, budget):
    """The packing rule, one item after the other."""
    caps = {t: int(s * budget) for t, s in V.TIER_SHARES.items()}
    kept, used, tiers, seen = [], 0, {}, set()
    for place, tier, tokens, head in items:
        if head in seen:
            continue
        seen.add(head)
        if tiers.get(tier, 0) + tokens > caps.get(tier, caps["semantic"]):
            continue
        if used + tokens > budget:
            break
        kept.append(place)
        tiers[tier] = tiers.get(tier, 0) + tokens
        used += tokens
    return kept


@pytest.mark.parametrize("budget", [10, 50, 100, 400])
def test_pack_budget(spark, budget):
    items = [(1, "semantic", 30, "a"), (2, "semantic", 12, "b"), (3, "episodic", 20, "a"), (4, "episodic", 25, "c"), (5, "fact", 35, "d"), (6, "working", 9, "e"), (7, "graph", 20, "f"), (8, "graph", 3, "b")]
    df = spark.createDataFrame([(items,)], "x array<struct<place:bigint,tier:string,tokens:bigint,head:string>>")
    assert df.select(V.pack_fold(F.col("x"), budget)).first()[0] == pack(items, budget)


def test_mmr(spark):
    items = [(1, 1.0, ["a", "b"]), (2, 0.9, ["a", "b"]), (3, 0.5, ["c"]), (4, 0.4, ["c", "d"])]
    left, picked = list(items), []
    while left:
        value = lambda x: 0.5 * x[1] - 0.5 * max((len(set(x[2]) & set(p[2])) / max(len(x[2]), 1) for p in picked), default=0)
        best = max(left, key=lambda x: (round(value(x), 12), -x[0]))
        picked.append(best)
        left.remove(best)
    df = spark.createDataFrame([(items,)], "x array<struct<place:bigint,score:double,words:array<string>>>")
    assert df.select(V.mmr_fold(F.col("x"), 9)).first()[0] == [p[0] for p in picked]


def test_knn_blocks_agree(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    assert rows(V.knn(q, v, 3), "query", "id", "rank") == rows(V.knn(q, v, 3, block=3), "query", "id", "rank")


def test_follow_up():
    assert V.follow_up("spark", []) == "spark details"
    assert V.follow_up("one two three four", [0.01]) == "one two three" and V.follow_up("one", [0.01]) == "one overview"
    assert V.follow_up("what is x and how is y", [0.5]) == "How is y" and V.follow_up("what is x", [0.5]) is None


def test_decay_60d(spark):
    df = spark.createDataFrame([(1, 0.5, NOW - timedelta(60), "validated"), (2, 0.06, NOW - timedelta(90), "provisional"), (3, 0.5, NOW + timedelta(1), "validated")], "id int, confidence double, created_at timestamp_ntz, status string")
    df = df.withColumn("last_reinforced_at", F.col("created_at")).withColumn("last_decayed_at", F.col("created_at"))
    assert rows(D.decay_lessons(df, at(NOW)), "id", "confidence", "status") == [(1, 0.125, "validated"), (2, 0.06, "retired"), (3, 0.5, "validated")]


def test_reinforce_3(spark):
    lessons = spark.createDataFrame([(1, 1, 0.5, "provisional")], "id int, support_count int, confidence double, status string")
    got = D.reinforce(lessons, spark.createDataFrame([(1,), (1,)], "id int")).first()
    assert (got["support_count"], round(got["confidence"], 9), got["status"]) == (3, 0.7, "validated")


def test_dup_chain(spark):
    v = [(1, "s", [1.0, 0.0], 1), (2, "s", [0.95, 0.312], 2), (3, "s", [0.8, 0.6], 3), (4, "t", [1.0, 0.0], 4)]
    df = spark.createDataFrame(v, "id long, scope string, embedding array<double>, created int")
    for block in (1, 2, 1024):
        assert rows(C.similarity_classes(df, tau=0.94, block=block), "id", "class_id", "n_links") == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 0)]
    assert rows(C.similarity_classes(df, tau=0.94, newest=2), "id", "class_id", "n_links") == [(1, 1, 0), (2, 2, 1), (3, 2, 1), (4, 4, 0)]
    for block in (1, 1024):
        assert rows(C.duplicates(df.withColumn("key", F.lit("k")), tau=0.7, block=block), "id", "superseded_by") == [(1, 3), (2, 3)]
        assert rows(C.duplicates(df.withColumn("key", F.col("id").cast("string")), tau=0.7, auto=0.94, block=block), "id", "superseded_by") == [(1, 2), (2, 3)]


def test_passes_run_in_order(spark):
    df = spark.range(3)
    passes = {name: (lambda s, name=name: {"m": s["m"].unionByName(spark.range(1))}) for name in ("dedup", "projection")}
    state, done = C.run_passes({"m": df}, passes)
    assert done == ["projection", "dedup"] and state["m"].count() == 5
    assert C.run_passes({"m": df}, {}, "deep")[1] == []


def test_order_over_ranges(spark):
    import random

    rng = random.Random(1)
    data = [("a" if k % 3 else rng.choice("abc"), k, rng.random() < 0.5) for k in range(300)]
    df = spark.createDataFrame(data, "g string, k long, s boolean")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seg, before, place = {}, {}, {}
        for g in "abc":
            n = number = 0
            last = None
            for at, (_, k, s) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: r[1])):
                n, number = (1, number + 1) if s and n >= 3 else (n + 1, number)
                seg[g, k], before[g, k], place[g, k] = number, last, at + 1
                last = k if k % 5 else None
        assert {(r["g"], r["k"]): r["segment"] for r in R.segments(df, ["g"], "k", F.col("s")).collect()} == seg
        assert {(r["g"], r["k"]): r["b"] for r in R.previous(df.withColumn("v", F.when(F.col("k") % 5 != 0, F.col("k"))), ["g"], ["k"], "v", "b").collect()} == before
        assert {(r["g"], r["k"]): r["n"] for r in R.numbered(df, ["g"], ["k"]).collect()} == place
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_projection_and_replay(spark):
    log = spark.createDataFrame([("a", 1, "stored", 1, "x"), ("a", 2, "other", 1, "y"), ("a", 3, "invalidated", 1, "z"), ("b", 4, "stored", 2, "w")], "scope string, seq long, kind string, id int, body string")
    none = spark.createDataFrame([], "scope string, seq long")
    state, marks = C.project_events(log, none)
    assert rows(state, "id", "seq", "body", "tombstone") == [(1, 3, None, True), (2, 4, "w", False)]
    assert rows(marks, "scope", "seq") == [("a", 3), ("b", 4)]
    state, again = C.project_events(log, marks)
    assert state.count() == 0 and rows(again, "scope", "seq") == rows(marks, "scope", "seq")


def test_forget_needs_its_approval(spark):
    mem = spark.createDataFrame([(1, "user:a", "s", "k", None), (2, "user:a", "t", "l", None)], "id int, scope string, statement string, statement_key string, valid_to timestamp_ntz")
    ask = spark.createDataFrame([(1, "user:a", "p1"), (2, "user:a", "p1"), (2, "user:a", "p2"), (2, "user:a", "p3"), (2, "user:b", "p4"), (2, "user:a", "none")], "memory_id int, scope string, approval_id string")
    ok = spark.createDataFrame([("p1", "user:a", "memory_forget_hard", "granted", NOW + timedelta(1)), ("p2", "user:a", "memory_forget_hard", "granted", NOW), ("p3", "user:a", "read", "granted", NOW + timedelta(1)), ("p4", "user:a", "memory_forget_hard", "granted", NOW + timedelta(1))], "id string, scope string, action_class string, state string, expires_at timestamp_ntz")
    out, judged = C.forget(mem, ask, ok, at(NOW))
    assert rows(out, "id", "statement", "statement_key") == [(1, "[redacted]", None), (2, "t", "l")]
    assert rows(judged, "reason") == sorted([(None,), ("approval_already_used",), ("approval_expired",), ("approval_class_mismatch",), ("approval_scope_mismatch",), ("approval_missing",)], key=repr)


def test_recombine_band(spark):
    m = spark.createDataFrame([(1, "a", "alpha beta gamma delta"), (2, "a", "alpha beta other words"), (3, "a", "alpha beta gamma delta"), (4, "b", "alpha beta other words")], "id int, scope string, statement string")
    m = m.withColumn("status", F.lit("canonical")).withColumn("valid_to", F.lit(None)).withColumn("created_at", F.lit(NOW))
    assert rows(C.recombine(m), "id1", "id2", "overlap") == [(1, 2, 0.5), (2, 3, 0.5)]


def test_policy_cases(spark):
    base = dict(action_class="file_edit", agent_default="full_auto", workspace_override="full_auto", tools=["file_edit", "spend", "self_modify", "net_egress", "external_post"], kill_unreadable=False, kill_global=False, kill_agent=False, tokens=0, tokens_limit=9, tool_actions=0, tool_actions_limit=9, usd=0.0, usd_limit=9.0, seconds=0, seconds_limit=9, host=None, egress_allow=["a"], approval_state=None, eval_verdict=None, force_dry_run=False, channel=None, amount_usd=None)
    cases = [
        ({}, "ALLOW", "auto_allow", "bounded_auto", "action_class_floor"),
        ({"action_class": "read", "kill_global": True, "agent_default": "suggest_only"}, "ALLOW", "read_no_side_effect", "suggest_only", None),
        ({"kill_agent": True}, "DENY", "kill_switch_active", "suggest_only", "action_class_floor"),
        ({"tools": []}, "DENY", "capability_grant_missing", "suggest_only", "action_class_floor"),
        ({"action_class": "net_egress", "host": "b"}, "DENY", "net_egress_host_not_in_allowlist", "bounded_auto", "action_class_floor"),
        ({"action_class": "net_egress"}, "DENY", "net_egress_host_not_in_allowlist", "bounded_auto", "action_class_floor"),
        ({"tokens": 9}, "DENY", "budget_hard_limit_exceeded", "bounded_auto", "action_class_floor"),
        ({"action_class": "spend", "amount_usd": 25.0}, "ALLOW", "auto_allow", "full_auto", "action_class_floor"),
        ({"action_class": "spend", "amount_usd": 25.01}, "REQUIRE_APPROVAL", "gated_at_confirm_each", "confirm_each", "action_class_floor"),
        ({"action_class": "external_post"}, "REQUIRE_APPROVAL", "gated_at_confirm_each", "confirm_each", "action_class_floor"),
        ({"action_class": "external_post", "channel": "private"}, "ALLOW", "auto_allow", "full_auto", "action_class_floor"),
        ({"action_class": "self_modify", "approval_state": "granted"}, "DENY", "self_modify_eval_gate_unsatisfied", "confirm_each", "action_class_floor"),
        ({"action_class": "self_modify", "approval_state": "granted", "eval_verdict": "pass"}, "ALLOW", "self_modify_dual_gate_satisfied", "confirm_each", "action_class_floor"),
        ({"force_dry_run": True}, "DRY_RUN", "dry_run_requested", "bounded_auto", "action_class_floor"),
        ({"workspace_override": "confirm_each", "approval_state": "granted"}, "ALLOW", "approval_granted", "confirm_each", "workspace_override"),
        ({"agent_default": "suggest_only"}, "DENY", "suggest_only_no_side_effect", "suggest_only", None),
        ({"action_class": "fly"}, "DENY", "unknown_action_class_fail_closed", "suggest_only", "action_class_floor"),
    ]
    schema = "id int, action_class string, agent_default string, workspace_override string, tools array<string>, kill_unreadable boolean, kill_global boolean, kill_agent boolean, tokens int, tokens_limit int, tool_actions int, tool_actions_limit int, usd double, usd_limit double, seconds int, seconds_limit int, host string, egress_allow array<string>, approval_state string, eval_verdict string, force_dry_run boolean, channel string, amount_usd double"
    df = spark.createDataFrame([(k, *{**base, **c[0]}.values()) for k, c in enumerate(cases)], schema)
    got = {r["id"]: (r["verdict"], r["reason"], r["effective_level"], r["clamped_by"]) for r in D.policy(df).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_approvals_expire(spark):
    df = spark.createDataFrame([(1, "pending", NOW, None), (2, "pending", NOW + timedelta(1), None), (3, "granted", NOW, NOW)], "id int, state string, expires_at timestamp_ntz, decided_at timestamp_ntz")
    assert rows(D.approvals_at(df, at(NOW)), "id", "state") == [(1, "expired"), (2, "pending"), (3, "granted")]


def test_contained_share(spark):
    df = spark.createDataFrame([("The Cat sat", ["cat", "DOG"]), ("x", [])], "r string, e array<string>")
    assert [r[0] for r in df.select(X.share_contained(F.col("r"), F.col("e"))).collect()] == [0.5, 0.0]
