"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans.registry import query
from palimpsest.runtime import read_table, shared_path
from palimpsest.sources import roles
from palimpsest.streaming import projections as P
from palimpsest.streaming import stateful as S


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_projection_replay(spark, d):
    return P.replay(spark, roles.events(spark, d)).select("user_id", "event_type", "event_id", "ts", "value")


def _log(spark, d):
    return P.read_log(spark, P.write_log(roles.events(spark, d), shared_path(spark, "log")))


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_remind_once(spark, d):
    log = P.read_log(spark, P.write_log(roles.events(spark, d), shared_path(spark, "log")), P.FILES_A_STEP)
    return P.remind_once(log, ["user_id", "event_type"], shared_path(spark, "reminded"), shared_path(spark, "offsets")).select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 500 AND (event_type LIKE 'er%' OR event_type LIKE 'sign%')")
def stream_tail(spark, d):
    rows = P.tail(_log(spark, d), 500, ("er", "sign")).select("event_id", "event_type", "user_id")
    return P.append_table(rows, shared_path(spark, "tail"), shared_path(spark, "offsets"))


@query("SELECT w AS started, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type FROM events) GROUP BY 1, 2 HAVING w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windows(spark, d):
    """Windows that the watermark has passed at the end of the log."""
    rows = P.windowed_counts(_log(spark, d), "1 day")
    out = P.append_table(rows, shared_path(spark, "windows"), shared_path(spark, "offsets"))
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n")


@query("SELECT user_id, event_type, event_id, value <= 200 AS tombstone, CASE WHEN value > 200 THEN value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_tombstones(spark, d):
    """The last event of each key by a state store; some events end what they are about."""
    events = roles.events(spark, d).select("event_id", "user_id", "event_type", F.when(F.col("value") > 200, "stored").otherwise("invalidated").alias("kind"), "value")
    log = P.read_log(spark, P.write_log(events, shared_path(spark, "log"), 2), 8, events.schema)
    return S.current_state(log, ["user_id", "event_type"], "event_id", *S.fresh_paths(spark, "last"), kind="kind", ends=("invalidated",)).select("user_id", "event_type", "event_id", "tombstone", "value")


def _commands(spark, d):
    """Line items as tasks of their orders, and verdicts on those that run."""
    x = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    status = F.when(F.col("l_linenumber") == 1, "running").when(F.col("l_linenumber") == 2, "dispatched").otherwise("pending")
    tasks = x.select(F.col("l_orderkey").alias("plan_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), status.alias("status"), (F.col("l_quantity").cast("int") % 2 + 1).alias("attempt"), F.lit(2).alias("max_attempts"))
    made = tasks.select("plan_id", F.col("id").alias("seq"), F.lit("task").alias("command"), "id", "status", "attempt", "max_attempts", F.lit(None).cast("boolean").alias("passed"))
    judged = tasks.where("id % 10 <= 2").select("plan_id", (F.col("id") + (1 << 40)).alias("seq"), F.lit("verdict").alias("command"), "id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("int").alias("max_attempts"), (F.col("id") % 3 == 0).alias("passed"))
    return made.unionByName(judged).select(*S.COMMANDS.fieldNames())


@query("""WITH t AS (SELECT l_orderkey AS plan_id, l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber WHEN 1 THEN 'running' WHEN 2 THEN 'dispatched' ELSE 'pending' END AS status, l_quantity::INT % 2 + 1 AS attempt FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
s AS (SELECT plan_id, id, CASE WHEN status = 'pending' THEN status WHEN id % 3 = 0 THEN 'completed' WHEN attempt < 2 THEN 'running' ELSE 'failed' END AS status, CASE WHEN status <> 'pending' AND id % 3 <> 0 AND attempt < 2 THEN attempt + 1 ELSE attempt END AS attempt FROM t), b AS (SELECT DISTINCT plan_id FROM s WHERE status = 'failed')
SELECT plan_id, id, CASE WHEN status = 'pending' AND plan_id IN (SELECT plan_id FROM b) THEN 'skipped' ELSE status END AS status, attempt FROM s""")
def stream_plans(spark, d):
    """Plans by a stream of commands, with a state of each plan."""
    commands = _commands(spark, d)
    log = P.read_log(spark, P.write_log(commands, shared_path(spark, "log"), 2, "seq"), 8, S.COMMANDS)
    return S.settled(log, *S.fresh_paths(spark, "plans"))


_ASKED = "SELECT o_orderkey AS id, o_orderdate AS since, o_orderdate + INTERVAL 30 DAY AS expires, o_orderdate + to_days((o_orderkey % 60)::INT) AS decided, o_orderkey % 3 = 0 AS judged FROM orders"


@query(f"""WITH a AS ({_ASKED}), w AS (SELECT max(t) - INTERVAL 90 MINUTE AS mark FROM (SELECT max(since) AS t FROM a UNION ALL SELECT max(decided) FROM a WHERE judged))
SELECT id, CASE WHEN judged AND decided < expires THEN CASE WHEN id % 2 = 0 THEN 'granted' ELSE 'denied' END WHEN expires <= mark THEN 'expired' ELSE 'pending' END AS state, CASE WHEN judged AND decided < expires THEN decided WHEN expires <= mark THEN expires ELSE since END AS since FROM a, w""")
def stream_approvals(spark, d):
    """Approvals that are decided in time, or run out when the watermark passes their end."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    asked = o.select("id", (F.col("id") * 2).alias("seq"), F.lit("asked").alias("command"), "at", (F.col("at") + F.expr("interval 30 days")).alias("expires"))
    decided = o.where("id % 3 = 0").select("id", (F.col("id") * 2 + 1).alias("seq"), F.when(F.col("id") % 2 == 0, "granted").otherwise("denied").alias("command"), (F.col("at") + F.make_dt_interval((F.col("id") % 60).cast("int"))).alias("at"), F.lit(None).cast("timestamp").alias("expires"))
    # All files are one batch: the log lies in the order of orders, not of time.
    log = P.read_log(spark, P.write_log(asked.unionByName(decided), shared_path(spark, "log"), 1, "seq"), 10_000, S.REQUESTS)
    return S.approvals(log, *S.fresh_paths(spark, "approvals")).select("id", "state", F.col("at").cast("timestamp_ntz").alias("since"))
