"""Keyed state that streams keep in a state store: last events with tombstones, task plans, approvals that run out.

Each machine is a stateful processor over a log in order of its sequence. A batch touches the state of the keys (last events) or groups of keys (plans, approvals) that it has rows of, and what changed is appended to
a table by the file sink, once. The last change of each key is the state, so a stream that stops between batches goes on where it was, and a replay
from an empty checkpoint gives the same. State lies in the RocksDB store, beside the checkpoint, and isn't held in memory.

Defined results: rows with a null key are one key; of rows of one sequence number the first counts; what comes again changes nothing."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.runtime import shared_path
from palimpsest.streaming.projections import append_table

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tasks that a verdict can be about; what a task that isn't over may be.
OPEN = ("dispatched", "running")


@contextmanager
def _stored(spark: SparkSession) -> Iterator[None]:
    """Streams that start within have their state in RocksDB, which these processors need."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def changes(stream: DataFrame, key: list[str], machine: StatefulProcessor, out: T.StructType, path: str, checkpoint: str, time: str = "None") -> DataFrame:
    """Runs the stream to its end; returns all changes so far (out, with key columns first and `n`, the number of the change of its key)."""
    with _stored(stream.sparkSession):
        return append_table(stream.groupBy(*key).transformWithState(machine, out, "Append", time), path, checkpoint)


def last_changes(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last change of each key, without its number."""
    rest = [c for c in rows.columns if c not in key and c != "n"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "n").alias("last"))
    return last.select(*key, *[F.col("last")[c].alias(c) for c in rest])


#: Plans and approvals are few rows each, so many of them share one state: it is read and written once a step, not once a plan.
GROUPS = 1 << 13


def grouped(stream: DataFrame, of: str) -> DataFrame:
    return stream.withColumn("bucket", F.pmod(F.xxhash64(of), F.lit(GROUPS)).cast("int"))


def _load(state) -> dict:
    return pickle.loads(state.get()[0]) if state.exists() else {}


class _Machine(StatefulProcessor):
    def close(self) -> None:
        pass


# Last events -------------------------------------------------------------------------------------------------------


class LastEvent(_Machine):
    """Of each key the row with the greatest sequence number; a row whose kind ends it leaves a tombstone without a body."""

    def __init__(self, key: list[str], out: T.StructType, seq: str, kind: str | None, ends: tuple[str, ...]) -> None:
        self.names, self.key, self.seq, self.kind, self.ends = out.fieldNames(), key, seq, kind, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long, n long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        at, n = self.seen.get() if self.seen.exists() else (None, 0)
        best = None
        for r in rows:
            if (at is None or r[self.seq] > at) and (best is None or r[self.seq] > best[self.seq]):
                best = r
        if best is not None:
            self.seen.update((best[self.seq], n + 1))
            gone = self.kind is not None and best[self.kind] in self.ends
            made = {**best.asDict(), **dict(zip(self.key, key, strict=True)), "tombstone": gone, "n": n + 1}
            yield Row(**{c: None if gone and c not in (*self.key, self.seq, "tombstone", "n") else made[c] for c in self.names})


def current_state(log: DataFrame, key: list[str], seq: str, path: str, checkpoint: str, kind: str | None = None, ends: tuple[str, ...] = ()) -> DataFrame:
    """The last event of each key, with `tombstone`: whether its kind is one of `ends`."""
    out = T.StructType([log.schema[c] for c in key] + [f for f in log.schema if f.name not in key] + [T.StructField("tombstone", T.BooleanType()), T.StructField("n", T.LongType())])
    return last_changes(changes(log, key, LastEvent(key, out, seq, kind, ends), out, path, checkpoint), key)


# Plans -------------------------------------------------------------------------------------------------------------


class PlanTasks(_Machine):
    """The tasks of each plan, by commands in the order of their numbers: `task` makes one, `verdict` says whether it passed. As `lifecycles.settle` has it for a table: passed tasks are completed, failed ones run
    again while they have attempts left, and where one fails for good the plan's pending ones are skipped.

    Rows of a key come in several calls and in any order, so the commands of a plan (few) are kept and folded anew; what is told is what has changed by it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # plan: its commands by number, and what was told of each task.
        self.state = handle.getValueState("state", "plans binary")

    @staticmethod
    def fold(commands: Iterable[tuple]) -> dict[int, list]:
        """id: [status, attempt, max_attempts]; of commands in order."""
        tasks: dict[int, list] = {}
        for command, id_, status, attempt, most, passed in commands:
            if command == "task":
                tasks.setdefault(id_, [status, attempt, most])
            elif id_ in tasks and tasks[id_][0] in OPEN:
                own = tasks[id_]
                if passed:
                    own[0] = "completed"
                elif own[1] < own[2]:
                    own[:2] = ["running", own[1] + 1]
                else:
                    own[0] = "failed"
                    for other in tasks.values():
                        if other[0] == "pending":
                            other[0] = "skipped"
        return tasks

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        plans, touched = _load(self.state), set()
        for r in rows:
            touched.add(r["plan_id"])
            plans.setdefault(r["plan_id"], ({}, {}))[0].setdefault(r["seq"], (r["command"], r["id"], r["status"], r["attempt"], r["max_attempts"], r["passed"]))
        out = []
        for plan in touched:
            log, told = plans[plan]
            for id_, (status, attempt, _) in self.fold(v for _, v in sorted(log.items())).items():
                known = told.get(id_, (None, None, 0))
                if (status, attempt) != known[:2]:
                    told[id_] = (status, attempt, known[2] + 1)
                    out.append(Row(plan_id=plan, id=id_, status=status, attempt=attempt, n=known[2] + 1))
        self.state.update((pickle.dumps(plans),))
        yield from out


COMMANDS = T.StructType([T.StructField(c, t) for c, t in (("plan_id", T.LongType()), ("seq", T.LongType()), ("command", T.StringType()), ("id", T.LongType()), ("status", T.StringType()), ("attempt", T.IntegerType()), ("max_attempts", T.IntegerType()), ("passed", T.BooleanType()))])


def settled(commands: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """plan_id, id, status, attempt of all tasks after a stream of commands (COMMANDS). A task that is made after one of its plan has failed stays pending, as it does between two calls of `settle`."""
    out = T.StructType([T.StructField("plan_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("n", T.LongType())])
    return last_changes(changes(grouped(commands, "plan_id"), ["bucket"], PlanTasks(), out, path, checkpoint), ["plan_id", "id"])


# Approvals ---------------------------------------------------------------------------------------------------------


class Approval(_Machine):
    """Approvals: pending once they are asked for, then granted or denied by the first decision before their end, or expired when the watermark passes that; what has expired stays so.

    As for plans, their few commands are kept, since they may come in any order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # id: its commands by number, the state that was told, how many were, and when it ends.
        self.state = handle.getValueState("state", "approvals binary")

    @staticmethod
    def fold(commands: Iterable[tuple]) -> tuple:
        """state, since when, and when it ends; of commands in order."""
        state, since, end = None, None, None
        for command, at, expires in commands:
            if command == "asked":
                state, since, end = (state, since, end) if state else ("pending", at, expires)
            elif state == "pending" and at < end:
                state, since = command, at
        return state, since, end

    @staticmethod
    def _ms(end) -> int:
        return int(end.timestamp() * 1000)

    def _wait(self, known: dict) -> None:
        """One timer, for the next end of what is pending."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        ends = [self._ms(x[3]) for x in known.values() if x[1] == "pending"]
        if ends:
            self.handle.registerTimer(min(ends))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        known, touched, out = _load(self.state), set(), []
        for r in rows:
            touched.add(r["id"])
            known.setdefault(r["id"], [{}, None, 0, None])[0].setdefault(r["seq"], (r["command"], r["at"], r["expires"]))
        for id_ in touched:
            own = known[id_]
            state, at, end = self.fold(v for _, v in sorted(own[0].items()))
            if state != own[1] and own[1] != "expired":
                own[1:] = state, own[2] + 1, end
                out.append(Row(id=id_, state=state, at=at, n=own[2]))
        self.state.update((pickle.dumps(known),))
        self._wait(known)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, out, now = _load(self.state), [], timerValues.getCurrentWatermarkInMs()
        for id_, own in known.items():
            if own[1] == "pending" and self._ms(own[3]) <= now:
                own[1:3] = "expired", own[2] + 1
                out.append(Row(id=id_, state="expired", at=own[3], n=own[2]))
        if out:
            self.state.update((pickle.dumps(known),))
            self._wait(known)
        yield from out


REQUESTS = T.StructType([T.StructField(c, t) for c, t in (("id", T.LongType()), ("seq", T.LongType()), ("command", T.StringType()), ("at", T.TimestampType()), ("expires", T.TimestampType()))])


def approvals(requests: DataFrame, path: str, checkpoint: str, late: str = "90 minutes") -> DataFrame:
    """id, state, at of all approvals after a stream of requests and decisions (REQUESTS; command: asked, granted or denied) in order of their times, up to the watermark."""
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("n", T.LongType())])
    return last_changes(changes(grouped(requests.withWatermark("at", late), "id"), ["bucket"], Approval(), out, path, checkpoint, "EventTime"), ["id"])


def fresh_paths(spark: SparkSession, kind: str) -> tuple[str, str]:
    """Paths of a table of changes and of a checkpoint."""
    return shared_path(spark, kind), shared_path(spark, f"{kind}-offsets")
