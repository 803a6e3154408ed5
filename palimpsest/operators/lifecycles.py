"""Life cycles: plans and their tasks, prompts, sketches, approvals, decisions and lessons. Each step is a transform of frames and of what happened; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import scalars as S
from palimpsest.operators.relational import keep_first
from palimpsest.operators.retrieval import knn

# Plans --------------------------------------------------------------------------------------------------------------


def approve(plans: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, requests with their error): proposed plans that are asked for (id) are approved."""
    a = asked.select("id").distinct().withColumn("__asked", F.lit(True))
    rows = plans.join(a, "id", "left")
    out = rows.withColumn("status", F.when(F.col("__asked") & (F.col("status") == "proposed"), "approved").otherwise(F.col("status"))).drop("__asked")
    judged = a.drop("__asked").join(plans.select("id", "status"), "id", "left").select("id", F.when(F.col("status").isNull(), "plan_missing").when(F.col("status") != "proposed", "not_proposed").alias("error"))
    return out, judged


def next_tasks(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """plan_id, id: the task that each approved or executing plan runs next: of its pending ones the first, if none is running and none has failed."""
    live = plans.where(F.col("status").isin("approved", "executing")).select(F.col("id").alias("plan_id"))
    pending = F.col("status") == "pending"
    state = tasks.groupBy("plan_id").agg(F.bool_or(F.col("status").isin("dispatched", "running", "failed")).alias("busy"), F.min(F.when(pending, F.struct("ordinal", "id"))).alias("next"))
    return state.where(~F.col("busy") & F.col("next").isNotNull()).join(live, "plan_id", "left_semi").select("plan_id", F.col("next.id").alias("id"))


def settle(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tasks after verdicts (id, passed): passed ones are completed, failed ones run again while they have attempts left; where one fails for good the plan's pending ones are skipped.

    tasks: id, plan_id, status, attempt, max_attempts."""
    rows = tasks.join(verdicts.select("id", "passed"), "id", "left")
    judged = F.col("passed").isNotNull() & F.col("status").isin("dispatched", "running")
    again = judged & ~F.col("passed") & (F.col("attempt") < F.col("max_attempts"))
    rows = rows.withColumn("status", F.when(judged & F.col("passed"), "completed").when(again, "running").when(judged, "failed").otherwise(F.col("status"))).withColumn("attempt", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")))
    broken = rows.where(judged_failed()).select("plan_id").distinct().withColumn("__broken", F.lit(True))
    out = rows.join(broken, "plan_id", "left")
    return out.withColumn("status", F.when(F.col("__broken") & (F.col("status") == "pending"), "skipped").otherwise(F.col("status"))).drop("__broken", "passed")


def judged_failed() -> Column:
    """Whether a verdict that was just applied made the task fail for good."""
    return F.coalesce(~F.col("passed"), F.lit(False)) & (F.col("status") == "failed")


def verify_goals(tasks: DataFrame, goal: str = "goal_id") -> DataFrame:
    """goal, verified: all tasks are completed; goals without a task have no row and aren't verified."""
    return tasks.groupBy(goal).agg(F.bool_and(F.col("status") == "completed").alias("verified"))


def live_plans(goals: DataFrame, plans: DataFrame, cap: int, live: tuple[str, ...] = ("proposed", "approved", "executing")) -> DataFrame:
    """Goals that no live plan serves and that have fewer plans than the cap: one count per goal answers both. plans: goal_id, status."""
    n = plans.groupBy(F.col("goal_id").alias("__g")).agg(F.count("*").alias("__n"), F.count_if(F.col("status").isin(*live)).alias("__live"))
    return goals.join(n, F.col("id") == F.col("__g"), "left").where((F.coalesce("__live", F.lit(0)) == 0) & (F.coalesce("__n", F.lit(0)) < cap)).drop("__g", "__n", "__live")


def score_plan(plan: Column, tools: Column, writing: Column, most: int, no_writes: Column, first_tool: Column, includes: Column) -> Column:
    """What is wrong with a plan (JSON array of steps with a tool), or ok. tools: those that are known; writing: those of them that write."""
    steps = F.try_variant_get(F.try_parse_json(plan), "$", "array<variant>")
    used = F.transform(steps, lambda s: F.try_variant_get(s, "$.tool", "string"))
    unknown = F.exists(used, lambda t: t.isNull() | ~F.array_contains(tools, t))
    return (
        F.when(steps.isNull(), "no_array")
        .when((F.size(steps) == 0) | (F.size(steps) > most), "bad_step_count")
        .when(unknown, "unknown_tool")
        .when(no_writes & F.arrays_overlap(used, writing), "writes")
        .when(F.coalesce(F.get(used, F.lit(0)) != first_tool, F.lit(False)), "first_tool")
        .when(F.coalesce(~F.array_contains(used, includes), F.lit(False)), "missing_tool")
        .otherwise("ok")
    )


# Prompts ------------------------------------------------------------------------------------------------------------


def pass_rate_gate(runs: DataFrame, active: DataFrame, threshold: float) -> DataFrame:
    """name, pass_rate, baseline, verdict: a candidate passes with a rate of at least the threshold that isn't below the active version's. runs: name, passed (boolean); active: name, pass_rate."""
    rates = runs.groupBy("name").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))
    rows = rates.join(active.select("name", F.col("pass_rate").alias("baseline")), "name", "left")
    good = (F.col("pass_rate") >= threshold) & F.coalesce(F.col("pass_rate") >= F.col("baseline"), F.lit(True))
    return rows.withColumn("verdict", F.when(good, "pass").otherwise("held"))


def propose(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Versions with the new candidates (name, content), numbered on from the greatest of their name by content. versions: name, version, content, status."""
    last = versions.groupBy("name").agg(F.max("version").alias("__last"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("content"))
    rows = new.join(last, "name", "left").select("name", (F.coalesce("__last", F.lit(0)) + n).cast(versions.schema["version"].dataType).alias("version"), "content", F.lit("candidate").alias("status"))
    return versions.unionByName(rows)


def activate(versions: DataFrame, asked: DataFrame, gates: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, requests with their error): a candidate whose gate has passed and whose approval is granted becomes active, and the active version of its name retires.

    asked: name, version (one of a name); gates: name, version, verdict; approvals: name, version, state."""
    key = ["name", "version"]
    rows = asked.select(*key).distinct().join(versions.select(*key, "status"), key, "left").join(gates.select(*key, "verdict"), key, "left").join(approvals.select(*key, "state"), key, "left")
    error = F.when(F.col("status").isNull(), "version_missing").when(F.col("status") != "candidate", "not_candidate").when(~F.col("verdict").eqNullSafe(F.lit("pass")), "gate_not_passed").when(~F.col("state").eqNullSafe(F.lit("granted")), "not_approved")
    judged = rows.select(*key, error.alias("error"))
    chosen = keep_first(judged.where("error is null"), ["name"], [F.desc("version")]).select("name", F.col("version").alias("__new"))
    out = versions.join(chosen, "name", "left")
    status = F.when(F.col("version") == F.col("__new"), "active").when(F.col("__new").isNotNull() & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("__new"), judged


# Sketches, approvals ------------------------------------------------------------------------------------------------


def advance(sketches: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches, requests with their error): each status leads to some others only. asked: id, to (one of an id)."""
    allowed = F.create_map(*[x for s, to in L.SKETCH_TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, to)) if to else F.array().cast("array<string>"))])
    a = asked.select("id", F.col("to").alias("__to"))
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("__to")), F.lit(False))
    out = sketches.join(a, "id", "left").withColumn("status", F.when(ok, F.col("__to")).otherwise(F.col("status"))).drop("__to")
    judged = a.join(sketches.select("id", "status"), "id", "left").select("id", F.when(F.col("status").isNull(), "sketch_missing").when(~ok, "transition_not_allowed").alias("error"))
    return out, judged


def decide(approvals: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(approvals, requests with their error): what is pending and not over is granted or denied once; of several requests for one the first by `n` counts. asked: id, verdict, n."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    rows = asked.withColumn("__k", first).join(approvals.select("id", F.col("state").alias("__state"), "expires_at"), "id", "left")
    error = F.when(F.col("__state").isNull(), "approval_missing").when(F.col("__state") != "pending", "already_decided").when(F.col("expires_at") <= now, "expired").when(F.col("__k") > 1, "already_decided")
    judged = rows.select("id", "n", "verdict", error.alias("error"))
    done = judged.where("error is null").select("id", F.col("verdict").alias("__verdict"))
    out = approvals.join(done, "id", "left")
    hit = F.col("__verdict").isNotNull()
    return out.withColumn("state", F.when(hit, F.col("__verdict")).otherwise(F.col("state"))).withColumn("decided_at", F.when(hit, now).otherwise(F.col("decided_at"))).drop("__verdict"), judged


def queue(approvals: DataFrame, now: Column) -> DataFrame:
    """scope, n_pending, next_expiry: what waits for a decision."""
    open_ = approvals.where((F.col("state") == "pending") & (F.col("expires_at") > now))
    return open_.groupBy("scope").agg(F.count("*").alias("n_pending"), F.min("expires_at").alias("next_expiry"))


# Decisions and lessons ----------------------------------------------------------------------------------------------


def record_outcomes(decisions: DataFrame, outcomes: DataFrame, now: Column, ties: list[str] | None = None) -> DataFrame:
    """Decisions with outcome_id, surprise and reviewed_at of their first outcome. decisions: id, confidence; outcomes: id, decision_id, matched, and columns that order those of one id (`ties`).

    Outcomes without an id are none. The first that says whether it matched gives the surprise."""
    says = F.col("id").isNotNull() & F.col("matched").isNotNull()
    first = outcomes.groupBy(F.col("decision_id").alias("__d")).agg(F.min("id").alias("outcome_id"), F.min_by(F.col("matched"), F.when(says, F.struct("id", *(ties or [])))).alias("matched"))
    rows = decisions.join(first, F.col("id") == F.col("__d"), "left")
    return rows.withColumn("surprise", F.round(S.brier(F.col("confidence"), F.col("matched")), 6)).withColumn("reviewed_at", F.when(F.col("outcome_id").isNotNull(), now)).drop("__d", "matched")


def surprising(decisions: DataFrame, least: float = 0.25) -> DataFrame:
    """Decisions whose outcome was at least so surprising, the most surprising first."""
    return decisions.where(F.col("surprise") >= least).orderBy(F.desc("surprise"), "id")


def learn(lessons: DataFrame, new: DataFrame, tau: float = 0.85, step: float = 0.1, validated_at: int = 3, start: float = 0.5) -> DataFrame:
    """Lessons after new statements (id, embedding): a statement near a lesson confirms the nearest, another becomes a lesson of its own. lessons: id, embedding, support_count, confidence, status."""
    near = knn(new.select(F.col("id").alias("query"), "embedding"), lessons, 1).where(F.round("score", 9) >= tau)
    n = near.groupBy("id").agg(F.count("*").alias("__n"))
    old = lessons.join(n, "id", "left").withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn("support_count", F.col("support_count") + F.col("__n")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") + step * F.col("__n")), 6))
    old = old.withColumn("status", F.when(F.col("support_count") >= validated_at, "validated").otherwise(F.col("status"))).drop("__n")
    own = new.join(near.select(F.col("query").alias("id")), "id", "left_anti").select("id", "embedding", F.lit(1).cast(lessons.schema["support_count"].dataType).alias("support_count"), F.lit(start).alias("confidence"), F.lit("provisional").alias("status"))
    return old.unionByName(own.select(*old.columns))


def mirror_lessons(lessons: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """lesson, entity: the edges from lessons to the entities that they apply to, without what isn't an entity and what is an edge already. lessons: id, applies_to (array)."""
    rows = lessons.select(F.col("id").alias("lesson"), F.explode("applies_to").alias("entity")).distinct()
    return rows.join(entities.select(F.col("id").alias("entity")), "entity", "left_semi").join(edges.select("lesson", "entity"), ["lesson", "entity"], "left_anti").select("lesson", "entity")


def context_lines(rows: DataFrame, scope: str, line: Column, order: list, most: int) -> DataFrame:
    """scope, n, context: the first `most` rows of each scope as one text, a line each."""
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(scope).orderBy(*order))).where(F.col("__k") <= most)
    lists = ranked.groupBy(scope).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("__k", line.alias("l")))).alias("__l"))
    return lists.select(scope, "n", F.array_join(F.transform("__l", lambda x: F.concat(F.lit("- "), x["l"])), "\n").alias("context"))


def gate_principles(rows: DataFrame, least: float, gate: float = 0.75) -> DataFrame:
    """Candidates of at least some confidence with their status: canonical from the gate on, else hypothesis."""
    return rows.where(F.col("confidence") >= least).withColumn("status", F.when(F.col("confidence") >= gate, "canonical").otherwise("hypothesis"))


# Goals, runs, dashboards --------------------------------------------------------------------------------------------


def goal_tree(goals: DataFrame) -> DataFrame:
    """id, n_children, n_done, mean_progress: current goals with what their current children come to. goals: id, parent_id, status, progress, valid_to."""
    current = goals.where("valid_to is null")
    children = current.where("parent_id is not null").groupBy(F.col("parent_id").alias("__p")).agg(F.count("*").alias("n_children"), F.count_if(F.col("status") == "completed").alias("n_done"), F.round(F.avg("progress"), 4).alias("mean_progress"))
    return current.join(children, F.col("id") == F.col("__p"), "left").select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_done", F.lit(0)).alias("n_done"), "mean_progress")


def decisions_due(decisions: DataFrame, now: Column) -> DataFrame:
    """Decisions whose review is due and that have no outcome."""
    return decisions.where((F.col("review_at") <= now) & F.col("outcome_id").isNull())


def run_traces(calls: DataFrame, actions: DataFrame, runs: DataFrame, observations: DataFrame) -> DataFrame:
    """run, n_calls, n_observed, trace: the calls of each run in order, with what was seen. calls: action_id, ordinal, tool; actions: id, run_id; runs: id; observations: action_id, result."""
    a = actions.select(F.col("id").alias("action_id"), F.col("run_id").alias("run"))
    rows = calls.join(a, "action_id").join(runs.select(F.col("id").alias("run")), "run", "left_semi").join(observations.select("action_id", "result"), "action_id", "left")
    said = F.concat("tool", F.coalesce(F.concat(F.lit("="), "result"), F.lit("")))
    lists = rows.groupBy("run").agg(F.count("*").alias("n_calls"), F.count("result").alias("n_observed"), F.array_sort(F.collect_list(F.struct("ordinal", said.alias("s")))).alias("l"))
    return lists.select("run", "n_calls", "n_observed", F.array_join(F.transform("l", lambda x: x["s"]), ">").alias("trace"))


def overview(goals: DataFrame, tasks: DataFrame) -> DataFrame:
    """id, n_tasks, n_done, n_failed, last_status: goals with their tasks' counts and the status of the last one (goal_id, id, status)."""
    t = tasks.groupBy(F.col("goal_id").alias("__g")).agg(F.count("*").alias("n_tasks"), F.count_if(F.col("status") == "completed").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.max_by("status", "id").alias("last_status"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return goals.join(t, F.col("id") == F.col("__g"), "left").select("id", zero("n_tasks"), zero("n_done"), zero("n_failed"), "last_status")


def inbox(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items with the name of their job, unread ones first, then the newest."""
    j = jobs.select(F.col("id").alias("__j"), F.col("name").alias("job"))
    return items.join(j, F.col("job_id") == F.col("__j"), "left").drop("__j").orderBy(F.col("read_at").isNull().desc(), F.desc("created_at"), "id")


def call_rollup(calls: DataFrame, key: str, failed: Column, took: str) -> DataFrame:
    """Per key: calls, errors, error_rate, mean_ms."""
    bad = F.count_if(failed)
    return calls.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("calls"), bad.alias("errors"), F.round(bad / F.count("*"), 4).alias("error_rate"), F.round(F.avg(took), 6).alias("mean_ms"))


def hit_rate(lookups: DataFrame, key: str, hit: Column) -> DataFrame:
    """Per key: hits, misses and the share of hits; 0 where nothing was looked up."""
    hits, n = F.count_if(hit), F.count("*")
    return lookups.groupBy(key).agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("hit_rate"))


def agreement(rows: DataFrame, a: str, b: str, top: int = 12) -> tuple[DataFrame, DataFrame]:
    """(n, agreed, share; the `top` most frequent pairs that differ)."""
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agreed")).withColumn("share", F.round(F.coalesce(F.col("agreed") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 4))
    pairs = rows.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count("*").alias("n")).orderBy(F.desc("n"), a, b).limit(top)
    return total, pairs


def import_statistics(triples: DataFrame, source: str, least: float = 0.5) -> DataFrame:
    """Per source: rows, kept (of at least some confidence), dropped, and distinct subjects and predicates among the kept."""
    kept = F.coalesce(F.col("confidence") >= least, F.lit(False))
    when = lambda c: F.countDistinct(F.when(kept, F.col(c)))
    return triples.groupBy(source).agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), when("subject").alias("subjects"), when("predicate").alias("predicates"))


def fork(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """id, params: runs as forked with other parameters (id, params); those of the fork win. params: map."""
    c = changes.select("id", F.col("params").alias("__p"))
    rows = runs.join(c, "id")
    return rows.select("id", F.map_concat(F.map_filter("params", lambda k, _: ~F.map_contains_key(F.col("__p"), k)), "__p").alias("params"))


# Projects and periods ----------------------------------------------------------------------------------------------


def projects_in_workspaces(projects: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Projects (id, workspace_id, name, status) with the name and area of their workspace; those without one are left out."""
    w = workspaces.select(F.col("id").alias("__w"), F.col("name").alias("workspace"), "area")
    return projects.join(w, F.col("workspace_id") == F.col("__w")).drop("__w")


def due_in_period(keys: DataFrame, done: DataFrame, now: Column, period: str, key: str = "key", at: str = "at") -> DataFrame:
    """Keys that have nothing done since the period (`day`, `week`, `month`) of `now` began."""
    since = done.where(F.col(at) >= F.date_trunc(period, now).cast("timestamp_ntz")).select(key).distinct()
    return keys.join(since, key, "left_anti")
