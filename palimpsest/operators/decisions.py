"""The decision loop, plans, policy and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import scalars as S


def decay_lessons(lessons: DataFrame, now: Column, half_life_days: float = 30.0, floor: float = 0.1, retire_below: float = 0.05) -> DataFrame:
    """Confidence halves with idle time since the greatest of created_at, last_reinforced_at and last_decayed_at; lessons that fall below `retire_below` are retired and keep theirs."""
    anchor = F.greatest("created_at", "last_reinforced_at", "last_decayed_at")
    raw = S.half_life(F.col("confidence"), S.days_between(now, anchor), half_life_days)
    due = anchor < now
    retired = due & (raw < retire_below)
    return lessons.withColumn("raw", raw).withColumn("status", F.when(retired, "retired").otherwise(F.col("status"))).withColumn("confidence", F.when(due & ~retired, F.greatest(F.lit(floor), raw)).otherwise(F.col("confidence"))).drop("raw")


def reinforce(lessons: DataFrame, confirmations: DataFrame, step: float = 0.1, validated_at: int = 3) -> DataFrame:
    """Lessons with n more confirmations each (id): support and confidence rise, status is validated from `validated_at` on."""
    n = confirmations.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"))
    rows = lessons.join(n, F.col("id") == F.col("__id"), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    rows = rows.withColumn("support_count", F.col("support_count") + F.col("__n")).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + step * F.col("__n")))
    return rows.withColumn("status", F.when(F.col("support_count") >= validated_at, "validated").otherwise(F.col("status"))).drop("__id", "__n")


def policy(requests: DataFrame) -> DataFrame:
    """Adds floor, effective_level, clamped_by, verdict and reason. One chain of conditions in the order of precedence; no row sees another."""
    c = F.col
    rank = lambda x: (F.array_position(F.array(*map(F.lit, L.AUTONOMY)), x) - 1).cast("int")
    floors = F.create_map(*[F.lit(x) for pair in L.CLASS_FLOORS.items() for x in pair])
    floor = (
        F.when(c("action_class") == "spend", F.when(F.coalesce("amount_usd", F.lit(0.0)) > L.SPEND_THRESHOLD, "confirm_each").otherwise("full_auto"))
        .when(c("action_class") == "external_post", F.when(c("channel").eqNullSafe(F.lit("private")), "full_auto").otherwise("confirm_each"))
        .otherwise(F.try_element_at(floors, c("action_class")))
    )
    rows = requests.withColumn("floor", floor)
    least = F.least(rank(c("agent_default")), rank(c("workspace_override")), F.coalesce(rank(c("floor")), F.lit(0)))
    level = F.element_at(F.array(*map(F.lit, L.AUTONOMY)), least + 1)
    clamp = F.when(rank(c("floor")) == least, "action_class_floor").when(rank(c("workspace_override")) == least, "workspace_override")
    hard = (c("tokens") >= c("tokens_limit")) | (c("tool_actions") >= c("tool_actions_limit")) | (c("usd") >= c("usd_limit")) | (c("seconds") >= c("seconds_limit"))
    known = F.array_contains(F.map_keys(floors), c("action_class"))
    granted = F.array_contains(c("tools"), c("action_class"))
    approved = c("approval_state").eqNullSafe(F.lit("granted"))
    own = c("action_class") == "self_modify"
    cases = [
        (c("action_class") == "read", "ALLOW", "read_no_side_effect"),
        (~known, "DENY", "unknown_action_class_fail_closed"),
        (c("kill_unreadable"), "DENY", "kill_switch_unreadable"),
        (c("kill_global") | c("kill_agent"), "DENY", "kill_switch_active"),
        (~F.coalesce(granted, F.lit(False)), "DENY", "capability_grant_missing"),
        ((c("action_class") == "net_egress") & ~F.coalesce(F.array_contains("egress_allow", c("host")), F.lit(False)), "DENY", "net_egress_host_not_in_allowlist"),
        (hard, "DENY", "budget_hard_limit_exceeded"),
        (own & ~c("eval_verdict").eqNullSafe(F.lit("pass")), "DENY", "self_modify_eval_gate_unsatisfied"),
        (own & (c("__level") == "suggest_only"), "DENY", "self_modify_autonomy_forbids"),
        (own & approved, "ALLOW", "self_modify_dual_gate_satisfied"),
        (own, "REQUIRE_APPROVAL", "self_modify_requires_approval"),
        (c("force_dry_run"), "DRY_RUN", "dry_run_requested"),
        ((c("__level") == "confirm_each") & approved, "ALLOW", "approval_granted"),
        (c("__level") == "suggest_only", "DENY", "suggest_only_no_side_effect"),
        (c("__level") == "confirm_each", "REQUIRE_APPROVAL", "gated_at_confirm_each"),
    ]
    verdict, reason = F, F
    for condition, v, r in cases:
        verdict, reason = verdict.when(condition, v), reason.when(condition, r)
    rows = rows.withColumn("__level", level).withColumn("__clamp", clamp).withColumn("verdict", verdict.otherwise("ALLOW")).withColumn("reason", reason.otherwise("auto_allow"))
    # What is denied before the levels are looked at stands at the lowest one.
    early = c("reason").isin("unknown_action_class_fail_closed", "kill_switch_unreadable", "kill_switch_active", "capability_grant_missing")
    return rows.withColumn("effective_level", F.when(early, "suggest_only").otherwise(c("__level"))).withColumn("clamped_by", F.when(early, "action_class_floor").otherwise(c("__clamp"))).drop("__level", "__clamp")


def approvals_at(approvals: DataFrame, now: Column) -> DataFrame:
    """Pending approvals whose time is over are expired; all else stays."""
    over = (F.col("state") == "pending") & (F.col("expires_at") <= now)
    return approvals.withColumn("decided_at", F.when(over, now).otherwise(F.col("decided_at"))).withColumn("state", F.when(over, "expired").otherwise(F.col("state")))


def plan_progress(tasks: DataFrame, key: str = "plan_id") -> DataFrame:
    """plan, n_tasks, completed, failed, progress, terminal."""
    done = F.count_if(F.col("status") == "completed")
    ended = F.count_if(F.col("status").isin("completed", "failed", "skipped"))
    return tasks.groupBy(key).agg(F.count("*").alias("n_tasks"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(done / F.count("*"), 4).alias("progress"), (ended == F.count("*")).alias("terminal"))


def task_verdicts(calls: DataFrame, key: str = "task_id") -> DataFrame:
    """A task failed if any call had an error or a non-zero exit, passed otherwise."""
    bad = F.coalesce(F.col("error").isNotNull() & (F.col("error") != ""), F.lit(False)) | (F.coalesce("exit_code", F.lit(0)) != 0)
    return calls.groupBy(key).agg(F.count("*").alias("n_calls"), F.count_if(bad).alias("n_bad"), F.when(F.bool_or(bad), "fail").otherwise("pass").alias("verdict"))


def gate(scores: DataFrame, key: str = "dataset", passing: float = 0.5) -> DataFrame:
    """Pass rate (mean score), regressions (scores below `passing`) and decision of each dataset."""
    rows = scores.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("pass_rate"), F.count_if(F.col("score") < passing).alias("regressions"))
    decision = F.when((F.col("pass_rate") >= 0.8) & (F.col("regressions") == 0), "promote").when(F.col("pass_rate") >= 0.5, "hold").otherwise("rollback")
    return rows.withColumn("decision", decision)


def scenarios(runs: DataFrame) -> DataFrame:
    """Each run with the five template scenarios."""
    items = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("probability"), F.lit(o).alias("outcome")) for n, p, o in L.SCENARIOS])
    return runs.withColumn("s", F.explode(items)).select("*", "s.scenario", "s.probability", "s.outcome").drop("s")
