"""Task tables and append-only event logs: replay, audits, roll-ups, boards and health flags.

Events of one task may be arbitrarily many, so state is folded with partial aggregation (max_by) and
neighbour look-ups go through `ordered.lag_in_key`, which cuts a task's log into time chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.dates import business_date
from tidemark.operators import graph
from tidemark.operators.ordered import lag_in_key, running_sum, top_per_key
from tidemark.session import cut_lineage

TASK_KEY = ("plan_id", "task_id")


def applied(events: DataFrame) -> DataFrame:
    """Events that moved a task: no REJECTED rows, no same-state rows."""
    return events.filter((F.col("to_s") != "REJECTED") & ~F.col("from_s").eqNullSafe(F.col("to_s")))


def current_state(events: DataFrame) -> DataFrame:
    return applied(events).groupBy(*TASK_KEY).agg(F.max_by("to_s", "seq").alias("replayed"))


def replay_state(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Tasks whose replayed state differs from the snapshot, or that one side lacks."""
    snap = snapshot.select(*TASK_KEY, F.col("status").alias("stored"))
    j = current_state(events).join(snap, list(TASK_KEY), "full_outer")
    return j.filter(~F.col("replayed").eqNullSafe(F.col("stored")))


def _pairs(table: dict) -> Column:
    return F.array(*[F.lit(f"{a}>{b}") for a, bs in table.items() for b in bs])


def role_problem(role: Column, edge: Column, to_s: Column) -> Column:
    out = F.when(~role.isin("orchestrator", "subagent", "verifier"), F.concat(F.lit("unknown_role:"), role))
    out = out.when((role != "orchestrator") & (to_s == "VERIFYING"), "system_only:VERIFYING")
    for name, edges in fixed.ROLE_TRANSITIONS.items():
        ok = edge.isin(*[f"{a}>{b}" for a, b in edges])
        out = out.when((role == name) & ~ok, F.concat(F.lit(f"{name}_cannot:"), F.replace(edge, F.lit(">"), F.lit("->"))))
    return out


def _payload_problem(payload: Column, from_s: Column, to_s: Column) -> Column:
    def has(key):
        return F.coalesce(F.get_json_object(payload, f"$.{key}"), F.lit("")) != ""

    missing = F.array_compact(F.array(*[F.when(~has(k), F.lit(k)) for k in ("reason", "last_error", "sop_ref")]))
    yielded = (from_s == "RUNNING") & (to_s == "READY")
    reason = F.coalesce(F.get_json_object(payload, "$.reason"), F.lit("None"))
    return (F.when(yielded & ~reason.isin(*fixed.YIELD_REASONS), F.concat(F.lit("bad_yield_reason:"), reason))
            .when((to_s == "RETRY") & ~has("reason"), "retry_requires_reason")
            .when((to_s == "DEAD_LETTER") & (F.size(missing) > 0),
                  F.concat(F.lit("dead_letter_missing:['"), F.array_join(missing, "', '"), F.lit("']"))))


def transition_audit(events: DataFrame, chunk: Column) -> DataFrame:
    """Problems of every applied event: illegal pair, role, payload, and a broken chain of states.

    `chunk` is a monotone slice of the event order that bounds each window, such as ranges of a million seq numbers.
    """
    prev = lag_in_key(applied(events), TASK_KEY, ["seq"], chunk, {"_prev_to": "to_s", "_prev_attempts": "attempts"})
    edge = F.concat_ws(">", F.coalesce("from_s", F.lit("")), "to_s")
    problems = F.array_compact(F.array(
        F.when(F.col("from_s").isNotNull() & ~F.array_contains(_pairs(fixed.ALLOWED_TRANSITIONS), edge),
               F.concat(F.lit("illegal:"), F.replace(edge, F.lit(">"), F.lit("->")))),
        role_problem(F.col("role"), edge, F.col("to_s")),
        _payload_problem(F.col("payload"), F.col("from_s"), F.col("to_s")),
        F.when(F.col("_prev_to").isNotNull() & ~F.col("from_s").eqNullSafe(F.col("_prev_to")),
               F.concat(F.lit("broken_chain:"), "_prev_to")),
        F.when(F.col("attempts") != F.coalesce("_prev_attempts", F.lit(0))
               + ((F.col("from_s") == "RETRY") & (F.col("to_s") == "READY")).cast("int"), "bad_attempts")))
    return (prev.select(*TASK_KEY, "seq", "from_s", "to_s", F.explode(problems).alias("problem")))


def yield_overuse(events: DataFrame, limit: int = fixed.SWITCH_LIMIT) -> DataFrame:
    n = F.count_if((F.col("from_s") == "RUNNING") & (F.col("to_s") == "READY"))
    return applied(events).groupBy(*TASK_KEY).agg(n.alias("n_yields")).filter(F.col("n_yields") > limit)


def dwell_times(events: DataFrame, chunk: Column) -> DataFrame:
    """Seconds each applied state lasted, told by the following event of the task."""
    prev = lag_in_key(applied(events), TASK_KEY, ["seq"], chunk, {"state": "to_s", "_since": "ts_us"})
    return prev.filter("state is not null").select(
        *TASK_KEY, "seq", "state", ((F.col("ts_us") - F.col("_since")) / 1_000_000).alias("seconds"))


def dwell_summary(dwell: DataFrame, sla_s: float = 60.0, accuracy: int = 100_000) -> DataFrame:
    """Per state: n, average, 95th percentile (approximate, mergeable sketch) and the SLA verdict."""
    p95 = F.percentile_approx("seconds", 0.95, accuracy)
    return dwell.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("avg_s"), p95.alias("p95_s"),
                                      (p95 <= sla_s).alias("within_sla"))


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """Newest n events per plan (the rank filter is applied before the shuffle as well)."""
    return top_per_key(events, ["plan_id"], [F.col("seq").desc()], n, "recency")


def last_error(events: DataFrame, within: int = 50) -> DataFrame:
    """Newest non-empty error text per task among the plan's newest events."""
    def field(k):
        c = F.get_json_object("payload", f"$.{k}")
        return F.when(c != "", c)

    text = F.substring(F.coalesce(*[field(k) for k in ("error", "last_error", "detail", "reason")]), 1, 2000)
    return (recent_events(events, within).withColumn("error", text).filter("error is not null")
            .groupBy(*TASK_KEY).agg(F.max_by("error", "seq").alias("last_error")))


def latest_message(messages: DataFrame, limit_tokens: int, within: int = 40) -> DataFrame:
    """Per session the newest assistant message with tokens among its last messages, and its share of the limit."""
    near = top_per_key(messages, ["session_id"], [F.col("pos").desc()], within, "_r")
    hit = near.filter((F.col("role") == "assistant") & (F.col("tokens") > 0))
    return hit.groupBy("session_id").agg(F.max("pos").alias("pos"), F.max_by("tokens", "pos").alias("tokens")).withColumn(
        "pct_of_limit", F.round(F.col("tokens") / limit_tokens * 100, 1))


def metric_rollup(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    v = F.coalesce("value", F.lit(0.0))
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg("value").alias("avg"),
                                    F.max("value").alias("max"))


def status_counts(tasks: DataFrame, by: Sequence[str] = ("plan_id",)) -> DataFrame:
    return tasks.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def plan_summary(tasks: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return tasks.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses],
        F.sum("attempts").alias("attempts"), F.sum("session_switch_total").alias("switches"))


def queue_board(tasks: DataFrame, metrics: DataFrame, now_us: int, block_s: float = 60.0, backlog: int = 50,
                backlog_s: float = 3600.0) -> DataFrame:
    """One row: queue sizes, oldest wait, blocked flag, dispatch delay, open switches, cache hits, backlog alert."""
    ready = F.col("status") == "READY"
    wait = F.greatest(F.lit(0.0), (F.lit(now_us) - F.col("updated_us")) / 1_000_000)
    t = tasks.agg(
        F.count_if(ready).alias("ready_total"), F.count_if(F.col("status") == "RUNNING").alias("running"),
        F.coalesce(F.max(F.when(ready, wait)), F.lit(0.0)).alias("oldest"),
        F.sum(F.when(~F.col("status").isin("DONE", "DEAD_LETTER", "CANCELLED"), F.col("session_switch_total"))
              .otherwise(0)).alias("session_switch_total"))
    m = metrics.agg(F.struct(F.avg(F.when(F.col("name") == "dispatch_wait", F.col("value"))).alias("dw"),
                             F.count_if(F.col("name") == "cache_hit").alias("cache_hit"))).scalar()
    return t.withColumn("_m", m).select(
        "ready_total", "running", F.floor("oldest").alias("oldest_wait_s"), (F.col("oldest") > block_s).alias("queue_blocked"),
        F.round(F.coalesce("_m.dw", F.lit(0.0)), 2).alias("dispatch_wait_avg_s"), "session_switch_total", "_m.cache_hit",
        ((F.col("ready_total") > backlog) | (F.col("oldest") > backlog_s)).alias("backlog_alert"))


def ready_by_priority(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status = 'READY'").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def daily_plans(tasks: DataFrame, date: str) -> DataFrame:
    """Plans of a day: the id holds the date, or some task was enqueued on that business day."""
    on_day = F.coalesce(business_date(F.col("enqueued_at")) == F.lit(date).cast("date"), F.lit(False))
    mine = F.contains("plan_id", F.lit(date)) | on_day
    return tasks.filter(mine).select("plan_id").distinct()


def daily_report(tasks: DataFrame, date: str) -> DataFrame:
    """Totals over the plans of a day; zero rows in `total` mean the day had no plan (never another day's data)."""
    t = tasks.join(daily_plans(tasks, date), "plan_id", "left_semi")
    c = {s.lower(): F.count_if(F.col("status") == s).alias(s.lower())
         for s in ("DONE", "FAILED", "DEAD_LETTER", "SKIPPED_CACHED")}
    return t.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("plan_id").alias("n_plans"), *c.values(),
                 F.coalesce(F.sum("attempts"), F.lit(0)).alias("retries"),
                 F.coalesce(F.sum("session_switch_total"), F.lit(0)).alias("switches"))


def unfinished_plans(tasks: DataFrame) -> DataFrame:
    """Shown instead of a report on a day without plans."""
    left = F.count_if(~F.col("status").isin("DONE", "FAILED", "DEAD_LETTER", "SKIPPED_CACHED"))
    return tasks.groupBy("plan_id").agg(left.alias("n_unfinished"), F.count(F.lit(1)).alias("total")).filter("n_unfinished > 0")


def quality_flags(tasks: DataFrame) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("status") == "DEAD_LETTER", "P0:dead_letter"),
                                    F.when(F.col("session_switch_total") > 3, "switches")))
    return tasks.select("plan_id", "task_id", F.explode(flags).alias("flag"))


def tuning_hints(report: DataFrame, board: DataFrame, switch_warn: int, sla_s: float) -> DataFrame:
    """Hint names for one report row and one board row."""
    j = report.select(F.col("switches").alias("_sw"), board.select(F.struct("ready_total", "oldest_wait_s")).scalar().alias("_b")).select(
        "_sw", "_b.*")
    hints = F.array_compact(F.array(
        F.when((F.col("_sw") > 0) & (F.col("_sw") >= switch_warn), "session_switches"),
        F.when(F.col("ready_total") > 50, "ready_backlog"), F.when(F.col("oldest_wait_s") > sla_s, "oldest_wait")))
    return j.select(F.explode(F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit("none")))).alias("hint"))


def span_top(records: DataFrame, n: int) -> DataFrame:
    return (records.groupBy("task_id").agg(F.sum("duration_ms").alias("total_ms"))
            .orderBy(F.col("total_ms").desc(), "task_id").limit(n))


def ready_ordered(tasks: DataFrame, k: int, pmin: int = 0, pmax: int = 10) -> DataFrame:
    return (tasks.filter((F.col("status") == "READY") & F.col("priority").between(pmin, pmax))
            .orderBy("priority", "seq").limit(k))


def slow_tasks(tasks: DataFrame, k: int = 5, at_least_s: float = 120.0) -> DataFrame:
    elapsed = F.greatest(F.lit(0.0), (F.col("updated_us") - F.col("enqueued_us")) / 1_000_000)
    return (tasks.withColumn("elapsed_s", elapsed).filter(F.col("elapsed_s") >= at_least_s)
            .orderBy(F.col("elapsed_s").desc(), "task_id").limit(k))


def exit_code(tasks: DataFrame) -> DataFrame:
    dead = F.count_if(F.col("status") == "DEAD_LETTER") > 0
    open_ = F.count_if(~F.col("status").isin(*fixed.TERMINAL)) > 0
    return tasks.groupBy("plan_id").agg(F.when(dead, 2).when(open_, 1).otherwise(0).alias("exit_code"))


def task_health(tasks: DataFrame, now_us: int) -> DataFrame:
    """Health flags of a snapshot at one instant, all plain expressions on the row."""
    def age(col):
        return (F.lit(now_us) - F.col(col)) / 1_000_000

    expired = F.coalesce(F.col("lease_us") <= now_us, F.lit(True))
    backoff = F.least(F.lit(3600.0), F.lit(60.0) * F.pow(F.lit(2.0), F.col("attempts")))
    waited = age("enqueued_us")
    target = F.when((waited >= 1200) & (F.col("priority") <= 5) & (F.col("priority") > 3), 3).when(
        (waited >= 600) & (F.col("priority") > 5), 5)
    return tasks.select(
        "plan_id", "task_id",
        ((F.col("status") == "RUNNING") & expired).alias("lease_expired"),
        ((F.col("status") == "VERIFYING") & (F.col("owner").isNull() | expired)).alias("verify_requeue"),
        ((F.col("status") == "RETRY") & (age("updated_us") >= backoff)).alias("retry_due"),
        (F.col("status").isin("FAILED", "RETRY") & (F.col("attempts") >= F.col("max_attempts"))).alias("exhausted"),
        F.when(F.col("status") == "READY", target).alias("aging_target"),
        ((F.col("status") == "READY") & (age("updated_us") > 60)).alias("sla_breach"))


def limit_errors(errors: DataFrame) -> DataFrame:
    """Adds `is_limit`: quota or rate-limit shaped errors by status and phrase."""
    text = F.lower(F.coalesce("message", F.lit("")))
    hit = F.lit(False)
    for phrase in fixed.LIMIT_TEXTS:
        hit = hit | F.contains(text, F.lit(phrase))
    return errors.withColumn("is_limit", F.coalesce(
        F.col("status").isin(*fixed.LIMIT_STATUS) | (F.col("status").isin(*fixed.LIMIT_STATUS_WITH_TEXT) & hit), F.lit(False)))


def context_pressure(usage: DataFrame, watermark: float) -> DataFrame:
    ratio = F.when(F.col("window") > 0, F.col("prompt_tokens") / F.col("window"))
    return usage.withColumn("pressure", F.coalesce(ratio >= watermark, F.lit(False)))


def provider_health(log: DataFrame) -> DataFrame:
    """Per provider: calls, failures, upper-median latency, last permanent status.

    The exact upper median comes from counts per latency, so a provider with a third of all calls is
    folded to one row per distinct millisecond before it meets a window.
    """
    base = log.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"),
        F.max_by(F.when(F.col("permanent"), F.col("status")), F.when(F.col("permanent"), F.col("seq"))).alias("last_permanent"))
    hist = log.filter("ok").groupBy("provider", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(W.partitionBy("provider").orderBy("latency_ms"))
    n = F.sum("c").over(W.partitionBy("provider"))
    mid = (hist.withColumn("_run", run).withColumn("_n", n).filter(F.col("_run") > F.floor(F.col("_n") / 2))
           .groupBy("provider").agg(F.min("latency_ms").alias("p50_ms")))
    return base.join(mid, "provider", "left")


def outage_intervals(calls: DataFrame, least: int, chunk: Column, keys: Sequence[str] = ("provider",)) -> DataFrame:
    """Failures in a row: at least `least` of them, or one that was permanent. calls: keys, ts_us, pos, ok, permanent.

    Each success starts a new run; the runs are numbered slice by slice (`chunk`, monotone in time), so that a provider with most of the calls spreads over tasks.
    """
    runs = running_sum(calls, keys, ["ts_us", "pos"], chunk, F.col("ok").cast("long"), "_run").filter("NOT ok")
    found = runs.groupBy(*keys, "_run").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n_failed"), F.max("permanent").alias("permanent"))
    return found.filter((F.col("n_failed") >= least) | F.col("permanent")).drop("_run")


def rule_handoff(results: DataFrame) -> DataFrame:
    """Per task: file and row rules as `rule:ok` / `rule:FAIL detail`, in rule order, at most 2000 characters.

    Rules without an id leave no word. A word and its separator take at least five characters, so the first 401 words fill the text and no task gathers more.
    """
    judged = results.filter(F.col("type").isin("file_exists", "row_count"))
    passed = judged.groupBy(*TASK_KEY).agg(F.every("ok").alias("passed"))
    word = F.concat("rule_id", F.when(F.col("ok"), ":ok").otherwise(F.concat(F.lit(":FAIL "), F.coalesce("detail", F.lit("")))))
    said = top_per_key(judged.withColumn("_w", word).filter("_w IS NOT NULL"), TASK_KEY, ["pos"], 401, "_r")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("_w").alias("w"))))
    text = said.groupBy(*TASK_KEY).agg(
        F.substring(F.array_join(F.transform(ordered, lambda x: x["w"]), "; "), 1, 2000).alias("handoff"))
    return passed.join(text, list(TASK_KEY), "left").select(*TASK_KEY, F.coalesce("handoff", F.lit("")).alias("handoff"), "passed")


def decomposition_view(tasks: DataFrame) -> DataFrame:
    """Slices of a plan with their rationale; `missing` marks the ones without."""
    return tasks.select("plan_id", "task_id", "objective", "slice_rationale",
                        (F.coalesce("slice_rationale", F.lit("")) == "").alias("missing"))


def final_consistency(tasks: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """All problems of finished plans as rows (plan_id, task_id, problem).

    tasks need depends_on, n_rules, needs_web, outputs and day; files holds the existing paths.
    """
    dag = graph.dag_problems(tasks).select("plan_id", "task_id", F.concat(F.lit("dag:"), "problem").alias("problem"))
    finished = tasks.filter(F.col("status").isin(*fixed.SATISFIED)).select(*TASK_KEY)
    unmet = (graph.unsatisfied_deps(tasks).join(finished, list(TASK_KEY), "left_semi").select(*TASK_KEY).distinct()
             .withColumn("problem", F.lit("terminal_with_unmet_deps")))
    norules = tasks.filter("n_rules = 0").select(*TASK_KEY, F.lit("no_acceptance_rules").alias("problem"))
    audited = recent_events(events, 50).filter(F.col("to_s").isin("DONE", "DEAD_LETTER")).select(*TASK_KEY).distinct()
    unaudited = (tasks.filter(F.col("status").isin("DONE", "DEAD_LETTER")).join(audited, list(TASK_KEY), "left_anti")
                 .select(*TASK_KEY, F.lit("terminal_without_audit_row").alias("problem")))
    suffix = F.explode(F.array(F.lit("sources.json"), F.lit("claims.json"), F.lit("tuning.md")))
    need = tasks.filter("needs_web").select(*TASK_KEY, "day", suffix.alias("suffix")).select(
        *TASK_KEY, F.concat(F.lit("artifacts/"), "day", F.lit("/"), F.col("task_id").cast("string"), F.lit("."), "suffix").alias("path"),
        F.concat(F.lit("missing_four_set:"), "suffix").alias("problem"))
    outs = tasks.select(*TASK_KEY, F.explode("outputs").alias("path")).withColumn(
        "problem", F.concat(F.lit("missing_artifact:"), "path"))
    gone = need.unionByName(outs.select(*need.columns)).join(files.select("path").distinct(), "path", "left_anti").drop("path")
    out = dag
    for part in (unmet, norules, unaudited, gone):
        out = out.unionByName(part.select("plan_id", "task_id", "problem"))
    return out


def cache_hits(tasks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether a task may be skipped: unchanged inputs and intact outputs; first failing reason otherwise.

    manifests: path, bytes, sha256 (current), recorded_sha (null without a manifest, '' with an empty one).
    """
    outs = tasks.select(*TASK_KEY, F.posexplode("outputs").alias("i", "path")).join(manifests, "path", "left")
    why = (F.when(F.col("bytes").isNull(), F.concat(F.lit("missing_artifact:"), "path"))
           .when(F.col("bytes") == 0, F.concat(F.lit("empty_artifact:"), "path"))
           .when(F.col("recorded_sha").isNull(), F.concat(F.lit("no_manifest:"), "path"))
           .when(F.col("recorded_sha") == "", F.concat(F.lit("manifest_no_sha:"), "path"))
           .when(F.col("recorded_sha") != F.col("sha256"), F.concat(F.lit("artifact_sha_mismatch:"), "path")))
    first_bad = (outs.withColumn("why", why).filter("why is not null").groupBy(*TASK_KEY)
                 .agg(F.min_by("why", "i").alias("file_reason")))
    ih, last = F.coalesce("inputs_hash", F.lit("")), F.coalesce("last_success_hash", F.lit(""))
    reason = (F.when(ih == "", "no_inputs_hash").when(last == "", "no_last_success").when(ih != last, "inputs_changed")
              .when(F.size("outputs") <= 0, "no_outputs")
              .otherwise(F.coalesce("file_reason", F.lit("inputs_and_artifacts_match"))))
    return tasks.join(first_bad, list(TASK_KEY), "left").select(
        *TASK_KEY, (reason == "inputs_and_artifacts_match").alias("hit"), reason.alias("reason"))


def price_gap_days(jobs: DataFrame, plans: DataFrame, today: str, n_days: int, grace_days: int) -> DataFrame:
    """Plans missing in the last n days per job; old gaps beyond the grace are skipped as overdue."""
    t = F.lit(today).cast("date")
    days = jobs.select("job_id", F.explode(F.sequence(F.date_sub(t, n_days - 1), t)).alias("day"))
    missing = days.withColumn("plan_id", F.concat_ws("_", "job_id", F.date_format("day", "yyyy-MM-dd"))).join(
        plans.select("plan_id"), "plan_id", "left_anti")
    late = (F.col("day") != t) & (F.datediff(t, F.col("day")) > grace_days)
    return missing.withColumn("action", F.when(late, "skipped_overdue").otherwise("run"))


def idempotent_insert(tasks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome per incoming task, decided in the order of `pos` within the batch as against the table.

    already_exists: a task on file or inserted before has its key. conflict: one has its plan and task, under another key. Else it is inserted. A row that was
    refused gives neither its key nor its task away. In each round the rows that come first both for their key and for their task go in and decide their
    followers; keys made from plan and task need two rounds.
    """
    key, task = ["idempotency_key"], list(TASK_KEY)
    rest = incoming.select("pos", *task, *key)
    known = tasks.select(*task, *key)
    decided = None
    while True:
        j = (rest.join(known.select(*key, F.lit(True).alias("_key")).distinct(), key, "left")
             .join(known.select(*task, F.lit(True).alias("_task")).distinct(), task, "left"))
        j = cut_lineage(j.withColumn("outcome", F.when(F.col("_key"), "already_exists").when(F.col("_task"), "conflict")).drop("_key", "_task"))
        free = j.filter("outcome IS NULL").drop("outcome")
        done = j.filter("outcome IS NOT NULL")
        decided = done if decided is None else decided.unionByName(done)
        if free.isEmpty():
            return decided.select("pos", *task, *key, "outcome")
        first = lambda keys, out: free.groupBy(*keys).agg(F.min("pos").alias(out))
        ranked = cut_lineage(free.join(first(key, "_fk"), key).join(first(task, "_ft"), task)
                             .withColumn("_in", (F.col("pos") == F.col("_fk")) & (F.col("pos") == F.col("_ft"))).drop("_fk", "_ft"))
        known = ranked.filter("_in").select(*task, *key)
        decided = decided.unionByName(ranked.filter("_in").select("pos", *task, *key, F.lit("inserted").alias("outcome")))
        rest = ranked.filter("NOT _in").drop("_in")


def alert_level(kind: Column) -> Column:
    """The only place that decides an alert's level; the requested level is ignored."""
    return F.when(kind.isin(*fixed.P0_KINDS), "P0").when(kind.isin(*fixed.P1_KINDS), "P1").otherwise("P2")


def pick_report_links(outputs: DataFrame, existing: DataFrame, k: int = 2) -> DataFrame:
    """Two readable outputs per plan that exist, in the fixed order of file names, then by path."""
    path = F.translate("path", "\\", "/")
    name = F.element_at(F.split(path, "/"), -1)
    order = F.array_position(F.array(*[F.lit(n) for n in fixed.REPORT_PRIORITY]), name)
    readable = F.lit(False)
    for s in fixed.REPORT_SUFFIXES:
        readable = readable | F.endswith(path, F.lit(s))
    o = (outputs.select("plan_id", path.alias("path")).distinct()
         .join(existing.select("path").distinct(), "path", "left_semi").filter(readable)
         .withColumn("_o", F.when(order > 0, order).otherwise(len(fixed.REPORT_PRIORITY) + 1)))
    return top_per_key(o, ["plan_id"], ["_o", "path"], k).select("plan_id", "path", "rank")


def log_tail(lines: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """Last n lines, n held to 10..500."""
    return lines.orderBy(F.col(order).desc()).limit(max(10, min(500, n)))
