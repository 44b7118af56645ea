"""Task logs and boards: events by user as a task log, orders as a task table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, table
from tidemark.functions.dates import epoch_micros
from tidemark.operators import tasklog as L

R = Registry()
QUERIES, SQL = R.queries, R.sql

# event types in the role of task states; error stands for a rejected move
TO = {"view": "READY", "click": "RUNNING", "signup": "SUBMITTED", "purchase": "DONE", "error": "REJECTED"}
TO_SQL = ("CASE event_type WHEN 'view' THEN 'READY' WHEN 'click' THEN 'RUNNING' WHEN 'signup' THEN 'SUBMITTED' "
          "WHEN 'purchase' THEN 'DONE' ELSE 'REJECTED' END")
PAYLOAD_SQL = ("CASE WHEN event_id % 4 = 0 THEN '{\"reason\":\"timeout\"}' WHEN event_id % 4 = 1 THEN '{\"detail\":\"d' || event_id || '\",\"reason\":\"r\"}' "
               "ELSE '{}' END")
FROM_SQL = "CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'READY' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SUBMITTED' ELSE 'DONE' END"
ROLE_SQL = "CASE event_id % 7 WHEN 0 THEN 'subagent' WHEN 1 THEN 'verifier' WHEN 2 THEN 'guest' ELSE 'orchestrator' END"


def event_log(spark, d):
    e = table(spark, d, "events")
    to = F.create_map(*[F.lit(x) for kv in TO.items() for x in kv])[F.col("event_type")]
    return e.select((F.col("user_id") % 10).alias("plan_id"), F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
                    epoch_micros(F.col("ts")).alias("ts_us"), F.to_date("ts").alias("day"), F.expr(FROM_SQL).alias("from_s"),
                    to.alias("to_s"), F.expr(ROLE_SQL).alias("role"), F.expr(PAYLOAD_SQL).alias("payload"),
                    (F.col("event_id") % 2).cast("int").alias("attempts"))


LOG = f"""log AS (SELECT user_id % 10 AS plan_id, user_id AS task_id, event_id AS seq, epoch_us(ts) AS ts_us, CAST(ts AS DATE) AS day,
  {FROM_SQL} AS from_s, {TO_SQL} AS to_s, {ROLE_SQL} AS role, {PAYLOAD_SQL} AS payload, CAST(event_id % 2 AS INT) AS attempts FROM events),
  app AS (SELECT * FROM log WHERE to_s <> 'REJECTED' AND from_s <> to_s)"""


@R.add("replay_state", f"""WITH {LOG}, cur AS (SELECT task_id, arg_max(to_s, seq) AS replayed FROM app GROUP BY 1),
  snap AS (SELECT c_custkey AS task_id, CASE c_custkey % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'READY' ELSE 'RUNNING' END AS stored
    FROM customer WHERE c_custkey % 20 <> 0)
  SELECT task_id, replayed, stored FROM cur FULL JOIN snap USING (task_id) WHERE replayed IS DISTINCT FROM stored""")
def replay_state(spark, d):
    k = F.col("c_custkey")
    snap = table(spark, d, "customer").filter(k % 20 != 0).select(
        (k % 10).alias("plan_id"), k.alias("task_id"),
        F.when(k % 3 == 0, "DONE").when(k % 3 == 1, "READY").otherwise("RUNNING").alias("status"))
    return L.replay_state(event_log(spark, d), snap).select("task_id", "replayed", "stored")


@R.add("transition_audit", f"""WITH {LOG}, p AS (SELECT *, lag(to_s) OVER w pt, lag(attempts) OVER w pa FROM app WINDOW w AS (PARTITION BY plan_id, task_id ORDER BY seq)),
  a AS (SELECT task_id, seq, from_s || '->' || to_s AS edge, from_s, to_s, role, payload, pt, pa, attempts FROM p)
  SELECT task_id, seq, 'illegal:' || edge AS problem FROM a WHERE edge NOT IN ('PENDING->READY', 'READY->RUNNING', 'RUNNING->SUBMITTED', 'RUNNING->READY')
  UNION ALL SELECT task_id, seq, CASE WHEN role = 'guest' THEN 'unknown_role:guest' WHEN role = 'subagent' THEN 'subagent_cannot:' || edge
      ELSE 'verifier_cannot:' || edge END FROM a WHERE role = 'guest' OR role = 'verifier'
      OR (role = 'subagent' AND edge NOT IN ('RUNNING->SUBMITTED', 'RUNNING->FAILED', 'RUNNING->READY'))
  UNION ALL SELECT task_id, seq, 'bad_yield_reason:' || coalesce(json_extract_string(payload, '$.reason'), 'None') FROM a
    WHERE edge = 'RUNNING->READY' AND coalesce(json_extract_string(payload, '$.reason'), 'None') <> 'timeout'
  UNION ALL SELECT task_id, seq, 'broken_chain:' || pt FROM a WHERE pt IS NOT NULL AND pt <> from_s
  UNION ALL SELECT task_id, seq, 'bad_attempts' FROM a WHERE attempts <> coalesce(pa, 0)""")
def transition_audit(spark, d):
    return L.transition_audit(event_log(spark, d), F.floor(F.col("seq") / 1_000_000)).select("task_id", "seq", "problem")


@R.add("yield_overuse", f"""WITH {LOG} SELECT task_id, count(*) AS n_yields FROM app WHERE from_s = 'RUNNING' AND to_s = 'READY'
  GROUP BY 1 HAVING count(*) > 5""")
def yield_overuse(spark, d):
    return L.yield_overuse(event_log(spark, d)).drop("plan_id")


@R.add("dwell_times", f"""WITH {LOG}, p AS (SELECT task_id, seq, ts_us, lag(to_s) OVER w AS state, lag(ts_us) OVER w AS since FROM app
    WINDOW w AS (PARTITION BY plan_id, task_id ORDER BY seq))
  SELECT task_id, seq, state, round((ts_us - since) / 1e6, 6) AS seconds FROM p WHERE state IS NOT NULL""")
def dwell_times(spark, d):
    t = L.dwell_times(event_log(spark, d), F.floor(F.col("seq") / 1_000_000))
    return t.select("task_id", "seq", "state", F.round("seconds", 6).alias("seconds"))


@R.add("dwell_summary", f"""WITH {LOG}, p AS (SELECT ts_us, lag(to_s) OVER w AS state, lag(ts_us) OVER w AS since FROM app
    WINDOW w AS (PARTITION BY plan_id, task_id ORDER BY seq))
  SELECT state, count(*) AS n, round(avg((ts_us - since) / 1e6), 3) AS avg_s, round(quantile_disc((ts_us - since) / 1e6, 0.95), 3) AS p95_s, quantile_disc((ts_us - since) / 1e6, 0.95) <= 60 AS within_sla
  FROM p WHERE state IS NOT NULL GROUP BY state""")
def dwell_summary(spark, d):
    s = L.dwell_summary(L.dwell_times(event_log(spark, d), F.floor(F.col("seq") / 1_000_000)))
    return s.select("state", "n", F.round("avg_s", 3).alias("avg_s"), F.round("p95_s", 3).alias("p95_s"), "within_sla")


@R.add("recent_events", f"""WITH {LOG} SELECT plan_id, seq, to_s, row_number() OVER (PARTITION BY plan_id ORDER BY seq DESC) AS recency FROM log
  QUALIFY recency <= 20""")
def recent_events(spark, d):
    return L.recent_events(event_log(spark, d), 20).select("plan_id", "seq", "to_s", "recency")


@R.add("last_error", f"""WITH {LOG}, r AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY seq DESC) <= 50),
  e AS (SELECT task_id, seq, coalesce(json_extract_string(payload, '$.detail'), json_extract_string(payload, '$.reason')) AS err FROM r)
  SELECT task_id, arg_max(err, seq) AS last_error FROM e WHERE err IS NOT NULL GROUP BY task_id""")
def last_error(spark, d):
    return L.last_error(event_log(spark, d)).drop("plan_id")


@R.add("latest_message", """WITH m AS (SELECT conv_id, turn, role, length(text) AS tokens FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 40)
  SELECT conv_id AS session_id, max(turn) AS pos, arg_max(tokens, turn) AS tokens, round(arg_max(tokens, turn) / 3000 * 100, 1) AS pct_of_limit
  FROM m WHERE role = 'assistant' AND tokens > 0 GROUP BY conv_id""")
def latest_message(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role",
                                                F.length("text").cast("long").alias("tokens"))
    return L.latest_message(c, 3000)


@R.add("metric_rollup", """SELECT event_type AS name, user_id % 10 AS plan_id, count(*) AS n, round(sum(value), 2) AS total,
  round(avg(value), 4) AS avg, max(value) AS max FROM events GROUP BY ALL""")
def metric_rollup(spark, d):
    m = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 10).alias("plan_id"), "value")
    r = L.metric_rollup(m, ["name", "plan_id"])
    return r.withColumn("total", F.round("total", 2)).withColumn("avg", F.round("avg", 4))


STATUS = {"F": "DONE", "O": "READY", "P": "RUNNING"}
ST_SQL = ("CASE WHEN o_orderkey % 50 = 0 THEN 'DEAD_LETTER' WHEN o_orderkey % 50 = 1 THEN 'FAILED' WHEN o_orderkey % 50 = 2 THEN 'RETRY' "
          "WHEN o_orderkey % 50 = 3 THEN 'VERIFYING' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'READY' ELSE 'RUNNING' END")
PRIO_SQL = "CAST(substring(o_orderpriority, 1, 1) AS INT) * 2"
NOW_US = 1_000_000_000_000_000
T_SQL = f"""t AS (SELECT 'plan' || (o_custkey % 40) || CASE WHEN o_custkey % 40 < 5 THEN '_1996-03-01' ELSE '' END AS plan_id, o_orderkey AS task_id,
  {ST_SQL} AS status, CAST(o_orderkey % 5 AS INT) AS attempts, 3 AS max_attempts, CAST(o_orderkey % 6 AS INT) AS session_switch_total, {PRIO_SQL} AS priority,
  o_orderkey AS seq, epoch_us(o_orderdate) AS enqueued_us, o_orderdate + INTERVAL 20 HOUR AS enqueued_at,
  epoch_us(o_orderdate) + CAST(round(o_totalprice) AS BIGINT) * 1000000 AS updated_us,
  CASE WHEN o_orderkey % 3 > 0 THEN {NOW_US} + (o_orderkey - 7000) * 1000000 END AS lease_us, CASE WHEN o_orderkey % 2 = 0 THEN 'w1' END AS owner FROM orders)"""


def tasks(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    base = epoch_micros(F.col("o_orderdate"))
    return o.select(
        F.concat(F.lit("plan"), (F.col("o_custkey") % 40).cast("string"),
                 F.when(F.col("o_custkey") % 40 < 5, "_1996-03-01").otherwise("")).alias("plan_id"),
        k.alias("task_id"), F.expr(ST_SQL).alias("status"), (k % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        (k % 6).cast("int").alias("session_switch_total"), F.expr(PRIO_SQL).alias("priority"), k.alias("seq"),
        base.alias("enqueued_us"), (F.col("o_orderdate") + F.expr("INTERVAL 20 HOURS")).alias("enqueued_at"),
        (base + F.round("o_totalprice").cast("long") * 1000000).alias("updated_us"),
        F.when(k % 3 > 0, NOW_US + (k - 7000) * 1000000).alias("lease_us"), F.when(k % 2 == 0, "w1").alias("owner"))


@R.add("status_counts", f"WITH {T_SQL} SELECT plan_id, status, count(*) AS n FROM t GROUP BY ALL")
def status_counts(spark, d):
    return L.status_counts(tasks(spark, d))


@R.add("plan_summary", f"""WITH {T_SQL} SELECT plan_id, count(*) AS total, count(*) FILTER (status = 'DONE') AS n_done,
  count(*) FILTER (status = 'DEAD_LETTER') AS n_dead_letter, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(session_switch_total) AS BIGINT) AS switches FROM t GROUP BY plan_id""")
def plan_summary(spark, d):
    return L.plan_summary(tasks(spark, d), ["DONE", "DEAD_LETTER"])


BOARD = f"""b AS (SELECT count(*) FILTER (status = 'READY') AS ready_total, count(*) FILTER (status = 'RUNNING') AS running,
    max(CASE WHEN status = 'READY' THEN greatest(0, ({NOW_US} - updated_us) / 1e6) END) AS oldest,
    CAST(sum(CASE WHEN status NOT IN ('DONE', 'DEAD_LETTER', 'CANCELLED') THEN session_switch_total ELSE 0 END) AS BIGINT) AS session_switch_total FROM t),
  m AS (SELECT avg(CASE WHEN event_type = 'view' THEN value END) dw, count(*) FILTER (event_type = 'click') AS cache_hit FROM events),
  board AS (SELECT ready_total, running, CAST(floor(oldest) AS BIGINT) AS oldest_wait_s, oldest > 60 AS queue_blocked, round(dw, 2) AS dispatch_wait_avg_s,
    session_switch_total, cache_hit, ready_total > 50 OR oldest > 3600 AS backlog_alert FROM b, m)"""


@R.add("queue_board", f"WITH {T_SQL}, {BOARD} SELECT * FROM board")
def queue_board(spark, d):
    return L.queue_board(tasks(spark, d), log_metrics(spark, d), NOW_US)


def log_metrics(spark, d):
    return table(spark, d, "events").select(
        F.when(F.col("event_type") == "view", "dispatch_wait").when(F.col("event_type") == "click", "cache_hit")
        .otherwise("other").alias("name"), "value")


@R.add("ready_by_priority", f"WITH {T_SQL} SELECT priority, count(*) AS n FROM t WHERE status = 'READY' GROUP BY 1")
def ready_by_priority(spark, d):
    return L.ready_by_priority(tasks(spark, d))


MINE = """mine AS (SELECT DISTINCT plan_id FROM t WHERE contains(plan_id, '1996-03-01')
  OR CAST(enqueued_at + INTERVAL 8 HOUR AS DATE) = DATE '1996-03-01')"""
REPORT = """rep AS (SELECT count(*) AS total, count(DISTINCT plan_id) AS n_plans, count(*) FILTER (status = 'DONE') AS done,
  count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'DEAD_LETTER') AS dead_letter,
  count(*) FILTER (status = 'SKIPPED_CACHED') AS skipped_cached, CAST(sum(attempts) AS BIGINT) AS retries, CAST(sum(session_switch_total) AS BIGINT) AS switches
  FROM t SEMI JOIN mine USING (plan_id))"""


@R.add("daily_report", f"WITH {T_SQL}, {MINE}, {REPORT} SELECT * FROM rep")
def daily_report(spark, d):
    return L.daily_report(tasks(spark, d), "1996-03-01")


@R.add("unfinished_plans", f"""WITH {T_SQL} SELECT plan_id, count(*) FILTER (status NOT IN ('DONE', 'FAILED', 'DEAD_LETTER', 'SKIPPED_CACHED')) AS n_unfinished,
  count(*) AS total FROM t GROUP BY plan_id HAVING n_unfinished > 0""")
def unfinished_plans(spark, d):
    return L.unfinished_plans(tasks(spark, d))


@R.add("quality_flags", f"""WITH {T_SQL} SELECT plan_id, task_id, 'P0:dead_letter' AS flag FROM t WHERE status = 'DEAD_LETTER'
  UNION ALL SELECT plan_id, task_id, 'switches' FROM t WHERE session_switch_total > 3""")
def quality_flags(spark, d):
    return L.quality_flags(tasks(spark, d))


@R.add("tuning_hints", f"""WITH {T_SQL}, {MINE}, {REPORT}, {BOARD} SELECT 'session_switches' AS hint FROM rep WHERE switches >= 10
  UNION ALL SELECT 'ready_backlog' FROM board WHERE ready_total > 50 UNION ALL SELECT 'oldest_wait' FROM board WHERE oldest_wait_s > 60""")
def tuning_hints(spark, d):
    t = tasks(spark, d)
    return L.tuning_hints(L.daily_report(t, "1996-03-01"), L.queue_board(t, log_metrics(spark, d), NOW_US), 10, 60.0)


@R.add("span_top", """SELECT user_id AS task_id, CAST(sum(round(value * 100)) AS BIGINT) AS total_ms FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def span_top(spark, d):
    rec = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.round(F.col("value") * 100).cast("long").alias("duration_ms"))
    return L.span_top(rec, 10)


@R.add("ready_ordered", f"WITH {T_SQL} SELECT task_id, priority, seq FROM t WHERE status = 'READY' AND priority BETWEEN 4 AND 8 ORDER BY priority, seq LIMIT 50")
def ready_ordered(spark, d):
    return L.ready_ordered(tasks(spark, d), 50, 4, 8).select("task_id", "priority", "seq")


@R.add("slow_tasks", f"""WITH {T_SQL} SELECT task_id, CAST((updated_us - enqueued_us) / 1000000 AS DOUBLE) AS elapsed_s FROM t
  WHERE updated_us - enqueued_us >= 120000000 ORDER BY 2 DESC, 1 LIMIT 5""")
def slow_tasks(spark, d):
    return L.slow_tasks(tasks(spark, d)).select("task_id", "elapsed_s")


@R.add("exit_code", f"""WITH {T_SQL} SELECT plan_id, CAST(CASE WHEN bool_or(status = 'DEAD_LETTER') THEN 2
  WHEN bool_or(status NOT IN ('DONE', 'DEAD_LETTER', 'CANCELLED', 'SKIPPED', 'SKIPPED_CACHED')) THEN 1 ELSE 0 END AS INT) AS exit_code FROM t GROUP BY 1""")
def exit_code(spark, d):
    return L.exit_code(tasks(spark, d))


@R.add("task_health", f"""WITH {T_SQL}, h AS (SELECT *, coalesce(lease_us <= {NOW_US}, true) AS ex, ({NOW_US} - enqueued_us) / 1e6 AS waited FROM t)
  SELECT task_id, status = 'RUNNING' AND ex AS lease_expired, status = 'VERIFYING' AND (owner IS NULL OR ex) AS verify_requeue,
    status = 'RETRY' AND ({NOW_US} - updated_us) / 1e6 >= least(3600.0, 60.0 * pow(2, attempts)) AS retry_due,
    status IN ('FAILED', 'RETRY') AND attempts >= max_attempts AS exhausted,
    CASE WHEN status <> 'READY' THEN NULL WHEN waited >= 1200 AND priority <= 5 AND priority > 3 THEN 3 WHEN waited >= 600 AND priority > 5 THEN 5 END AS aging_target,
    status = 'READY' AND ({NOW_US} - updated_us) / 1e6 > 60 AS sla_breach FROM h""")
def task_health(spark, d):
    return L.task_health(tasks(spark, d), NOW_US).drop("plan_id")


@R.add("limit_errors", """SELECT status, kind, count(*) AS n, count(*) FILTER (status IN (429, 529) OR (status IN (400, 402, 403, 500, 502, 503) AND kind IN (0, 1))) AS n_limit
  FROM (SELECT CASE event_id % 8 WHEN 0 THEN 429 WHEN 1 THEN 529 WHEN 2 THEN 400 WHEN 3 THEN 403 WHEN 4 THEN 500 WHEN 5 THEN 404 WHEN 6 THEN 401 END AS status,
    CAST(user_id % 4 AS INT) AS kind FROM events) GROUP BY ALL""")
def limit_errors(spark, d):
    k, u = F.col("event_id") % 8, F.col("user_id") % 4
    status = F.expr("CASE event_id % 8 WHEN 0 THEN 429 WHEN 1 THEN 529 WHEN 2 THEN 400 WHEN 3 THEN 403 WHEN 4 THEN 500 WHEN 5 THEN 404 WHEN 6 THEN 401 END")
    msg = F.when(u == 0, "Quota exceeded").when(u == 1, "server OVERLOADED").when(u == 2, "bad request")
    e = table(spark, d, "events").select(status.alias("status"), u.cast("int").alias("kind"), msg.alias("message"))
    return L.limit_errors(e).groupBy("status", "kind").agg(F.count("*").alias("n"), F.count_if("is_limit").alias("n_limit"))


@R.add("context_pressure", """SELECT user_id % 3 AS w, count(*) FILTER (CASE WHEN user_id % 3 > 0 THEN value / ((user_id % 3) * 10) >= 0.8 ELSE false END) AS n_pressed
  FROM events GROUP BY 1""")
def context_pressure(spark, d):
    u = table(spark, d, "events").select((F.col("user_id") % 3).alias("w"), (F.col("user_id") % 3 * 10).alias("window"),
                                         F.col("value").alias("prompt_tokens"))
    return L.context_pressure(u, 0.8).groupBy("w").agg(F.count_if("pressure").alias("n_pressed"))


@R.add("provider_health", """WITH l AS (SELECT event_type AS provider, event_id, event_id % 6 <> 0 AS ok, event_id % 30 = 0 AS perm, user_id AS st,
    CAST(round(value * 10) AS BIGINT) AS ms FROM events)
  SELECT provider, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, arg_max(st, event_id) FILTER (perm) AS last_permanent,
    list_sort(list(ms) FILTER (ok))[count(*) FILTER (ok) // 2 + 1] AS p50_ms FROM l GROUP BY provider""")
def provider_health(spark, d):
    log = table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), (F.col("event_id") % 6 != 0).alias("ok"),
        (F.col("event_id") % 30 == 0).alias("permanent"), F.col("user_id").alias("status"),
        F.round(F.col("value") * 10).cast("long").alias("latency_ms"))
    return L.provider_health(log)


@R.add("rule_handoff", """SELECT l_orderkey AS task_id, substring(string_agg('r' || l_linenumber || CASE WHEN l_quantity > 5 THEN ':ok' ELSE ':FAIL rows=' || CAST(l_quantity AS INT) END, '; '
    ORDER BY l_linenumber, l_partkey, l_suppkey), 1, 2000) AS handoff, bool_and(l_quantity > 5) AS passed FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def rule_handoff(spark, d):
    r = table(spark, d, "lineitem").select(
        F.lit("p").alias("plan_id"), F.col("l_orderkey").alias("task_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rule_id"), (F.col("l_quantity") > 5).alias("ok"),
        F.when(F.col("l_returnflag") == "R", "coverage").when(F.col("l_returnflag") == "A", "row_count").otherwise("file_exists").alias("type"),
        F.concat(F.lit("rows="), F.col("l_quantity").cast("int").cast("string")).alias("detail"))
    return L.rule_handoff(r).drop("plan_id")


@R.add("decomposition_view", """SELECT p_partkey AS task_id, p_name AS objective, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE '' END AS slice_rationale,
  p_partkey % 4 = 0 AS missing FROM part""")
def decomposition_view(spark, d):
    t = table(spark, d, "part").select(F.lit("p").alias("plan_id"), F.col("p_partkey").alias("task_id"), F.col("p_name").alias("objective"),
                                       F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).otherwise("").alias("slice_rationale"))
    return L.decomposition_view(t).drop("plan_id")


@R.add("final_consistency", """WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'DONE' WHEN p_partkey % 3 = 1 THEN 'READY' ELSE 'SKIPPED' END AS status,
    p_partkey // 2 AS dep FROM part),
  recent AS (SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 50)
  SELECT id AS task_id, 'dag:self_dependency' AS problem FROM t WHERE id = dep
  UNION ALL SELECT t.id, 'terminal_with_unmet_deps' FROM t JOIN t x ON x.id = t.dep WHERE t.status IN ('DONE', 'SKIPPED') AND x.status = 'READY'
  UNION ALL SELECT id, 'no_acceptance_rules' FROM t WHERE id % 20 = 0
  UNION ALL SELECT id, 'terminal_without_audit_row' FROM t WHERE status = 'DONE' AND id NOT IN (SELECT user_id FROM recent WHERE event_type = 'purchase')
  UNION ALL SELECT id, 'missing_four_set:' || s FROM t, unnest(['sources.json', 'claims.json', 'tuning.md']) u(s) WHERE id % 25 = 0 AND NOT (s = 'sources.json' AND id % 50 = 0)
  UNION ALL SELECT id, 'missing_artifact:out/' || id || '.md' FROM t WHERE id % 10 = 9""")
def final_consistency(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    t = p.select(F.lit(1).alias("plan_id"), k.alias("task_id"), F.when(k % 3 == 0, "DONE").when(k % 3 == 1, "READY").otherwise("SKIPPED").alias("status"),
                 F.array(F.floor(k / 2).cast("long")).alias("depends_on"), F.when(k % 20 == 0, 0).otherwise(2).alias("n_rules"),
                 (k % 25 == 0).alias("needs_web"), F.lit("2024-01-01").alias("day"),
                 F.array(F.concat(F.lit("out/"), k.cast("string"), F.lit(".md"))).alias("outputs"))
    have = p.filter("p_partkey % 10 <> 9").select(F.concat(F.lit("out/"), k.cast("string"), F.lit(".md")).alias("path")).unionByName(
        p.filter("p_partkey % 50 = 0").select(F.concat(F.lit("artifacts/2024-01-01/"), k.cast("string"), F.lit(".sources.json")).alias("path")))
    ev = event_log(spark, d).withColumn("plan_id", F.lit(1))
    return L.final_consistency(t, ev, have).drop("plan_id")


@R.add("cache_hits", """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'h' || (o_orderkey % 4) END AS ih,
    CASE WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'h' || (o_orderkey % 4 + CASE WHEN o_orderkey % 9 = 2 THEN 1 ELSE 0 END) END AS lh FROM orders),
  f AS (SELECT l_orderkey, l_linenumber, 'f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS path, CASE WHEN l_partkey % 40 = 0 THEN 'missing_artifact:'
    WHEN l_partkey % 40 = 1 THEN 'empty_artifact:' WHEN l_partkey % 40 = 2 THEN 'no_manifest:' WHEN l_partkey % 40 = 3 THEN 'manifest_no_sha:'
    WHEN l_partkey % 40 = 4 THEN 'artifact_sha_mismatch:' END AS why, l_partkey, l_suppkey FROM lineitem),
  b AS (SELECT l_orderkey, arg_min(why || path, (l_linenumber, l_partkey, l_suppkey)) w, count(*) n FROM f WHERE why IS NOT NULL GROUP BY 1),
  c AS (SELECT l_orderkey, count(*) n FROM f GROUP BY 1),
  r AS (SELECT id, CASE WHEN ih = '' THEN 'no_inputs_hash' WHEN lh IS NULL THEN 'no_last_success' WHEN ih <> lh THEN 'inputs_changed'
    WHEN c.n IS NULL THEN 'no_outputs' ELSE coalesce(w, 'inputs_and_artifacts_match') END AS reason
    FROM t LEFT JOIN b ON b.l_orderkey = id LEFT JOIN c ON c.l_orderkey = id)
  SELECT id AS task_id, reason = 'inputs_and_artifacts_match' AS hit, reason FROM r""")
def cache_hits(spark, d):
    k, p = F.col("o_orderkey"), F.col("l_partkey")
    path = F.concat(F.lit("f"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), p.cast("string")))
    li = table(spark, d, "lineitem").withColumn("path", path)
    outs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "path"))).alias("o"))
    t = table(spark, d, "orders").join(outs, k == F.col("l_orderkey"), "left").select(
        F.lit("p").alias("plan_id"), k.alias("task_id"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("h"), (k % 4).cast("string"))).alias("inputs_hash"),
        F.when(k % 9 != 1, F.concat(F.lit("h"), (k % 4 + F.when(k % 9 == 2, 1).otherwise(0)).cast("string"))).alias("last_success_hash"),
        F.coalesce(F.transform("o", lambda x: x["path"]), F.array().cast("array<string>")).alias("outputs"))
    man = li.filter(p % 40 != 0).groupBy("path", p.alias("p")).agg(F.count("*").alias("c")).select(
        "path", F.when(F.col("p") % 40 == 1, 0).otherwise(10).alias("bytes"), F.lit("aa").alias("sha256"),
        F.when(F.col("p") % 40 == 3, "").when(F.col("p") % 40 == 4, "bb").when(F.col("p") % 40 != 2, "aa").alias("recorded_sha"))
    return L.cache_hits(t, man).drop("plan_id")


@R.add("price_gap_days", """WITH j AS (SELECT 'job' || n_nationkey AS job_id, n_nationkey FROM nation),
  d AS (SELECT CAST(unnest(generate_series(DATE '2024-03-01', DATE '2024-03-10', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT job_id || '_' || CAST(day AS VARCHAR) AS plan_id, CASE WHEN day <> DATE '2024-03-10' AND DATE '2024-03-10' - day > 3 THEN 'skipped_overdue' ELSE 'run' END AS action
  FROM j, d WHERE (n_nationkey + day(day)) % 3 <> 0""")
def price_gap_days(spark, d):
    n = table(spark, d, "nation")
    jobs = n.select(F.concat(F.lit("job"), F.col("n_nationkey").cast("string")).alias("job_id"))
    days = F.explode(F.sequence(F.lit("2024-03-01").cast("date"), F.lit("2024-03-10").cast("date")))
    plans = (n.select("n_nationkey", days.alias("day")).filter((F.col("n_nationkey") + F.dayofmonth("day")) % 3 == 0)
             .select(F.concat(F.lit("job"), F.col("n_nationkey").cast("string"), F.lit("_"), F.date_format("day", "yyyy-MM-dd")).alias("plan_id")))
    return L.price_gap_days(jobs, plans, "2024-03-10", 10, 3).select("plan_id", "action")


@R.add("idempotent_insert", """WITH old AS (SELECT o_custkey AS task_id, 'k' || o_custkey || '/' || (o_orderkey % 3) AS k FROM orders WHERE o_orderkey % 2 = 0),
  inc AS (SELECT o_orderkey AS pos, o_custkey AS task_id, 'k' || o_custkey || '/' || (o_orderkey % 3) AS k, o_custkey IN (SELECT task_id FROM old) AS had,
    first_value('k' || o_custkey || '/' || (o_orderkey % 3)) OVER w AS k1, row_number() OVER w AS rn FROM orders WHERE o_orderkey % 2 = 1 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  SELECT pos, CASE WHEN k IN (SELECT k FROM old) THEN 'already_exists' WHEN had THEN 'conflict' WHEN rn = 1 THEN 'inserted' WHEN k = k1 THEN 'already_exists' ELSE 'conflict' END AS outcome FROM inc""")
def idempotent_insert(spark, d):
    o = table(spark, d, "orders").select(
        F.lit("p").alias("plan_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("k"), F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 3).cast("string")).alias("idempotency_key"))
    return L.idempotent_insert(o.filter("pos % 2 = 0"), o.filter("pos % 2 = 1")).select("pos", "outcome")


@R.add("alert_levels", """SELECT level, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'P0' WHEN 'click' THEN 'P1' WHEN 'signup' THEN 'P1' ELSE 'P2' END AS level
  FROM events) GROUP BY level""")
def alert_levels(spark, d):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'dead_letter' WHEN 'click' THEN 'dag_invalid' WHEN 'signup' THEN 'lease_expired' WHEN 'purchase' THEN 'slow_task' ELSE 'x' END")
    return table(spark, d, "events").groupBy(L.alert_level(kind).alias("level")).agg(F.count("*").alias("n"))


NAME_SQL = ("CASE l_partkey % 6 WHEN 0 THEN 'report.md' WHEN 1 THEN 'charts.md' WHEN 2 THEN 'data.csv' WHEN 3 THEN 'notes.txt' "
            "WHEN 4 THEN 'policy_report.md' ELSE 'zz.pdf' END")


@R.add("pick_report_links", f"""WITH o AS (SELECT DISTINCT l_orderkey AS plan_id, 'a/' || l_linenumber || '/' || {NAME_SQL} AS path, {NAME_SQL} AS nm, l_linenumber FROM lineitem),
  ok AS (SELECT *, CASE nm WHEN 'report.md' THEN 1 WHEN 'policy_report.md' THEN 4 WHEN 'charts.md' THEN 7 ELSE 9 END AS o FROM o WHERE nm <> 'data.csv' AND l_linenumber <> 3)
  SELECT plan_id, path, row_number() OVER (PARTITION BY plan_id ORDER BY o, path) AS rank FROM ok QUALIFY rank <= 2""")
def pick_report_links(spark, d):
    path = F.concat(F.lit("a\\"), F.col("l_linenumber").cast("string"), F.lit("\\"), F.expr(NAME_SQL))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), path.alias("path"), "l_linenumber")
    have = li.filter("l_linenumber <> 3").select(F.translate("path", "\\", "/").alias("path"))
    return L.pick_report_links(li, have)


@R.add("log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 120")
def log_tail(spark, d):
    return L.log_tail(table(spark, d, "events").select("event_id", "event_type"), 120, "event_id")
