"""Dependency graphs derived from part: each part depends on the part of half its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, table
from tidemark.operators import graph as G
from tidemark.operators.lineage import heirs

R = Registry()
QUERIES, SQL = R.queries, R.sql

STATUS = ("CASE WHEN p_partkey % 41 = 0 THEN 'DEAD_LETTER' WHEN p_partkey % 13 = 0 THEN 'RUNNING' WHEN p_partkey % 5 = 0 THEN 'DONE' "
          "WHEN p_partkey % 5 = 1 THEN 'SKIPPED' WHEN p_partkey % 5 = 2 THEN 'READY' WHEN p_partkey % 5 = 3 THEN 'PENDING' ELSE 'BLOCKED' END")
TASKS_SQL = f"tasks AS (SELECT 'plan' AS plan_id, p_partkey AS task_id, {STATUS} AS status FROM part)"
# 0 names itself, every 97th names a part that does not exist, and every hundred holds one three-step loop
DEPS_SQL = """deps AS (SELECT p_partkey AS task_id, p_partkey // 2 AS dep FROM part
  UNION ALL SELECT p_partkey, p_partkey + 10000000 FROM part WHERE p_partkey % 97 = 0
  UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 100 IN (60, 61)
  UNION ALL SELECT p_partkey, p_partkey - 2 FROM part WHERE p_partkey % 100 = 62)"""


def tasks(spark, d, loops=True):
    k = F.col("p_partkey")
    deps = [F.floor(k / 2).cast("long"), F.when(k % 97 == 0, k + 10000000)]
    if loops:
        deps += [F.when((k % 100).isin(60, 61), k + 1), F.when(k % 100 == 62, k - 2)]
    return table(spark, d, "part").select(F.lit("plan").alias("plan_id"), k.alias("task_id"), F.expr(STATUS).alias("status"),
                                          F.array_compact(F.array(*deps)).alias("depends_on"))


@R.add("unsatisfied_deps", f"""WITH {TASKS_SQL}, {DEPS_SQL} SELECT d.task_id, d.dep, coalesce(t.status, 'MISSING') AS dep_status
  FROM deps d LEFT JOIN tasks t ON t.task_id = d.dep WHERE coalesce(t.status, 'MISSING') NOT IN ('DONE', 'SKIPPED', 'SKIPPED_CACHED')""")
def unsatisfied_deps(spark, d):
    return G.unsatisfied_deps(tasks(spark, d)).select("task_id", "dep", "dep_status")


@R.add("ready_tasks", f"""WITH {TASKS_SQL}, {DEPS_SQL} SELECT task_id, status FROM tasks WHERE status IN ('PENDING', 'BLOCKED')
  AND task_id NOT IN (SELECT d.task_id FROM deps d LEFT JOIN tasks t ON t.task_id = d.dep WHERE coalesce(t.status, 'MISSING') NOT IN ('DONE', 'SKIPPED', 'SKIPPED_CACHED'))""")
def ready_tasks(spark, d):
    return G.ready_tasks(tasks(spark, d)).select("task_id", "status")


@R.add("dependents", f"""WITH {DEPS_SQL} SELECT dep, count(*) AS n_dependents, min(task_id) AS first_dependent, max(task_id) AS last_dependent
  FROM deps GROUP BY dep""")
def dependents(spark, d):
    return G.dependents(tasks(spark, d)).drop("plan_id")


@R.add("cancel_closure", f"""WITH RECURSIVE {TASKS_SQL}, {DEPS_SQL},
  roots AS (SELECT task_id AS root FROM tasks WHERE status = 'DEAD_LETTER'),
  walk AS (SELECT root, root AS node FROM roots UNION SELECT w.root, d.task_id FROM walk w JOIN deps d ON d.dep = w.node
    JOIN tasks t ON t.task_id = d.task_id AND t.status IN ('PENDING', 'BLOCKED', 'READY'))
  SELECT node AS task_id, min(root) AS cascaded_from FROM walk WHERE node NOT IN (SELECT root FROM roots) GROUP BY 1""")
def cancel_closure(spark, d):
    t = tasks(spark, d)
    return G.cancel_closure(t, t.filter("status = 'DEAD_LETTER'")).drop("plan_id")


@R.add("dag_problems", f"""WITH RECURSIVE {DEPS_SQL},
  inner_e AS (SELECT task_id, dep FROM deps WHERE dep <> task_id AND dep IN (SELECT p_partkey FROM part)),
  walk AS (SELECT task_id, dep FROM inner_e UNION SELECT w.task_id, e.dep FROM walk w JOIN inner_e e ON e.task_id = w.dep)
  SELECT task_id, 'self_dependency' AS problem, dep FROM deps WHERE dep = task_id
  UNION ALL SELECT task_id, 'missing_dependency', dep FROM deps WHERE dep NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT task_id, 'cycle', NULL FROM walk WHERE task_id = dep""")
def dag_problems(spark, d):
    return G.dag_problems(tasks(spark, d)).drop("plan_id")


@R.add("closure_sizes", f"""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0),
  walk AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM walk w JOIN e ON e.src = w.dst)
  SELECT src, count(*) AS n_ancestors FROM walk GROUP BY src""")
def closure_sizes(spark, d):
    e = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"),
                                                               F.floor(F.col("p_partkey") / 2).alias("dst"))
    pairs = heirs(e.select(F.col("src").alias("entity_id"), F.col("dst").alias("inherits_from")))
    return pairs.groupBy(F.col("heir").alias("src")).agg(F.count("*").alias("n_ancestors"))


@R.add("stuck_on_dead", """WITH RECURSIVE t AS (SELECT 'plan' || (p_partkey % 7) AS plan_id, p_partkey AS task_id, CASE
    WHEN p_partkey < 7 AND p_partkey <> 3 THEN 'DEAD_LETTER' WHEN p_partkey % 7 = 4 AND p_partkey > 500 THEN 'RUNNING'
    WHEN p_partkey % 35 = 5 THEN 'DONE' ELSE 'PENDING' END AS status, CASE WHEN p_partkey % 7 = 1 AND p_partkey > 900 THEN -1
    WHEN p_partkey >= 7 THEN p_partkey // 7 // 2 * 7 + p_partkey % 7 END AS dep FROM part),
  walk AS (SELECT plan_id, task_id FROM t WHERE status = 'DEAD_LETTER' UNION
    SELECT t.plan_id, t.task_id FROM walk w JOIN t ON t.plan_id = w.plan_id AND t.dep = w.task_id),
  c AS (SELECT t.plan_id, count(*) FILTER (status = 'DEAD_LETTER') AS n_dead,
    count(*) FILTER (status IN ('PENDING', 'RUNNING')) AS n_waiting, count(*) FILTER (status = 'RUNNING') AS n_moving,
    count(*) FILTER (status IN ('PENDING', 'RUNNING') AND w.task_id IS NULL) AS n_free
    FROM t LEFT JOIN walk w USING (plan_id, task_id) GROUP BY 1)
  SELECT plan_id, n_dead, n_waiting, n_dead > 0 AND n_waiting > 0 AND n_moving = 0 AND n_free = 0 AS stuck FROM c""")
def stuck_on_dead(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(
        F.concat(F.lit("plan"), (k % 7).cast("string")).alias("plan_id"), k.alias("task_id"),
        F.when((k < 7) & (k != 3), "DEAD_LETTER").when((k % 7 == 4) & (k > 500), "RUNNING")
        .when(k % 35 == 5, "DONE").otherwise("PENDING").alias("status"),
        F.array_compact(F.array(F.when((k % 7 == 1) & (k > 900), -1).when(k >= 7, F.floor(F.floor(k / 7) / 2) * 7 + k % 7))).alias("depends_on"))
    return G.stuck_on_dead(t)
