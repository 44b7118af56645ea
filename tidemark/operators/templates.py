"""Job templates expanded over dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_template(templates: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """One task row per template task and date.

    Templates hold job_id, task_id, objective, outputs array<string> and acceptance
    array<struct<rule_id, type, path>>. `{date}` is the day, `{output}` the task's first output,
    a rule without id is named by its position.
    """
    days = F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    rows = templates.withColumn("date", F.explode(days)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))

    def dated(c):
        return F.replace(c, F.lit("{date}"), F.col("date"))

    rows = rows.withColumn("outputs", F.transform("outputs", dated))
    first_output = F.coalesce(F.get("outputs", F.lit(0)), F.lit(""))
    rule = F.transform("acceptance", lambda r, j: F.struct(
        F.coalesce(r["rule_id"], F.concat(F.lit("rule_"), j.cast("string"))).alias("rule_id"),
        r["type"].alias("type"),
        F.replace(dated(r["path"]), F.lit("{output}"), first_output).alias("path")))
    plan = F.concat_ws("_", "job_id", "date")
    return rows.select(
        plan.alias("plan_id"), "task_id", F.concat_ws(":", plan, "task_id").alias("idempotency_key"),
        F.replace(dated(F.col("objective")), F.lit("{output}"), first_output).alias("objective"),
        "outputs", rule.alias("acceptance"))
