"""Sinks. Every write is repeatable: the same input written twice leaves the same files or tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.operators import observations as O
from tidemark.plans.snapshot import snapshot_documents
from tidemark.session import cut_lineage, scratch


def write_snapshot(snapshot: DataFrame, contrasts: DataFrame, date: str, path: str) -> None:
    """Nested documents per entity and contrast rows, under date=<date>."""
    snapshot_documents(snapshot).write.mode("overwrite").json(f"{path}/date={date}/entities")
    contrasts.write.mode("overwrite").json(f"{path}/date={date}/contrasts")


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str] = O.OBS_KEY,
                      updated: Sequence[str] = O.OBS_UPDATED) -> DataFrame:
    """Merge incoming rows into a table partitioned by obs_date, rewriting only the dates they touch.

    The merged dates are staged in the shared folder first, since a path cannot be read and overwritten at once.
    """
    kept = [c for c in incoming.columns if c != "pos"]
    # appending no rows creates a missing table and leaves an existing one alone
    incoming.select(*kept).limit(0).write.mode("append").partitionBy("obs_date").parquet(path)
    schema = incoming.select(*kept).schema
    table = spark.read.schema(schema).parquet(path)
    # the touched dates are bounded by the calendar; as literals they prune the table's folders
    dates = incoming.agg(F.sort_array(F.collect_set("obs_date"))).first()[0]
    touched = table.filter(F.col("obs_date").isin(*dates)) if dates else table.limit(0)
    with scratch(spark):
        merged = cut_lineage(O.upsert_observations(touched, incoming, key, updated))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obs_date").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _label(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def prometheus_lines(metrics: DataFrame, tasks: DataFrame, prefix: str = "orchestrator") -> DataFrame:
    """Text exposition lines: count, sum and average per metric and plan, status gauges per plan, and the ready gauge."""
    name = F.regexp_replace("name", "[^A-Za-z0-9]", "_")
    roll = metrics.groupBy("name", "plan_id").agg(F.count(F.lit(1)).alias("count"), F.sum(F.coalesce("value", F.lit(0.0))).alias("sum"),
                                                  F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg"))
    plan = _label(F.col("plan_id").cast("string"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (
        ("count", F.col("count").cast("string")), ("sum", F.format_string("%.4f", "sum")), ("avg", F.format_string("%.4f", "avg")))])
    lines = roll.select(name.alias("n"), plan.alias("p"), F.inline(parts)).select(
        F.format_string(f'{prefix}_%s_%s{{plan_id="%s"}} %s', "n", "k", "p", "v").alias("line"))
    status = tasks.groupBy("plan_id", "status").agg(F.count(F.lit(1)).alias("c")).select(
        F.format_string(f'{prefix}_tasks{{plan_id="%s",status="%s"}} %d', plan, "status", "c").alias("line"))
    ready = tasks.agg(F.count_if(F.col("status") == "READY").alias("c")).select(F.format_string(f"{prefix}_ready %d", "c").alias("line"))
    return lines.unionByName(status).unionByName(ready)


def write_prometheus(metrics: DataFrame, tasks: DataFrame, path: str, prefix: str = "orchestrator") -> None:
    prometheus_lines(metrics, tasks, prefix).write.mode("overwrite").text(path)


def write_evidence_set(sources: DataFrame, claims: DataFrame, reports: DataFrame, tuning: DataFrame, path: str) -> DataFrame:
    """Sources, claims, report and tuning texts by task; returns the claims that point nowhere."""
    for name, df in (("sources", sources), ("claims", claims), ("report", reports), ("tuning", tuning)):
        df.write.mode("overwrite").json(f"{path}/{name}")
    return E.traceability(claims, sources).filter("bad").drop("bad")


def plan_documents(tasks: DataFrame, plans: DataFrame) -> DataFrame:
    """One nested document per plan with all its tasks in seq order; a plan is the unit of the file and held by one row."""
    docs = tasks.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("seq", "task_id", "status", "priority"))).alias("tasks"))
    return plans.join(docs, "plan_id", "left")


def write_plans(tasks: DataFrame, plans: DataFrame, path: str) -> None:
    plan_documents(tasks, plans).write.mode("overwrite").json(path)
