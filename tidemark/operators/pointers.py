"""Pointers over edge frames: nodes as numbers, and pointer jumping, whose rounds follow the logarithm of the longest way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges as src, dst of type bigint, nodes as node, id): distinct edges, nodes numbered in their order, so that neighbours in name stay neighbours."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = cut_lineage(nodes.repartitionByRange("node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()))
    e = edges.distinct().join(nodes.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("t")), "dst")
    return cut_lineage(e.select(F.col("s").alias("src"), F.col("t").alias("dst"))), nodes


def jump(pointers: DataFrame, more: dict[str, object] | None = None, times: int = 2) -> DataFrame:
    """Every pointer (node, nxt) moved to where its target points, `times` over; nxt stays where the target has no row, and becomes null where the target's is.

    `more` names columns and how to combine a row's value with its target's: (own, target's) -> Column. `moved` says whether the last jump did anything.
    """
    more = more or {}
    for _ in range(times):
        far = pointers.select(F.col("node").alias("_at"), F.col("nxt").alias("_far"), *[F.col(c).alias(f"_{c}") for c in more])
        j = pointers.join(far, F.col("nxt") == F.col("_at"), "left")
        hit = F.col("_at").isNotNull()
        pointers = j.select("node", F.when(hit, F.col("_far")).otherwise(F.col("nxt")).alias("nxt"), *[F.when(hit, f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in more.items()],
                            *[c for c in pointers.columns if c not in ("node", "nxt", "moved", *more)], hit.alias("moved"))
    return pointers


def chase(pointers: DataFrame, more: dict[str, object] | None = None) -> DataFrame:
    """Pointers followed to their ends; those that run in circles are followed until every node of the circle has been passed."""
    now = cut_lineage(pointers)
    left = now.count()
    while left > 0:
        now = cut_lineage(jump(now, more))
        left = 0 if now.filter("moved").isEmpty() else left >> 2
    return now.drop("moved")
