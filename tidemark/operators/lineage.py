"""Inheritance between entities: who inherits from whom, without a table of all pairs.

Each entity of a forest gets a number and a lower bound, taken from the tour around its tree, such that those that inherit from it are exactly the numbers in between: one row per entity,
and the heirs of an entity are a range. The tour is ranked by pointer jumping, so the rounds follow the logarithm of the number of entities, not the depth. Where
an entity has several parents, or a circle has to be cut, one edge is in the forest and the others are extra; ranges that extra edges add are found by semi-naive
recursion over the extra edges alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import lag_in_key
from tidemark.operators.pointers import chase, numbered
from tidemark.session import Rounds, cut_lineage

CHUNK = 1_000_000


def forest_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, extra) of edges src -> dst (child to parent) without loops: one parent per child, no circles; the rest is extra."""
    parent = cut_lineage(edges.groupBy("src").agg(F.min("dst").alias("dst")))
    # after as many steps as there are nodes each pointer stands on a circle or has left the table
    ends = chase(parent.select(F.col("src").alias("node"), F.col("dst").alias("nxt"), F.col("src").alias("low")), {"low": F.least})
    on = ends.join(parent.select(F.col("src").alias("_p")), F.col("nxt") == F.col("_p"), "left_semi").select("nxt").distinct()
    broken = ends.filter("low = node").join(on.select(F.col("nxt").alias("node")), "node", "left_semi").select(F.col("node").alias("src"))
    forest = cut_lineage(parent.join(broken, "src", "left_anti"))
    return forest, cut_lineage(edges.join(forest, ["src", "dst"], "left_anti"))


def ranges(forest: DataFrame) -> DataFrame:
    """(id, tree, num, low): the heirs of an entity are those of its tree with low < number < num. forest: src, dst, one parent per child."""
    top = forest.select(F.col("dst").alias("c")).distinct().join(forest.select(F.col("src").alias("c")), "c", "left_anti").withColumn("p", F.lit(None).cast("bigint"))
    child = cut_lineage(forest.select(F.col("src").alias("c"), F.col("dst").alias("p")).unionByName(top))
    below = child.filter("p IS NOT NULL")
    first = below.groupBy(F.col("p").alias("c")).agg(F.min("c").alias("first"))
    after = lag_in_key(below, ["p"], ["c"], F.floor(F.col("c") / CHUNK), {"before": "c"}).filter("before IS NOT NULL").select(F.col("before").alias("c"), F.col("c").alias("sibling"))
    # the tour: down to a child is 2 * child, back up from it 2 * child + 1
    d = child.join(first, "c", "left").join(after, "c", "left")
    down = d.select((F.col("c") * 2).alias("node"), F.coalesce(F.col("first") * 2, F.col("c") * 2 + 1).alias("nxt"), F.lit(1).cast("bigint").alias("n"), (F.col("c") * 2).alias("last"))
    up = d.select((F.col("c") * 2 + 1).alias("node"), F.coalesce(F.col("sibling") * 2, F.col("p") * 2 + 1).alias("nxt"), F.lit(0).cast("bigint").alias("n"), (F.col("c") * 2 + 1).alias("last"))
    ranked = chase(down.unionByName(up), {"n": lambda own, far: own + far, "last": lambda own, far: far})
    of = ranked.withColumn("c", F.floor(F.col("node") / 2)).groupBy("c").agg(F.max("last").alias("tree"), F.max(F.when(F.col("node") % 2 == 0, F.col("n"))).alias("num"), F.max(F.when(F.col("node") % 2 == 1, F.col("n"))).alias("low"))
    return of.select(F.col("c").alias("id"), "tree", "num", "low")


def _heirs(owners: DataFrame, labels: DataFrame, itself: bool) -> DataFrame:
    """owners (owner, tree, num, low) with `heir`, every entity in the range."""
    top = F.col("num") if itself else F.col("num") - 1
    spread = owners.filter(top > F.col("low")).select("owner", "tree", F.explode(F.sequence(F.col("low") + 1, top)).alias("num"))
    return spread.join(labels.select("tree", "num", F.col("id").alias("heir")), ["tree", "num"]).select("owner", "heir")


def heirs(lineage: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(owner, heir): every entity that inherits from an owner, directly or not, once and never from itself. Streamed into whatever comes next, not written.

    lineage: entity_id, inherits_from. owners: the entities that matter (one column entity_id), all by default.
    """
    pairs = lineage.select(F.col("entity_id").alias("src"), F.col("inherits_from").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges, nodes = numbered(pairs)
    forest, extra = forest_of(edges)
    labels = cut_lineage(ranges(forest))
    lone = nodes.select("id").join(labels, "id", "left_anti").select("id", (-F.col("id") - 1).alias("tree"), F.lit(1).cast("bigint").alias("num"), F.lit(0).cast("bigint").alias("low"))
    labels = labels.unionByName(lone)
    wanted = nodes if owners is None else nodes.join(owners.select(F.col("entity_id").alias("node")).distinct(), "node", "left_semi")
    own = wanted.select(F.col("id").alias("owner")).join(labels, F.col("owner") == F.col("id")).select("owner", "tree", "num", "low")
    found = _heirs(own, labels, False)
    if not extra.isEmpty():
        labels = cut_lineage(labels)
        by = labels.withColumnRenamed("id", "owner")
        enter = extra.select(F.col("dst").alias("heir"), F.col("src").alias("then")).distinct()
        # what each extra edge leads to from there, and where the owners meet one
        along = cut_lineage(_heirs(by.join(extra.select(F.col("src").alias("owner")).distinct(), "owner", "left_semi"), labels, True).join(enter, "heir").select(F.col("owner").alias("child"), "then").distinct())
        rounds = Rounds(lineage.sparkSession)
        new = rounds.add(_heirs(own, labels, True).join(enter, "heir").select("owner", F.col("then").alias("child")).distinct())
        while not new.isEmpty():
            new = rounds.add(new.join(along, "child").select("owner", F.col("then").alias("child")).distinct().join(rounds.all(), ["owner", "child"], "left_anti"))
        more = rounds.all().join(labels.withColumnRenamed("id", "child"), "child").select("owner", "tree", "num", "low")
        found = found.unionByName(_heirs(more, labels, True)).filter("owner <> heir").distinct()
    named = found.join(nodes.select(F.col("id").alias("owner"), F.col("node").alias("_o")), "owner").join(nodes.select(F.col("id").alias("heir"), F.col("node").alias("_h")), "heir")
    return named.select(F.col("_o").alias("owner"), F.col("_h").alias("heir"))


def lineage_expand(obs: DataFrame, lineage: DataFrame) -> DataFrame:
    """Own observations plus those of every entity inherited from; `origin_id` keeps the owner."""
    own = obs.withColumn("origin_id", F.col("entity_id"))
    pairs = heirs(lineage, obs.select("entity_id"))
    inherited = obs.withColumnRenamed("entity_id", "origin_id").join(pairs.select(F.col("owner").alias("origin_id"), F.col("heir").alias("entity_id")), "origin_id")
    return own.unionByName(inherited)
