"""Dependency graphs as edge frames. Loops run on frontier frames; only a one-row count leaves Spark.

Each round's frame is cut through the shared checkpoint folder every few rounds, so plans stay short
and a lost executor replays at most that many rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.pointers import chase, numbered
from tidemark.session import Rounds, cut_lineage

#: Edges that one task peels at once; rounds whose results are folded into one frame.
PART = 200_000
FOLD = 8


def first_root(edges: DataFrame, roots: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(node, root): every node reached along src -> dst, with the smallest root that reaches it; nodes outside `allowed` stop the walk and are left out.

    roots: one column `node` (each its own root, and kept as such). A round takes only the nodes whose root has just become smaller.
    """
    edges = edges.select("src", "dst").distinct()
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    edges = cut_lineage(edges)
    frontier = cut_lineage(roots.select("node", F.col("node").alias("root")).distinct())
    known, since = frontier, 0
    while not frontier.isEmpty():
        pushed = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("root"))
        had = known.groupBy("node").agg(F.min("root").alias("_had"))
        frontier = cut_lineage(pushed.join(had, "node", "left").filter("_had IS NULL OR root < _had").select("node", "root"))
        known, since = known.unionByName(frontier), since + 1
        if since == FOLD:                               # what is known is one row per node again
            known, since = cut_lineage(known.groupBy("node").agg(F.min("root").alias("root"))), 0
    return known.groupBy("node").agg(F.min("root").alias("root"))


def mark_reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reached from any seed along src -> dst, seeds included (one row per node)."""
    edges = cut_lineage(edges.select("src", "dst").distinct())
    rounds = Rounds(edges.sparkSession)
    frontier = rounds.add(seeds.select("node").distinct())
    while True:
        nxt = (edges.join(frontier, edges["src"] == frontier["node"], "left_semi")
               .select(F.col("dst").alias("node")).distinct().join(rounds.all(), "node", "left_anti"))
        frontier = rounds.add(nxt)
        if frontier.isEmpty():
            return rounds.all()


def _alive(tail: np.ndarray, head: np.ndarray, alone: bool) -> np.ndarray:
    """Which edges are left after dropping, again and again, those whose tail has no edge into it. All edges into a node are known to be here if it lies
    strictly between the least and the largest head, or if there is no other task."""
    nodes, at = np.unique(np.concatenate([tail, head]), return_inverse=True)
    t, h = at[:len(tail)], at[len(tail):]
    whole = (nodes > head.min()) & (nodes < head.max()) | alone
    incoming = np.bincount(h, minlength=len(nodes))
    order = np.argsort(t, kind="stable")
    start = np.searchsorted(t[order], np.arange(len(nodes) + 1))
    left = np.ones(len(tail), bool)
    todo = np.flatnonzero(whole & (incoming == 0)).tolist()
    while todo:
        u = todo.pop()
        out = order[start[u]:start[u + 1]]
        left[out] = False
        for v in h[out].tolist():
            incoming[v] -= 1
            if not incoming[v] and whole[v]:
                todo.append(v)
    return left


def _peel(edges: DataFrame, head: str, parts: int) -> DataFrame:
    """Edges that are left when every task peels its range of nodes as deep as it can see."""
    tail = "src" if head == "dst" else "dst"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if t:
            t = pa.Table.from_batches(t)
            keep = _alive(t[tail].to_numpy(), t[head].to_numpy(), parts == 1)
            yield from t.filter(pa.array(keep)).to_batches()
    dealt = edges.repartition(1) if parts == 1 else edges.repartitionByRange(parts, head, tail)
    return dealt.select("src", "dst").mapInArrow(run, "src bigint, dst bigint")


def trim_leaves(edges: DataFrame, part: int = PART, until: float = 1.0) -> tuple[DataFrame, int]:
    """(edges, their number) left after repeatedly dropping nodes that lack an incoming or an outgoing edge; nodes are numbers. Stops early once a round leaves more than `until` of its edges.

    Before each exchange a task peels whole stretches of its own. Every node that remains lies on a cycle or between two cycles; an acyclic graph leaves nothing.
    """
    cur = cut_lineage(edges.select("src", "dst").distinct())
    size = cur.count()
    while size:
        parts = -(-size // part)
        nxt = _peel(_peel(cur, "dst", parts), "src", parts)
        if parts > 1:
            nxt = nxt.join(cur.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(cur.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        nxt = cut_lineage(nxt)
        left = nxt.count()
        if parts == 1 or left >= until * size:
            return nxt, left
        cur, size = nxt, left
    return cur, size


def contract_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains of nodes with one way in and one way out become single edges: (edges, chain nodes as node, a, b, nodes of rings made of such nodes alone as node, comp).

    A chain node lies on a cycle just if its ends a and b lie on one together. None if there is no such node.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("prv")).filter("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("nxt")).filter("n = 1").drop("n")
    mid = cut_lineage(into.join(out, "node").filter("prv <> node"))
    if mid.isEmpty():
        return None
    b = chase(mid.select("node", "nxt", F.col("node").alias("comp")), {"comp": F.least})      # on a ring the least node passed is the same for all
    a = chase(mid.select("node", F.col("prv").alias("nxt")))
    inner = mid.select("node")
    ends = a.select("node", F.col("nxt").alias("a")).join(b.select("node", F.col("nxt").alias("b"), "comp"), "node")
    rings = cut_lineage(ends.join(inner.withColumnRenamed("node", "b"), "b", "left_semi").select("node", "comp"))
    chains = cut_lineage(ends.drop("comp").join(rings, "node", "left_anti"))
    rest = edges.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return rest.unionByName(chains.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct(), chains, rings


def cycle_members(edges: DataFrame, part: int = PART) -> DataFrame:
    """Nodes that lie on a cycle, one row each (column node).

    Leaves are trimmed and chains contracted in turns, so a long way costs rounds by its logarithm. What is left is coloured: each node takes the largest number that reaches
    it; a node whose own number is its colour roots a component, made of the nodes of that colour that reach back to it. Such components are cut out
    and the rest is coloured again. At the end chain nodes join the component of their ends. One row per node throughout, never a pair table.
    """
    rest, nodes = numbered(edges.select("src", "dst"))
    chains, rings = [], []
    while True:
        rest, size = trim_leaves(rest, part, 0.9)
        got = contract_chains(rest) if size else None
        if got is None:
            break
        rest = got[0]
        chains.append(got[1])
        rings.append(got[2])
    found = _components(trim_leaves(rest, part)[0], part)
    for r in rings:
        found = found.unionByName(r)
    for c in reversed(chains):
        on = lambda end: found.select(F.col("node").alias(end), F.col("comp").alias(f"of_{end}"))  # noqa: E731, B023
        found = cut_lineage(found.unionByName(c.join(on("a"), "a").join(on("b"), "b").filter("of_a = of_b").select("node", F.col("of_a").alias("comp"))))
    return found.select("node").distinct().join(nodes.select(F.col("id"), F.col("node").alias("name")), F.col("node") == F.col("id")).select(F.col("name").alias("node"))


def _components(rest: DataFrame, part: int) -> DataFrame:
    """(node, comp): nodes on cycles with the root of their component."""
    found = rest.select(F.col("src").alias("node"), F.col("src").alias("comp")).limit(0)
    while not rest.isEmpty():
        colour = _max_colour(rest)
        same = (rest.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src")
                .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
                .filter("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        same = cut_lineage(same)
        roots = colour.filter("node = colour").select("node")
        back = mark_reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        # a root without a self path forms no cycle: it needs an edge from inside its own component
        loops = same.join(back.select(F.col("node").alias("src")), "src", "left_semi").select("colour").distinct()
        found = found.unionByName(back.join(colour, "node").join(loops, "colour", "left_semi").select("node", F.col("colour").alias("comp")))
        rest = trim_leaves(rest.join(back.select(F.col("node").alias("src")), "src", "left_anti")
                           .join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), part)[0]
    return found


def _max_colour(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    colour = cut_lineage(nodes.select("node", F.col("node").alias("colour")))
    while True:
        pushed = (edges.join(colour, edges["src"] == colour["node"])
                  .groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_in")))
        nxt = cut_lineage(colour.join(pushed, "node", "left").select(
            "node", F.greatest("colour", "_in").alias("colour"),
            (F.coalesce("_in", "colour") > F.col("colour")).alias("_moved")))
        if nxt.filter("_moved").isEmpty():
            return nxt.drop("_moved")
        colour = nxt.drop("_moved")


def dependency_edges(tasks: DataFrame) -> DataFrame:
    """One row per declared dependency: plan_id, task_id, dep."""
    return tasks.select("plan_id", "task_id", F.explode("depends_on").alias("dep"))


def unsatisfied_deps(tasks: DataFrame, strict: bool = False) -> DataFrame:
    """Dependencies that are not finished; `MISSING` when the named task does not exist."""
    done = ("DONE",) if strict else fixed.SATISFIED
    status = tasks.select("plan_id", F.col("task_id").alias("dep"), F.col("status").alias("dep_status"))
    return (dependency_edges(tasks).join(status, ["plan_id", "dep"], "left")
            .withColumn("dep_status", F.coalesce("dep_status", F.lit("MISSING")))
            .filter(~F.col("dep_status").isin(*done)))


def ready_tasks(tasks: DataFrame, strict: bool = False) -> DataFrame:
    waiting = tasks.filter(F.col("status").isin("PENDING", "BLOCKED"))
    return waiting.join(unsatisfied_deps(tasks, strict), ["plan_id", "task_id"], "left_anti")


def dependents(tasks: DataFrame) -> DataFrame:
    """Reverse edges: how many tasks name `dep`, and which one comes first and last."""
    return dependency_edges(tasks).groupBy("plan_id", "dep").agg(
        F.count(F.lit(1)).alias("n_dependents"), F.min("task_id").alias("first_dependent"),
        F.max("task_id").alias("last_dependent"))


def _node(plan: str, task: str):
    return F.struct(F.col(plan).alias("plan_id"), F.col(task).alias("task_id"))


def cancel_closure(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """Not-started tasks downstream of the cancelled roots, one row each with the first root that reaches it; started tasks stop the walk."""
    e = dependency_edges(tasks).select(_node("plan_id", "dep").alias("src"), _node("plan_id", "task_id").alias("dst"))
    ok = tasks.filter(F.col("status").isin(*fixed.NOT_STARTED)).select(_node("plan_id", "task_id").alias("node"))
    r = roots.select(_node("plan_id", "task_id").alias("node"))
    walk = first_root(e, r, ok).join(r, "node", "left_anti")
    return walk.select(F.col("node.plan_id").alias("plan_id"), F.col("node.task_id").alias("task_id"),
                       F.col("root.task_id").alias("cascaded_from"))


def dag_problems(tasks: DataFrame) -> DataFrame:
    """Self dependencies, missing dependencies, and members of longer cycles."""
    e = dependency_edges(tasks)
    known = tasks.select("plan_id", F.col("task_id").alias("dep"))
    selfdep = e.filter("task_id = dep").select("plan_id", "task_id", F.lit("self_dependency").alias("problem"), "dep")
    missing = e.filter("task_id <> dep").join(known, ["plan_id", "dep"], "left_anti").select(
        "plan_id", "task_id", F.lit("missing_dependency").alias("problem"), "dep")
    inner = e.filter("task_id <> dep").join(known, ["plan_id", "dep"], "left_semi").select(
        _node("plan_id", "task_id").alias("src"), _node("plan_id", "dep").alias("dst"))
    cyc = cycle_members(inner).select(F.col("node.plan_id").alias("plan_id"), F.col("node.task_id").alias("task_id"),
                                      F.lit("cycle").alias("problem"), F.lit(None).cast("string").alias("dep"))
    return selfdep.unionByName(missing).unionByName(cyc.select("plan_id", "task_id", "problem", F.col("dep").cast(
        selfdep.schema["dep"].dataType)))


def stuck_on_dead(tasks: DataFrame) -> DataFrame:
    """Per plan: at least one dead letter, something waiting, nothing moving, and every waiting task behind a dead one."""
    e = dependency_edges(tasks).select(_node("plan_id", "dep").alias("src"), _node("plan_id", "task_id").alias("dst"))
    dead = tasks.filter("status = 'DEAD_LETTER'").select(_node("plan_id", "task_id").alias("node"))
    behind = mark_reach(e, dead).select(F.col("node.plan_id").alias("plan_id"), F.col("node.task_id").alias("task_id"),
                                        F.lit(True).alias("behind"))
    t = tasks.join(behind, ["plan_id", "task_id"], "left")
    waiting = F.col("status").isin(*fixed.WAITING)
    moving = F.col("status").isin(*fixed.IN_FLIGHT)
    return t.groupBy("plan_id").agg(
        F.count_if(F.col("status") == "DEAD_LETTER").alias("n_dead"), F.count_if(waiting).alias("n_waiting"),
        F.count_if(waiting & moving).alias("n_moving"),
        F.count_if(waiting & F.col("behind").isNull()).alias("n_free")).select(
        "plan_id", "n_dead", "n_waiting",
        ((F.col("n_dead") > 0) & (F.col("n_waiting") > 0) & (F.col("n_moving") == 0) & (F.col("n_free") == 0)).alias("stuck"))
