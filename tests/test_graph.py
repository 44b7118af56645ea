"""Cycles in graphs against strongly connected components in plain Python; deep graphs in few rounds."""

import random

import pytest

from tidemark.operators import graph as G
from tidemark.operators import pointers as P


def on_cycles(edges):
    """Nodes that reach themselves."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        if a in seen:
            found.add(a)
    return found


def graphs():
    rng = random.Random(9)
    for n, m in ((12, 10), (12, 14), (30, 40), (40, 44), (60, 62)):
        yield [(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}") for _ in range(m)]
    ring = [(i, (i + 1) % 40) for i in range(40)]
    yield [(f"a{x}", f"a{y}") for x, y in ring]                                                                # a ring and nothing else
    yield [(f"a{x}", f"a{y}") for x, y in ring] + [("a3", "a20"), ("a35", "q"), ("p", "a1"), ("q", "r")]        # with a chord and tails
    yield [(f"a{x}", f"a{y}") for x, y in ring] + [(f"b{x}", f"b{y}") for x, y in ring] + [("a3", "c"), ("c", "d"), ("d", "b3")]     # a chain between two rings
    yield [("x", "x"), ("x", "y"), ("y", "z")]


@pytest.mark.parametrize("part", [9, G.PART])
def test_cycles(spark, part):
    edges = [(f"{i}{a}", f"{i}{b}") for i, g in enumerate(graphs()) for a, b in g]
    got = [r.node for r in G.cycle_members(spark.createDataFrame(edges, "src string, dst string"), part).collect()]
    assert sorted(got) == sorted(on_cycles(edges))


@pytest.mark.parametrize("shuffled, part, limit", [(False, 1000, 40), (True, 1000, 60), (True, G.PART, 20)])
def test_deep_chain_in_few_frames(spark, monkeypatch, shuffled, part, limit):
    """12,000 tasks, each waiting for the one before, with a ring of three at the end: rounds don't follow the depth."""
    names = list(range(12_000))
    if shuffled:
        random.Random(1).shuffle(names)
    written, cut = [], G.cut_lineage
    for module in (G, P):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(1) or cut(df))
    edges = list(zip(names, names[1:])) + [(names[-1], 20_000), (20_000, 20_001), (20_001, names[-1])]
    got = {r.node for r in G.cycle_members(spark.createDataFrame(edges, "src long, dst long"), part).collect()}
    assert got == {names[-1], 20_000, 20_001} and len(written) < limit
