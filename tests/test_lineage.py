"""Inheritance by ranges against plain reachability: forests, several parents, circles, and a chain of 10,000."""

import random

from tidemark.operators import lineage as L
from tidemark.operators import pointers as P

PAIR = "entity_id long, inherits_from long"


def reach(edges):
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    out = set()
    for c in up:
        seen, todo = set(), [c]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out |= {(p, c) for p in seen if p != c}
    return out


def graphs():
    rng = random.Random(3)
    yield [(i, rng.randrange(i)) for i in range(1, 60)]                                              # one tree
    yield [(i, rng.randrange(i)) for i in range(1, 40)] + [(100 + i, 100 + rng.randrange(i)) for i in range(1, 9)] + [(5, 5), (7, None), (None, 3)]
    yield [(i, p) for i in range(1, 40) for p in {rng.randrange(i) for _ in range(1 + (i % 7 == 0))}]     # several parents
    yield [(i, rng.randrange(i)) for i in range(1, 20)] + [(0, 7), (30, 31), (31, 32), (32, 30), (33, 30), (34, 33)]    # circles
    yield [(rng.randrange(25), rng.randrange(25)) for _ in range(45)]                               # anything


def test_heirs(spark):
    shift = lambda i, x: None if x is None else 1000 * i + x
    edges = [(shift(i, a), shift(i, b)) for i, g in enumerate(graphs()) for a, b in g]
    got = [tuple(r) for r in L.heirs(spark.createDataFrame(edges, PAIR)).select("owner", "heir").collect()]
    assert sorted(got) == sorted(reach(edges))


def test_own_and_inherited(spark):
    obs = spark.createDataFrame([(1, 10.0), (2, 20.0), (9, 90.0), (9, 91.0)], "entity_id long, low_price double")
    out = L.lineage_expand(obs, spark.createDataFrame([(2, 1), (3, 2), (4, 2)], PAIR))
    assert sorted(map(tuple, out.select("entity_id", "origin_id", "low_price").collect())) == [(1, 1, 10.0), (2, 1, 10.0), (2, 2, 20.0), (3, 1, 10.0), (3, 2, 20.0), (4, 1, 10.0), (4, 2, 20.0), (9, 9, 90.0), (9, 9, 91.0)]
    assert L.lineage_expand(obs, spark.createDataFrame([], PAIR)).count() == 4


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 in shuffled names: the number of written frames follows the logarithm."""
    names = list(range(10_000))
    random.Random(4).shuffle(names)
    written, cut = [], L.cut_lineage
    for module in (L, P):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(1) or cut(df))
    lin = spark.createDataFrame(list(zip(names[1:], names)), PAIR)
    out = L.lineage_expand(spark.createDataFrame([(names[0], 1.0), (names[6000], 2.0)], "entity_id long, low_price double"), lin)
    assert out.count() == 10_000 + 4_000 and len(written) < 45
