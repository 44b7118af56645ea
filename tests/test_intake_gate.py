"""Outliers at intake against a plain fold, and the routing of contracts."""

import datetime as dt
import random

import pytest

from tidemark.operators import design as G
from tidemark.operators import observations as O
from tidemark.sources.contracts import contract


def plain(stored, incoming):
    out = {}
    for who in {e for _, e, *_ in incoming}:
        days = sorted({d for _, e, d, p in incoming if e == who and d and p is not None} | {d for e, d, _ in stored if e == who})
        last = []
        for day in days:
            mean = sum(last) / 7 if len(last) == 7 else None
            fits = lambda p: mean is None or abs(p - mean) <= mean * 0.5  # noqa: E731, B023
            low = [p for e, d, p in stored if (e, d) == (who, day)]
            for i, e, d, p in incoming:
                if (e, d) == (who, day) and p is not None:
                    out[i] = not fits(p)
                    low += [p] if fits(p) else []
            last = (last + [min(low)])[-7:] if low else last
    return {i: out.get(i, False) for i, *_ in incoming}


def test_gate_is_the_fold(spark):
    rng = random.Random(2)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(60))
    price = lambda: rng.choice([100, 104, 97, 110, 60, 151, 30, 400]) * 1.0
    stored = list({(e, day()): 0 for e in (1, 1, 2, 2, 2) for _ in range(16)})
    stored = [(e, d, price() if rng.random() < .2 else 100.0) for e, d in stored]
    incoming = [(i, rng.choice([1, 2, 3, None]), day() if i % 40 else None, price() if i % 33 else None) for i in range(260)] + [(1000 + i, 1, dt.date(2024, 1, 20), 100.0) for i in range(5)]
    got = O.outlier_gate(spark.createDataFrame(incoming, "i long, entity_id long, obs_date date, low_price double"), spark.createDataFrame(stored, "entity_id long, obs_date date, price double")).collect()
    want = plain(stored, [x for x in incoming if x[1] is not None])
    assert {r.i: r.outlier for r in got} == {i: want.get(i, False) for i, *_ in incoming} and any(want.values())


def test_intake_keeps_outliers_out(spark):
    from tidemark import fixed
    from tidemark.plans import intake as P
    raw = spark.createDataFrame([(0, "100"), (1, "1000"), (2, "x")], "pos long, low_price string").selectExpr(
        "pos", "'2024-02-01' AS collected_on", "map('category', '显卡', 'series', 'a', 'spec', '8GB') AS identity_hint", "map('condition', '全新', 'channel', '国行单卡', 'source', '自采') AS attrs_hint",
        "low_price", "CAST(null AS string) AS raw_price", "'2024-01-20' AS price_date", "CAST(null AS string) AS metric", "named_struct('name', concat('s', pos), 'platform', '京东', 'url', 'u') AS shop",
        "CAST(array() AS array<struct<name:string,amount:double,threshold:double,expire:string>>) AS coupons", "true AS in_stock", "'s' AS source_url", "'A' AS source_tier")
    ents = spark.createDataFrame([(1, "显卡", "a", "8GB", [], True)], "entity_id long, category string, series string, spec string, aliases array<string>, active boolean")
    stored = spark.createDataFrame([(1, dt.date(2024, 1, 1 + i), 100.0 + i) for i in range(9)], "entity_id long, obs_date date, price double")
    rows, lost = P.intake(raw, fixed.HARDWARE_CONTRACT, ents, stored)
    assert [r.low_price for r in rows.collect()] == [100.0] and sorted(r.reason for r in lost.collect()) == ["bad_price:not_a_number", "price_outlier"]


def test_routes_from_a_contract():
    assert G.routes_of(contract({"domain": "d", "identity": ["x"], "metrics": ["price"]})) is G.ROUTES
    c = contract({"domain": "d", "identity": ["x"], "metrics": {"price": {"unit": "CNY", "sufficiency": {"L0": 5, "wait_value": 120}, "allowed_sources": {"l0": ["a"], "fomo_index": None}}, "rr_pct": {"allowed_sources": {"l0": ["b", "a"]}}, "unit_price": None},
                  "aggregate_scope": {"group_by": ["condition"], "default_filter": {"source": ["a", "b"], "condition": "new"}}, "report": {"change_threshold": {"abs_d1_pct": 2.0}}})
    r = G.routes_of(c)
    assert r["l0"] == (("price", "rr_pct", "unit_price"), ("a", "b", "自采", "manmanmai", "gwdang")) and r["fomo_index"] == (("price", "unit_price"), None) and "anchor_check" not in r
    assert c["unit"] == "CNY" and c["metrics"] == ("price", "rr_pct", "unit_price") and c["metric_rules"]["price"]["sufficiency"] == {"l0": 5, "wait_value": 120}
    assert c["aggregate_scope"] == {"group_by": ("condition",), "default_filter": {"source": ("a", "b"), "condition": "new"}} and c["change_threshold"] == {"abs_d1_pct": 2.0}
    with pytest.raises(ValueError, match="price"):
        contract({"domain": "d", "identity": ["x"], "metrics": {"price": 3}})
