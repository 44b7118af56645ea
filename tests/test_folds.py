"""Parallel scans and session cuts against the plain fold."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import folds as B
from tidemark.streaming.folds import HOUR_US, AlertFold, QuotaFold, RateFold


def plain(fold, rows):
    state, out = fold.start(), []
    for r in rows:
        state, o = fold.step(state, r)
        out.append(o)
    return out


@given(st.lists(st.integers(0, 500), min_size=1, max_size=80), st.integers(1, 60), st.integers(-80, 20))
@settings(max_examples=200, deadline=None)
def test_step_function(times, window, carried):
    ts = np.sort(np.array(times, dtype="int64"))
    carried = min(carried, int(ts[0]))
    upto, last = B._spaced_steps(ts, window)
    i = int(np.searchsorted(upto, carried + window, side="left"))
    got = int(last[i]) if i < len(upto) else carried
    held = carried
    for t in ts:
        if t - held >= window:
            held = int(t)
    assert got == held


def rows_for(seed, n, keys, span):
    rnd = random.Random(seed)
    hot = keys[0]
    return [(hot if rnd.random() < .6 else rnd.choice(keys), rnd.randrange(span), i) for i in range(n)]


@pytest.mark.parametrize("fold", [AlertFold(300_000_000, 20), AlertFold(60_000_000, 3)])
def test_alerts(spark, fold):
    data = rows_for(1, 1500, ["a", "b", "c"], 20 * HOUR_US)
    df = spark.createDataFrame(data, "kind string, ts_us long, pos long")
    got = {r.pos: (r.admitted, r.reason) for r in B.admit_alerts(df, ["kind"], fold, slice_us=HOUR_US).collect()}
    assert len(got) == len(data)
    for k in "abc":
        rows = sorted((t, p) for kk, t, p in data if kk == k)
        want = plain(fold, [{"ts_us": t} for t, _ in rows])
        assert [got[p] for _, p in rows] == want


def test_rate_limit(spark):
    data = rows_for(2, 1200, ["a", "b"], 30 * HOUR_US)
    df = spark.createDataFrame(data, "kind string, ts_us long, pos long")
    got = {r.pos: (r.accepted, r.reason) for r in B.rate_limit(df, ["kind"], RateFold(5)).collect()}
    for k in "ab":
        rows = sorted((t, p) for kk, t, p in data if kk == k)
        assert [got[p] for _, p in rows] == plain(RateFold(5), [{"ts_us": t} for t, _ in rows])


def test_daily_quota(spark):
    rnd = random.Random(3)
    data = [(rnd.randrange(3), i, rnd.randrange(1, 30)) for i in range(900)]
    df = spark.createDataFrame(data, "day int, pos long, n int")
    got = {r.pos: (r.taken, r.used) for r in B.daily_quota(df, fold=QuotaFold(500), chunk=(df.pos / 40).cast("long")).collect()}
    for day in range(3):
        rows = sorted((p, n) for d, p, n in data if d == day)
        assert [got[p] for p, _ in rows] == plain(QuotaFold(500), [{"day": day, "n": n} for _, n in rows])


@pytest.mark.parametrize("fold, slice_us", [(RateFold(5), 700_000_000), (RateFold(40), 300_000_000), (RateFold(1, 50_000_000), 300_000_000)])
def test_uninterrupted_key(spark, fold, slice_us):
    """A key that never pauses, cut into many slices that begin in the middle of things; null keys are keys too."""
    rnd = random.Random(7)
    data = [(None if i % 3 == 0 else "a", rnd.randrange(4 * HOUR_US), i) for i in range(4000)]
    df = spark.createDataFrame(data, "kind string, ts_us long, pos long")
    got = {r.pos: (r.accepted, r.reason) for r in B.rate_limit(df, ["kind"], fold, slice_us).collect()}
    assert len(got) == len(data)
    for k in (None, "a"):
        rows = sorted((t, p) for kk, t, p in data if kk == k)
        assert [got[p] for _, p in rows] == plain(fold, [{"ts_us": t} for t, _ in rows])


def test_million_rows_of_one_key(spark):
    """No pause for a million rows, but calmer stretches: more than eight tasks share the work, and the result is that of the fold."""
    n, fold = 1_000_000, RateFold(100, 60_000_000)
    at = "id div 2500 * 600000000 + if(id % 2500 < 2000, id % 2500 * 50000, id % 2500 * 1000000 - 1900000000)"
    df = spark.range(n).selectExpr("'k' AS kind", f"{at} AS ts_us", "id AS pos")
    out = B.rate_limit(df, ["kind"], fold).select("pos", "accepted").toArrow().sort_by("pos")
    i = np.arange(n)
    ts = (i // 2500 * 600_000_000 + np.where(i % 2500 < 2000, i % 2500 * 50_000, i % 2500 * 1_000_000 - 1_900_000_000)).tolist()
    held, want = fold.start(), []
    for t in ts:
        held, (ok, _) = fold.step(held, {"ts_us": t})
        want.append(ok)
    assert (out["accepted"].to_numpy() == np.array(want)).all()
    d = df.withColumn("_slice", B._slice(df, ["kind"], "ts_us", None))
    assert d.select("_slice").distinct().count() >= 16
