"""Mentions and signals against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mentions as M
from tidemark.operators import signals as X

DOCS = [(1, "2024-01-01", "The RTX 5060-Ti beats the rtx 5060. RTX5060? 显卡七彩虹RTX 5060"), (2, "2024-01-01", "rtx rtx 5060 ti; 彩虹 and 七彩虹 七彩 虹"), (3, "2024-01-02", None), (4, "2024-01-02", "--- !!"),
        (5, "2024-01-02", "é École ÉCOLE ecole " + "rtx 5060 " * 500)]
NAMES = [(1, "RTX 5060"), (1, "rtx 5060 Ti"), (2, "rtx"), (3, "七彩虹"), (3, "七彩虹"), (4, "école"), (5, "..."), (None, "rtx"), (6, "missing")]


def fold(t):
    return " " + " ".join(re.findall(r"[一-鿿]|[^\W_一-鿿]+", (t or "").lower())) + " "


def brute():
    out = Counter()
    for d, _, t in DOCS:
        for e, n in {(e, fold(n)) for e, n in NAMES if e is not None and fold(n).strip()}:
            hits = len(re.findall(f"(?={re.escape(n)})", fold(t)))
            if hits:
                out[d, e] += hits
    return out


@pytest.mark.parametrize("limit", [M.LIMIT, 20, 60])
def test_mentions_whatever_the_parts(spark, limit):
    docs, names = spark.createDataFrame(DOCS, "doc_id long, obs_date string, text string"), spark.createDataFrame(NAMES, "entity_id long, name string")
    got = {(r.doc_id, r.entity_id): r.n_hits for r in M.find_names(docs, "text", names, ["doc_id"], limit).collect()}
    assert got == brute()
    days = {(r.entity_id, r.obs_date): (r.n_docs, r.n_hits) for r in M.mention_counts(docs, names, limit=limit).collect()}
    assert days[2, "2024-01-01"] == (2, sum(n for (d, e), n in got.items() if e == 2 and d < 3))
    assert M.find_names(docs, "text", names.limit(0), ["doc_id"], limit).count() == 0 == M.find_names(docs.limit(0), "text", names, ["doc_id"], limit).count()


@pytest.mark.parametrize("limit", [M.LIMIT, 60])
def test_entities_that_share_names_cost_no_rows_of_their_own(spark, monkeypatch, limit):
    found, search = [], M._find
    monkeypatch.setattr(M, "_find", lambda *a: found.append(search(*a)) or found[-1])
    names = NAMES + [(100 + i, n) for i in range(200) for n in ("rtx", "RTX 5060")] + [(400 + i, n) for i in range(50) for n in ("rtx", "彩虹")]
    docs = spark.createDataFrame([*DOCS, (6, None, "rtx"), (7, None, "彩虹"), (8, None, "彩虹 rtx rtx")], "doc_id long, obs_date string, text string")
    got = {(r.entity_id, r.obs_date): (r.n_docs, r.n_hits) for r in M.mention_counts(docs, spark.createDataFrame(names, "entity_id long, name string"), limit=limit).collect()}
    want: dict = {}
    for e in {e for e, _ in names} - {None}:
        for d in docs.collect():
            hits = sum(len(re.findall(f"(?={re.escape(n)})", fold(d.text))) for n in {fold(n) for x, n in names if x == e} if n.strip())
            if hits:
                n, h = want.get((e, d.obs_date), (0, 0))
                want[e, d.obs_date] = n + 1, h + hits
    assert got == want
    assert sum(f.count() for f in found) < 40


def test_brand_of_a_large_vocabulary(spark):
    words = spark.createDataFrame([(i, f"brand{i}") for i in range(3000)] + [(3000, "brand7 pro")], "entity_id long, name string")
    titles = spark.createDataFrame([(1, "new brand9 and brand7 pro"), (2, "brand30000"), (3, None)], "id long, title string")
    assert {m: [tuple(r) for r in M.brand_in(titles, "title", words, ["id"], m, 4000).collect()] for m in ("first", "longest")} == {"first": [(1, "brand7")], "longest": [(1, "brand7 pro")]}


def test_factors(spark):
    day = F.lit("2024-03-31").cast("date")
    rows = [(1, d) for d in ("2024-03-31", "2024-03-25", "2024-03-24", "2024-03-18", "2024-03-17")] + [(2, "2024-03-30"), (3, "2024-03-20"), (4, "2024-04-02")]
    ls = spark.createDataFrame(rows, "entity_id long, obs_date string").withColumn("obs_date", F.to_date("obs_date"))
    got = {r.entity_id: (r.n_now, r.n_before, r.listings_change) for r in X.listings_change(ls, day).collect()}
    assert got == {1: (2, 2, 0.0), 2: (1, 0, 100.0), 3: (0, 1, -100.0)}
    s = spark.createDataFrame([(e, f"2024-03-{i + 1:02d}", 100.0 + (i % 2) * (4.0 if i < 7 else 2.0) * e) for e in (1, 0) for i in range(14 if e else 13)], "entity_id long, obs_date string, price double")
    (r,) = X.volatility_convergence(s).collect()
    assert r.entity_id == 1 and 40 < r.vol_convergence < 60
    l0 = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, -1.0), (5, 1.0)], "entity_id long, slope_7_pct_per_day double")
    docs = ls.select("obs_date")
    ment = spark.createDataFrame([(2, "2024-03-30", 3), (5, "2024-03-29", 7), (5, "2024-02-01", 50)], "entity_id long, obs_date string, n_docs long").withColumn("obs_date", F.to_date("obs_date"))
    idx = {r.entity_id: (round(r.fomo_index, 6), r.action) for r in X.fomo_index(l0, ls, ment, docs, day).collect()}
    # slopes -1..1, changes -100..100, densities 0..7 of 7 documents
    assert idx == {1: (round(100 * (.5 + .5 + 0) / 3, 6), "none"), 2: (round(100 * (1 + 1 + 3 / 7) / 3, 6), "wait"), 3: (0.0, "none"), 5: (round(100 * (1 + .5 + 1) / 3, 6), "wait")}


def test_heat_is_turned_round(spark):
    day = F.lit("2024-03-31").cast("date")
    offers = spark.createDataFrame([(1, "2024-03-30", 10.0, None)] * 4 + [(1, "2024-03-30", 10.0, 8.0), (2, "2024-03-30", 10.0, 9.0), (2, "2024-03-30", 10.0, None)], "entity_id long, obs_date string, ask double, deal double")
    seen = spark.createDataFrame([(2, "2024-03-30")] * 3, "entity_id long, obs_date string")
    got = {r.entity_id: (r.supply_heat, r.action) for r in X.supply_heat(offers.withColumn("obs_date", F.to_date("obs_date")), seen.withColumn("obs_date", F.to_date("obs_date")), day).collect()}
    assert got[1] == (0.0, "probe_offer") and abs(got[2][0] - 100) < 1e-9 and got[2][1] == "wait"


def test_a_price_of_zero_does_not_stop_the_settling(spark):
    day = F.lit("2024-03-31").cast("date")
    obs = spark.createDataFrame([(e, d, p, low) for e, d, p, low in [
        (1, "2024-03-30", "a", 0.0), (1, "2024-03-30", "b", 5.0), (1, "2024-03-10", "a", 2.0), (1, "2024-03-10", "b", 3.0),       # from 0.5 to infinite
        (2, "2024-03-30", "a", 0.0), (2, "2024-03-30", "b", 0.0), (2, "2024-03-10", "a", 2.0), (2, "2024-03-10", "b", 3.0),       # 0 of 0
        (3, "2024-03-30", "a", 2.0), (3, "2024-03-30", "b", 3.0), (3, "2024-03-10", "a", 1.0), (3, "2024-03-10", "b", 2.0)]], "entity_id long, obs_date string, shop_platform string, low_price double")
    got = {r.entity_id: r.spread_convergence for r in X.spread_convergence(obs.withColumn("obs_date", F.to_date("obs_date")), day, 15).collect()}
    assert got[1] == float("-inf") and got[2] != got[2] and got[3] == 50.0
    days = spark.createDataFrame([(e, f"2024-03-{d:02d}", p) for e, p in ((1, 0.0), (2, 4.0)) for d in range(1, 15)], "entity_id long, obs_date string, price double")
    vol = {r.entity_id: r.vol_convergence for r in X.volatility_convergence(days.withColumn("obs_date", F.to_date("obs_date"))).collect()}
    assert vol[1] != vol[1] and vol[2] == 0.0
