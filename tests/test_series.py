import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series as S


def make(spark, prices, entity=1):
    day = dt.date(2024, 1, 1)
    rows = [(entity, day + dt.timedelta(days=i), float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "entity_id long, obs_date date, price double")


def one(df):
    rows = df.collect()
    return rows[0] if rows else None


def test_three_points_give_nothing(spark):
    assert one(S.l0_metrics(make(spark, [3, 2, 1]))) is None


def test_falling_week(spark):
    m = one(S.l0_metrics(make(spark, [3000 - 50 * d for d in range(7)])))
    assert m.d1_pct < 0 and m.slope_7_pct_per_day < 0
    assert m.min_30 == m.last_price and m.pct_from_30d_low == 0 and m.sufficiency == "OK(7)"


def test_slope_and_volatility_against_plain_python(spark):
    prices = [100, 103, 99, 104, 110, 95, 97, 101, 108]
    m = one(S.l0_metrics(make(spark, prices)))
    last = prices[-7:]
    xs = range(7)
    mx, my = 3, sum(last) / 7
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, last)) / sum((x - mx) ** 2 for x in xs) / my * 100
    assert m.slope_7_pct_per_day == pytest.approx(slope, abs=1e-3)
    assert m.vol_7_pct == pytest.approx(statistics.pstdev(last) / my * 100, abs=1e-2)


@pytest.mark.parametrize("slope,vol,want", [(-2, 1, "fast_drop"), (-.5, 1, "drop"), (0, 1, "stable"), (.1, 5, "rise"),
                                            (.5, 1, "rise"), (2, 1, "fast_rise"), (-.2, 1, "rise")])
def test_labels(spark, slope, vol, want):
    assert spark.range(1).select(S.trend_label(F.lit(float(slope)), F.lit(float(vol))).alias("l")).first().l == want


def test_risk_needs_sixty_points(spark):
    assert one(S.stab_risk(make(spark, [10] * 59))) is None
    assert one(S.stab_risk(make(spark, [10] * 60))).samples >= 1


def test_risk_of_a_long_fall(spark):
    prices = [3000 - 15 * i for i in range(90)]
    r = one(S.stab_risk(make(spark, prices)))
    dd = []
    for i in range(len(prices)):
        w = prices[i:i + 31]
        if len(w) <= 15:
            break
        dd.append(max(0.0, (prices[i] - min(w)) / prices[i]))
    assert r.samples == len(dd) and r.median_pct >= 10
    assert r.median_pct == pytest.approx(statistics.median(dd) * 100, abs=0.006)
    assert r.p75_pct == pytest.approx(statistics.quantiles(dd, n=4)[2] * 100, abs=0.006)


def test_forty_constants(spark):
    assert one(S.stab_risk(make(spark, [5] * 40), min_history=30)).samples == 25


def test_action(spark):
    got = spark.range(1).select(S.risk_action(F.lit(12.0), F.lit(-.5)).alias("a"), S.risk_action(F.lit(12.0), F.lit(0.0)).alias("b"),
                                S.risk_action(F.lit(12.0), F.lit(-.2)).alias("c"), S.risk_action(F.lit(12.0), F.lit(-.2), True).alias("d")).first()
    assert tuple(got) == ("wait", "act_now", "act_now", "wait")


def test_contrast_spread(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day + dt.timedelta(days=i), v, p, "全新", "自采") for i in range(6) for v, p in (("微星", 2900.0), ("华硕", 3050.0))]
    rows.append((1, day, "微星", 1.0, "二手", "自采"))
    obs = spark.createDataFrame(rows, "entity_id long, obs_date date, vendor string, low_price double, condition string, source string")
    got = S.contrast(obs, "vendor", ["微星", "华硕", "索泰"], {"condition": "全新", "source": "自采"}).collect()
    assert len(got) == 2 and 4.9 < got[0].spread_pct < 5.3
