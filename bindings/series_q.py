"""Series metrics over events (user = entity) and orders (priority = entity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import OBS, SELF, VENDORS, Registry, day, l0_sql, observations, table
from tidemark import fixed
from tidemark.operators import series as S

R = Registry()
QUERIES, SQL = R.queries, R.sql

L0_COLS = ("n_periods, last_price, CAST(last_date AS VARCHAR) AS last_date, d1_pct, slope_7_pct_per_day, vol_7_pct, "
           "avg_7, min_30, pct_from_30d_low, change_7_pct, label, sufficiency")


def plain_obs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"),
                    F.col("value").alias("low_price"))


PLAIN = ("ser AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, min(value) AS price FROM events "
         "GROUP BY ALL)")


@R.add("l0_metrics", f"WITH {PLAIN}, {l0_sql('ser', 'entity_id')} SELECT entity_id, {L0_COLS} FROM l0")
def l0_metrics(spark, d):
    m = S.l0_metrics(S.build_series(plain_obs(spark, d)))
    return m.select(*[day(c) if c == "last_date" else c for c in m.columns])


@R.add("trend_label", f"WITH {PLAIN}, {l0_sql('ser', 'entity_id')} "
       "SELECT label, count(*) AS n_entities FROM l0 GROUP BY label")
def trend_label(spark, d):
    return S.l0_metrics(S.build_series(plain_obs(spark, d))).groupBy("label").agg(F.count("*").alias("n_entities"))


@R.add("change_7", f"""WITH {PLAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date DESC) rn
  FROM ser) SELECT entity_id, round(CASE WHEN max_by(price, rn) = 0 THEN 0.0 ELSE (min_by(price, rn) - max_by(price, rn)) / max_by(price, rn) * 100 END, 4) AS change_7_pct
  FROM r WHERE rn <= 8 GROUP BY entity_id""")
def change_7(spark, d):
    c = S.change_7(S.build_series(plain_obs(spark, d)))
    return c.withColumn("change_7_pct", F.round("change_7_pct", 4))


@R.add("default_track", f"""WITH {OBS} SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, min(low_price) AS price
  FROM obs WHERE condition = '全新' AND source IN {SELF} AND obs_date <= DATE '2024-01-25' GROUP BY ALL""")
def default_track(spark, d):
    s = S.daily_series(observations(spark, d), F.lit("2024-01-25").cast("date"))
    return s.select("entity_id", day("obs_date"), "price")


@R.add("attr_series", f"""WITH {OBS} SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, min(low_price) AS price
  FROM obs WHERE source IN ('自采', 'smzdm') AND k = 7 GROUP BY ALL""")
def attr_series(spark, d):
    s = S.series_with_attrs(observations(spark, d), {"source": ["自采", "smzdm"], "k": 7})
    return s.select("entity_id", day("obs_date"), "price")


@R.add("vendor_tracks", f"""WITH {OBS}, own AS (SELECT DISTINCT entity_id, vendor FROM obs
    WHERE source = '自采' AND condition = '全新' AND vendor IS NOT NULL)
  SELECT entity_id, vendor, CAST(obs_date AS VARCHAR) AS obs_date, min(low_price) AS price FROM obs
  SEMI JOIN own USING (entity_id, vendor) WHERE source IN {SELF} AND condition = '全新' GROUP BY ALL""")
def vendor_tracks(spark, d):
    return S.tracks(observations(spark, d)).select("entity_id", "vendor", day("obs_date"), "price")


@R.add("floor_sales_lines", f"""WITH {OBS} SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date,
  min(low_price) AS floor_price, min(low_price) FILTER (anchor = '销量') AS sales_price
  FROM obs WHERE source = 'manmanmai' GROUP BY ALL""")
def floor_sales_lines(spark, d):
    return S.floor_and_sales_lines(observations(spark, d)).select("entity_id", day("obs_date"), "floor_price",
                                                                  "sales_price")


def priority_series(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("entity_id"), F.to_date("o_orderdate").alias("obs_date")).agg(
        F.min("o_totalprice").alias("price"))


PRIO = ("ser AS (SELECT o_orderpriority AS entity_id, CAST(o_orderdate AS DATE) AS obs_date, min(o_totalprice) AS price "
        "FROM orders GROUP BY ALL)")
DRAW = """dd AS (SELECT entity_id, obs_date, price, CASE WHEN price = 0 THEN 0.0 ELSE greatest(0.0, (price - low) / price) END AS drawdown FROM (
  SELECT *, min(price) OVER w low, count(*) OVER w lft FROM ser
  WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)) WHERE lft > 15)"""
RISK = """arr AS (SELECT entity_id, list_sort(list(drawdown)) a, median(drawdown) m FROM dd
    SEMI JOIN (SELECT entity_id FROM ser GROUP BY entity_id HAVING count(*) >= 60) USING (entity_id) GROUP BY entity_id),
  q AS (SELECT *, len(a) n, greatest(1, least((len(a) + 1) * 3 // 4, len(a) - 1)) j FROM arr),
  risk AS (SELECT entity_id, round(m * 100, 2) AS median_pct,
    round(CASE WHEN n < 4 THEN a[n] ELSE (a[j] * (4 - ((n + 1) * 3 - j * 4)) + a[j + 1] * ((n + 1) * 3 - j * 4)) / 4 END
      * 100, 2) AS p75_pct, round(a[n] * 100, 2) AS max_pct, n AS samples FROM q)"""


@R.add("forward_drawdown", f"WITH {PRIO}, {DRAW} SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, price, "
       "round(drawdown, 6) AS drawdown FROM dd")
def forward_drawdown(spark, d):
    dd = S.forward_drawdown(priority_series(spark, d))
    return dd.select("entity_id", day("obs_date"), "price", F.round("drawdown", 6).alias("drawdown"))


@R.add("stab_risk", f"WITH {PRIO}, {DRAW}, {RISK} SELECT * FROM risk")
def stab_risk(spark, d):
    return S.stab_risk(priority_series(spark, d))


@R.add("risk_action", f"""WITH {PRIO}, {DRAW}, {RISK}, {l0_sql('ser', 'entity_id')}
  SELECT entity_id, median_pct, slope_7_pct_per_day,
    CASE WHEN median_pct > 10 AND slope_7_pct_per_day < -0.2 THEN 'wait' ELSE 'act_now' END AS stab_action,
    CASE WHEN median_pct > 10 AND slope_7_pct_per_day <= -0.2 THEN 'wait' ELSE 'act_now' END AS stab_action_inclusive
  FROM risk JOIN l0 USING (entity_id)""")
def risk_action(spark, d):
    ser = priority_series(spark, d)
    both = S.stab_risk(ser).join(S.l0_metrics(ser), "entity_id")
    m, s = F.col("median_pct"), F.col("slope_7_pct_per_day")
    return both.select("entity_id", "median_pct", "slope_7_pct_per_day", S.risk_action(m, s).alias("stab_action"),
                       S.risk_action(m, s, inclusive=True).alias("stab_action_inclusive"))


@R.add("contrast", f"""WITH {OBS}, ser AS (SELECT entity_id, vendor, obs_date, min(low_price) AS price FROM obs
    WHERE condition = '全新' AND vendor IS NOT NULL GROUP BY ALL), {l0_sql('ser', 'entity_id, vendor')}
  SELECT entity_id, vendor, last_price, slope_7_pct_per_day, vol_7_pct, label,
    round(CASE WHEN min(last_price) OVER w = 0 THEN 0.0 ELSE (max(last_price) OVER w - min(last_price) OVER w)
      / min(last_price) OVER w * 100 END, 2) AS spread_pct
  FROM l0 WINDOW w AS (PARTITION BY entity_id)""")
def contrast(spark, d):
    return S.contrast(observations(spark, d), "vendor", VENDORS, {"condition": fixed.NEW_CONDITION})
