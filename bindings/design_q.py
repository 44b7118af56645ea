"""Further series metrics over orders, lineitem, part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import OBS, Registry, day, l0_sql, observations, table
from bindings.series_q import PLAIN, PRIO, plain_obs, priority_series
from tidemark.operators import design as G, series as S
from tidemark.sources.contracts import contract

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("wait_value", f"""WITH {PRIO}, w AS (SELECT *, min(price) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 90 FOLLOWING) low FROM ser)
  SELECT entity_id, round(avg((price - low) / price) * 100, 6) AS wait_value_pct, count(*) AS n_periods FROM w GROUP BY 1""")
def wait_value(spark, d):
    return G.wait_value(priority_series(spark, d)).withColumn("wait_value_pct", F.round("wait_value_pct", 6))


@R.add("anchor_check", f"""WITH {PRIO}, c AS (SELECT o_orderpriority AS entity_id, round(avg(o_totalprice) / 10, 0) AS list_price FROM orders GROUP BY 1)
  SELECT entity_id, count(*) AS n_periods, round(avg(CASE WHEN price >= list_price THEN 1 ELSE 0 END), 6) AS occurrence FROM ser JOIN c USING (entity_id) GROUP BY 1""")
def anchor_check(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity_id")).agg(F.round(F.avg("o_totalprice") / 10, 0).alias("list_price"))
    return G.anchor_check(priority_series(spark, d), c).withColumn("occurrence", F.round("occurrence", 6))


def line_obs(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 50).alias("entity_id"), F.to_date("l_shipdate").alias("obs_date"), (F.col("l_suppkey") % 5).alias("shop_platform"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("low_price"))


LINE = """lo AS (SELECT l_partkey % 50 AS entity_id, CAST(l_shipdate AS DATE) AS obs_date, l_suppkey % 5 AS shop_platform, floor(l_extendedprice / l_quantity) AS low_price FROM lineitem)"""


@R.add("sloth_tax", f"""WITH {LINE}, p AS (SELECT entity_id, obs_date, shop_platform, min(low_price) p FROM lo GROUP BY ALL)
  SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, count(*) AS n_platforms, round(max(p) - min(p), 2) AS spread FROM p GROUP BY entity_id, obs_date HAVING count(*) >= 2""")
def sloth_tax(spark, d):
    return G.sloth_tax(line_obs(spark, d)).select("entity_id", day("obs_date"), "n_platforms", F.round("spread", 2).alias("spread"))


LSER = f"{LINE}, ser AS (SELECT entity_id, obs_date, min(low_price) price FROM lo GROUP BY ALL)"


@R.add("offer_percentile", f"""WITH {LSER}, w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date DESC) rn, count(*) OVER (PARTITION BY entity_id) n FROM ser)
  SELECT entity_id, round(avg(CASE WHEN price <= 1500 + entity_id * 10 THEN 1 ELSE 0 END), 6) AS percentile, count(*) AS n_window FROM w WHERE rn <= 90 AND n >= 20 GROUP BY 1""")
def offer_percentile(spark, d):
    s = S.build_series(line_obs(spark, d))
    t = s.select("entity_id").distinct().withColumn("target", F.lit(1500) + F.col("entity_id") * 10)
    return G.offer_percentile(s, t).withColumn("percentile", F.round("percentile", 6))


@R.add("flagship_premium", """WITH l AS (SELECT p_partkey AS entity_id, p_retailprice AS price, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.2 WHEN 2 THEN 0.8 END AS perf_anchor, p_type, p_brand FROM part),
  b AS (SELECT p_type, p_brand, min(price) AS ap FROM l WHERE perf_anchor = 1.0 GROUP BY ALL)
  SELECT entity_id, round((price / ap - perf_anchor) / perf_anchor * 100, 4) AS premium_pct FROM l JOIN b USING (p_type, p_brand) WHERE perf_anchor > 0""")
def flagship_premium(spark, d):
    k = F.col("p_partkey")
    latest = table(spark, d, "part").select(k.alias("entity_id"), F.col("p_retailprice").alias("price"),
                                            F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 1.2).when(k % 4 == 2, 0.8).alias("perf_anchor"), "p_type", "p_brand")
    return G.flagship_premium(latest, ["p_type", "p_brand"]).select("entity_id", F.round("premium_pct", 4).alias("premium_pct"))


@R.add("distress_signal", f"""WITH {LSER}, g AS (SELECT entity_id % 5 AS area, *, lag(price) OVER (PARTITION BY entity_id ORDER BY obs_date) prev, count(*) OVER (PARTITION BY entity_id) n FROM ser),
  e AS (SELECT * FROM g WHERE n >= 30), m AS (SELECT area, obs_date, median(price) med FROM e GROUP BY ALL),
  r AS (SELECT e.*, med, (med - price) / med * 100 AS bp, (prev - price) / prev * 100 AS fp FROM e JOIN m USING (area, obs_date))
  SELECT area, entity_id, CAST(obs_date AS VARCHAR) AS obs_date, price, round(med, 4) AS peer_median, round(bp, 4) AS below_pct, round(fp, 4) AS fall_pct FROM r WHERE bp >= 10 AND fp >= 5""")
def distress_signal(spark, d):
    s = S.build_series(line_obs(spark, d)).withColumn("area", F.col("entity_id") % 5)
    out = G.distress_signal(s, ["area"])
    return out.select("area", "entity_id", day("obs_date"), "price", *[F.round(c, 4).alias(c) for c in ("peer_median", "below_pct", "fall_pct")])


@R.add("depreciation", """SELECT user_id AS entity_id, count(*) AS n, round(-regr_slope(value, CAST(json_extract_string(props, '$.k') AS INT)), 6) AS loss_per_month FROM events GROUP BY 1 HAVING count(*) >= 60""")
def depreciation(spark, d):
    o = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("value").alias("low_price"), F.get_json_object("props", "$.k").cast("int").alias("months_used"))
    return G.depreciation(o).withColumn("loss_per_month", F.round("loss_per_month", 6))


@R.add("promo_delta", """WITH e AS (SELECT user_id AS entity_id, value, event_type IN ('click', 'purchase') AS p FROM events)
  SELECT entity_id, count(*) AS n, round(avg(value) FILTER (p), 6) AS in_promo, round(avg(value) FILTER (NOT p), 6) AS out_promo,
    round(avg(value) FILTER (NOT p) - avg(value) FILTER (p), 6) AS delta FROM e GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (p) > 0 AND count(*) FILTER (NOT p) > 0""")
def promo_delta(spark, d):
    o = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("value").alias("low_price"),
                                         F.when(F.col("event_type") == "click", "国补").when(F.col("event_type") == "purchase", "618").when(F.col("event_type") == "view", "无").alias("promo_event"))
    out = G.promo_delta(o)
    return out.select("entity_id", "n", *[F.round(c, 6).alias(c) for c in ("in_promo", "out_promo", "delta")])


@R.add("composite_index", """WITH f AS (SELECT user_id, avg(value) a, CAST(count(*) AS DOUBLE) b, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) c FROM events GROUP BY 1),
  s AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) sa, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) sb, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) sc FROM f)
  SELECT user_id, round((sa + sb + sc) / 3 * 100, 4) AS fomo_index FROM s""")
def composite_index(spark, d):
    f = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("b"), F.count_if(F.col("event_type") == "click").cast("double").alias("c"))
    return G.composite_index(f, ["a", "b", "c"], "fomo_index").select("user_id", F.round("fomo_index", 4).alias("fomo_index"))


@R.add("arb_window", """SELECT c_custkey, round((c_acctbal + 2000 - s_acctbal - 3000) / (s_acctbal + 3000) * 100, 6) AS gap_pct, (c_acctbal + 2000 - s_acctbal - 3000) / (s_acctbal + 3000) * 100 > 13 AS open
  FROM customer JOIN supplier ON s_suppkey = c_custkey % 100""")
def arb_window(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    j = c.join(s, c.c_custkey % 100 == s.s_suppkey).select("c_custkey", (F.col("c_acctbal") + 2000).alias("home"), (F.col("s_acctbal") + 3000).alias("abroad"))
    return G.arb_window(j, 13.0).select("c_custkey", F.round("gap_pct", 6).alias("gap_pct"), "open")


@R.add("sufficiency_note", """SELECT o_custkey AS entity_id, count(*) AS n_periods, CASE WHEN count(*) >= 20 THEN 'OK(' || count(*) || ')' ELSE count(*) || '/20' END AS sufficiency FROM orders GROUP BY 1""")
def sufficiency_note(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("n_periods"))
    return G.sufficiency_note(c, "offer_percentile")


def _prefixed(sql: str, p: str) -> str:
    for n in ("ranked", "raw", "calc", "l0"):
        sql = sql.replace(f"{n} AS (", f"{p}_{n} AS (").replace(f"FROM {n}\n", f"FROM {p}_{n}\n").replace(f"FROM {n} ", f"FROM {p}_{n} ").replace(f"FROM {n})", f"FROM {p}_{n})")
    return sql


@R.add("significant_change", f"""WITH {PLAIN}, before AS (SELECT * FROM ser WHERE obs_date <= DATE '2024-01-24'), {l0_sql('ser', 'entity_id')}, {_prefixed(l0_sql('before', 'entity_id'), 'b')}
  SELECT n.entity_id, n.label, n.d1_pct, b.label AS label_before FROM l0 n LEFT JOIN b_l0 b USING (entity_id) WHERE b.label <> n.label OR abs(n.d1_pct) > 1""")
def significant_change(spark, d):
    o = plain_obs(spark, d)
    now = S.l0_metrics(S.build_series(o))
    before = S.l0_metrics(S.build_series(o, as_of=F.lit("2024-01-24").cast("date")))
    return G.significant_change(now, before).select("entity_id", "label", "d1_pct", "label_before")


@R.add("price_outliers", f"""WITH {LSER}, w AS (SELECT *, avg(price) OVER x m, count(*) OVER x c FROM ser WINDOW x AS (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, price, round(m, 4) AS mean_7 FROM w WHERE c = 7 AND abs(price - m) > m * 0.5""")
def price_outliers(spark, d):
    return G.price_outliers(S.build_series(line_obs(spark, d))).select("entity_id", day("obs_date"), "price", F.round("mean_7", 4).alias("mean_7"))


@R.add("adopt_proposals", """WITH a AS (SELECT o_custkey AS q, CASE o_orderkey % 3 WHEN 0 THEN 'merge_to' WHEN 1 THEN 'create_entity' ELSE 'hold' END AS act, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey END AS tgt, floor(o_totalprice / 25000) / 20 AS conf FROM orders),
  p AS (SELECT q, (act, tgt, conf) AS v FROM a QUALIFY row_number() OVER (PARTITION BY q ORDER BY conf DESC, act, tgt NULLS LAST) = 1),
  j AS (SELECT c_custkey, v[1] a, v[2] t, v[3] >= 0.8 AND (v[1] = 'create_entity' OR (v[1] = 'merge_to' AND v[2] IS NOT NULL)) AS ok FROM customer LEFT JOIN p ON q = c_custkey)
  SELECT c_custkey AS quarantine_id, CASE WHEN ok THEN a ELSE 'stays' END AS outcome, CASE WHEN ok THEN t END AS target_entity_id FROM j""")
def adopt_proposals(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("quarantine_id"), F.when(k % 3 == 0, "merge_to").when(k % 3 == 1, "create_entity").otherwise("hold").alias("action"),
                                         F.when(k % 6 == 0, k).alias("target_entity_id"), (F.floor(F.col("o_totalprice") / 25000) / 20).alias("confidence"))
    return G.adopt_proposals(table(spark, d, "customer").select(F.col("c_custkey").alias("quarantine_id")), p)


OWN_SQL, APPS_SQL = "['自采', 'manmanmai', 'gwdang']", "['自采', 'beike_app', 'xianyi_app']"


@R.add("route_metrics", f"""WITH {OBS}, m AS (SELECT source, CASE WHEN k % 3 = 0 THEN 'rr_pct' WHEN k % 3 = 1 THEN 'price' ELSE 'unit_price' END AS metric FROM obs),
  r(target, metrics, sources) AS (VALUES ('l0', ['price', 'unit_price', 'rr_pct'], {OWN_SQL}), ('stab_risk', ['price', 'unit_price'], {OWN_SQL}),
    ('wait_value', ['price', 'unit_price'], {OWN_SQL}), ('anchor_check', ['price'], ['自采']), ('sloth_tax', ['price'], ['自采']), ('promo_delta', ['price'], ['自采']),
    ('offer_percentile', ['unit_price'], {APPS_SQL}), ('distress_signal', ['unit_price'], {APPS_SQL}), ('stabilization', ['unit_price'], {APPS_SQL}),
    ('flagship_premium', ['price', 'unit_price'], {OWN_SQL}), ('depreciation', ['price', 'unit_price'], {OWN_SQL}),
    ('fomo_index', ['price', 'unit_price'], NULL), ('arb_window', ['price', 'unit_price'], NULL), ('supply_heat', ['price', 'unit_price'], NULL))
  SELECT target, count(*) AS n_rows, count(*) FILTER (target IN ('stab_risk', 'wait_value', 'flagship_premium', 'depreciation') AND source IN ('manmanmai', 'gwdang')) AS n_marked
  FROM m JOIN r ON list_contains(metrics, metric) AND (sources IS NULL OR list_contains(sources, source)) GROUP BY 1""")
def route_metrics(spark, d):
    return G.route_matrix(kinds_of_value(spark, d))


def kinds_of_value(spark, d):
    return observations(spark, d).withColumn("metric", F.when(F.col("k") % 3 == 0, "rr_pct").when(F.col("k") % 3 == 1, "price").otherwise("unit_price"))


@R.add("route_by_contract", f"""WITH {OBS}, m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'rr_pct' WHEN k % 3 = 1 THEN 'price' ELSE 'unit_price' END AS metric FROM obs)
  SELECT entity_id, count(*) AS n_rows, count(*) FILTER (source = 'gwdang') AS n_marked, min(low_price) AS low FROM m WHERE (metric = 'price' AND source IN ('gwdang', '自采')) OR (metric = 'rr_pct' AND source IN ('gwdang', '自采')) GROUP BY 1""")
def route_by_contract(spark, d):
    """A contract that narrows the sources of one kind of value and opens another one to a metric."""
    c = contract({"domain": "x", "identity": ["a"], "metrics": {"price": {"unit": "CNY", "allowed_sources": {"stab_risk": ["gwdang"], "l0": ["自采"]}}, "rr_pct": {"allowed_sources": {"stab_risk": ["自采"]}}}})
    r = G.route(kinds_of_value(spark, d), "stab_risk", c)
    return r.groupBy("entity_id").agg(F.count("*").alias("n_rows"), F.count("basis").alias("n_marked"), F.min("low_price").alias("low"))


@R.add("sufficiency_forecast", """WITH ser AS (SELECT DISTINCT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS d FROM orders),
  g AS (SELECT *, d - lag(d) OVER (PARTITION BY entity_id ORDER BY d) AS gap, row_number() OVER (PARTITION BY entity_id ORDER BY d DESC) AS rn FROM ser),
  p AS (SELECT c_custkey AS entity_id, c_custkey % 4 AS n_pending FROM customer WHERE c_custkey % 4 > 0),
  a AS (SELECT entity_id, count(*) AS n_periods, max(d) AS last, CAST(quantile_disc(gap, 0.5) FILTER (rn <= 30) AS INT) AS cadence_days FROM g GROUP BY 1),
  e AS (SELECT a.*, CASE WHEN n_periods < 20 THEN last + CAST(greatest(20 - n_periods - coalesce(n_pending, 0), 0) * cadence_days AS INT) END AS expected FROM a LEFT JOIN p USING (entity_id))
  SELECT entity_id, n_periods, 20 AS need, cadence_days, CAST(expected AS VARCHAR) AS expected,
    CASE WHEN n_periods >= 20 THEN 'OK(' || n_periods || ')' WHEN expected IS NULL THEN n_periods || '/20' ELSE n_periods || '/20, ' || CAST(expected AS VARCHAR) END AS sufficiency FROM e""")
def sufficiency_forecast(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("obs_date"))
    pending = table(spark, d, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 4).alias("n_pending"))
    return G.sufficiency_forecast(s, "offer_percentile", pending=pending).withColumn("expected", F.date_format("expected", "yyyy-MM-dd"))
