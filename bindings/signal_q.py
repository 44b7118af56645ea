"""Signals across domains: prices and listings from events, mentions from documents, offers from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, l0_sql, table
from bindings.series_q import PLAIN, plain_obs
from tidemark.operators import mentions as M, series as S, signals as X

R = Registry()
QUERIES, SQL = R.queries, R.sql

FOLD = r"regexp_replace(' ' || regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}])', ' \1 ', 'g') || ' ', '[^\p{L}\p{N}]+', ' ', 'g')"
# a user's names are the first three tokens of the document of the same number and, where it is long, the first one alone
DOCS_SQL = f"""docs AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS obs_date, {FOLD} AS t FROM documents),
  toks AS (SELECT doc_id, string_split(trim(t, ' '), ' ') AS w FROM docs WHERE t <> ' '),
  names AS (SELECT DISTINCT doc_id AS entity_id, ' ' || array_to_string(w[1:3], ' ') || ' ' AS name FROM toks UNION SELECT doc_id, ' ' || w[1] || ' ' FROM toks WHERE length(w[1]) >= 8)"""
MENTIONS_SQL = f"""{DOCS_SQL}, hit AS (SELECT entity_id, obs_date, doc_id, sum(len(string_split(replace(t, ' ', '  '), replace(name, ' ', '  ')[2:-2])) - 1) AS n FROM docs JOIN (SELECT * FROM names WHERE entity_id IN (SELECT user_id FROM events)) ON contains(t, name)
    GROUP BY ALL)"""


def dated_docs(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("obs_date"))


def user_names(spark, d):
    w = F.split(F.trim(M.folded(F.col("text"))), " ")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), w.alias("w")).filter("w[0] <> ''")
    t = t.join(table(spark, d, "events").select(F.col("user_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return t.select("entity_id", F.explode(F.array_compact(F.array(F.array_join(F.slice("w", 1, 3), " "), F.when(F.length(F.get("w", 0)) >= 8, F.get("w", 0))))).alias("name"))


@R.add("mention_counts", f"""WITH {MENTIONS_SQL} SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits FROM hit GROUP BY entity_id, obs_date""")
def mention_counts(spark, d):
    m = M.mention_counts(dated_docs(spark, d), user_names(spark, d))
    return m.select("entity_id", F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"), "n_docs", "n_hits")


def scaled(*factors: tuple[str, int]) -> str:
    """The composite of factors in SQL; -1 turns one round."""
    up = [f"CASE WHEN max({f}) OVER () = min({f}) OVER () THEN 0 ELSE ({f'{f} - min({f}) OVER ()' if s > 0 else f'max({f}) OVER () - {f}'}) / (max({f}) OVER () - min({f}) OVER ()) END" for f, s in factors]
    return f"round(({' + '.join(up)}) / 3 * 100, 4)"


AS_OF = "until AS (SELECT max(CAST(ts AS DATE)) AS d FROM events)"
CHANGE_SQL = """lst AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date FROM events WHERE event_type IN ('view', 'click')),
  chg AS (SELECT entity_id, CASE WHEN b > 0 THEN (n - b) / CAST(b AS DOUBLE) * 100 WHEN n > 0 THEN 100.0 ELSE 0.0 END AS listings_change FROM
    (SELECT entity_id, count(*) FILTER (obs_date > d - 7) AS n, count(*) FILTER (obs_date <= d - 7) AS b FROM lst, until WHERE obs_date > d - 14 GROUP BY 1))"""


def as_of(spark, d):
    return table(spark, d, "events").agg(F.max(F.to_date("ts"))).scalar()


def listings(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"))


@R.add("fomo_index", f"""WITH {PLAIN}, {l0_sql('ser', 'entity_id')}, {AS_OF}, {CHANGE_SQL}, {MENTIONS_SQL},
  den AS (SELECT entity_id, count(*) / CAST((SELECT count(*) FROM docs, until WHERE obs_date > d - 30 AND obs_date <= d) AS DOUBLE) * 100 AS mention_density FROM hit, until WHERE obs_date > d - 30 AND obs_date <= d GROUP BY 1),
  f AS (SELECT entity_id, slope_7_pct_per_day AS slope, coalesce(listings_change, 0) AS listings_change, coalesce(mention_density, 0) AS mention_density FROM l0 LEFT JOIN chg USING (entity_id) LEFT JOIN den USING (entity_id)),
  i AS (SELECT *, {scaled(('slope', 1), ('listings_change', 1), ('mention_density', 1))} AS fomo_index FROM f)
  SELECT entity_id, slope, round(listings_change, 6) AS listings_change, round(mention_density, 6) AS mention_density, fomo_index, CASE WHEN fomo_index > 70 THEN 'wait' ELSE 'none' END AS action FROM i""")
def fomo_index(spark, d):
    docs = dated_docs(spark, d)
    out = X.fomo_index(S.l0_metrics(S.build_series(plain_obs(spark, d))), listings(spark, d), M.mention_counts(docs, user_names(spark, d)), docs, as_of(spark, d))
    return out.select("entity_id", "slope", *[F.round(c, 6).alias(c) for c in ("listings_change", "mention_density")], F.round("fomo_index", 4).alias("fomo_index"), "action")


@R.add("stabilization", f"""WITH {PLAIN}, {AS_OF}, {CHANGE_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date DESC) rn FROM ser),
  v AS (SELECT entity_id, stddev_pop(price) FILTER (rn <= 7) / avg(price) FILTER (rn <= 7) AS now, stddev_pop(price) FILTER (rn > 7) / avg(price) FILTER (rn > 7) AS before FROM r WHERE rn <= 14 GROUP BY 1 HAVING count(*) = 14),
  lo AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, event_type AS p, min(value) AS low FROM events, until WHERE CAST(ts AS DATE) > d - 30 GROUP BY ALL),
  g AS (SELECT entity_id, obs_date, (max(low) - min(low)) / min(low) AS gap FROM lo GROUP BY ALL HAVING count(*) >= 2),
  s AS (SELECT entity_id, avg(gap) FILTER (obs_date > d - 15) AS now, avg(gap) FILTER (obs_date <= d - 15) AS before FROM g, until GROUP BY 1),
  f AS (SELECT v.entity_id, CASE WHEN v.before = 0 THEN 0 ELSE (v.before - v.now) / v.before * 100 END AS a, coalesce(CASE WHEN s.before = 0 THEN 0 ELSE (s.before - s.now) / s.before * 100 END, 0) AS b, abs(coalesce(listings_change, 0)) AS c
    FROM v LEFT JOIN s USING (entity_id) LEFT JOIN chg USING (entity_id))
  SELECT entity_id, round(a, 4) AS vol_convergence, round(b, 4) AS spread_convergence, round(c, 4) AS supply_gap, {scaled(('a', 1), ('b', 1), ('c', -1))} AS stabilization FROM f""")
def stabilization(spark, d):
    obs = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"), F.col("event_type").alias("shop_platform"), F.col("value").alias("low_price"))
    changes = X.listings_change(listings(spark, d), as_of(spark, d))
    factors = X.joined(X.volatility_convergence(S.build_series(plain_obs(spark, d))), X.spread_convergence(obs, as_of(spark, d), 15), changes.select("entity_id", F.abs("listings_change").alias("supply_gap")))
    out = X.signal(factors, X.STABLE, "stabilization", "act_now", "wait")
    return out.select("entity_id", *[F.round(c, 4).alias(c) for c in ("vol_convergence", "spread_convergence", "supply_gap", "stabilization")])


@R.add("supply_heat", f"""WITH until AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders),
  o AS (SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS obs_date, l_extendedprice AS ask, CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) END AS deal FROM lineitem),
  st AS (SELECT entity_id, count(*) FILTER (deal IS NULL) AS on_sale, avg((ask - deal) / ask * 100) AS room FROM o, until WHERE obs_date > d - 900 AND obs_date <= d GROUP BY 1),
  vw AS (SELECT l_suppkey AS entity_id, count(*) AS viewings FROM lineitem, until WHERE l_quantity >= 25 AND CAST(l_shipdate AS DATE) > d - 900 AND CAST(l_shipdate AS DATE) <= d GROUP BY 1),
  f AS (SELECT entity_id, CAST(on_sale AS DOUBLE) AS on_sale, CAST(coalesce(viewings, 0) AS DOUBLE) AS viewings, coalesce(room, 0.0) AS room FROM st LEFT JOIN vw USING (entity_id)),
  i AS (SELECT *, {scaled(('on_sale', -1), ('viewings', 1), ('room', -1))} AS supply_heat FROM f)
  SELECT entity_id, on_sale, viewings, round(room, 6) AS room, supply_heat, CASE WHEN supply_heat > 70 THEN 'wait' ELSE 'probe_offer' END AS action FROM i""")
def supply_heat(spark, d):
    li = table(spark, d, "lineitem")
    last = table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).scalar()
    offers = li.select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("obs_date"), F.col("l_extendedprice").alias("ask"), F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("deal"))
    viewings = li.filter("l_quantity >= 25").select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("obs_date"))      # large requests stand for viewings
    out = X.supply_heat(offers, viewings, last, 900)
    return out.select("entity_id", "on_sale", "viewings", F.round("room", 6).alias("room"), F.round("supply_heat", 4).alias("supply_heat"), "action")
