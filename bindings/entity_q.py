"""Entities: resolution, seeding, overview, anchors, lineage, snapshot and board."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import OBS, SELF, VENDORS, Registry, day, l0_sql, observations, table
from tidemark.operators import entities as E, lineage as L, registry as G, series as S
from tidemark.plans import snapshot as P

R = Registry()
QUERIES, SQL = R.queries, R.sql


def part_entities(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("category"), F.col("p_name").alias("series"),
        F.concat(F.col("p_size").cast("string"), F.lit("GB")).alias("spec"),
        F.when(F.col("p_partkey") % 10 == 0, F.array(F.concat_ws(" ", "p_name", "p_brand"), F.lower("p_brand")))
        .otherwise(F.array().cast("array<string>")).alias("aliases"),
        (F.col("p_partkey") % 7 != 0).alias("active"), F.col("p_name").alias("display_name"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_retailprice")).alias("perf_anchor"), F.col("p_brand").alias("brand"))


HINT = """hint AS (SELECT l_orderkey, l_linenumber, p_type AS category, CASE l_linenumber % 4 WHEN 0 THEN p_name
    WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN p_name || ' ' || p_brand ELSE lower(p_brand) END AS series,
    CASE l_linenumber % 3 WHEN 0 THEN '' ELSE p_size || 'GB' END AS spec
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@R.add("resolve_entities", f"""WITH {HINT}, ent AS (SELECT p_partkey id, p_type category, p_name series, p_size || 'GB' spec, p_brand
    FROM part WHERE p_partkey % 7 <> 0),
  exact AS (SELECT category, series, spec, min(id) e FROM ent GROUP BY ALL),
  alias AS (SELECT k, min(id) a FROM (SELECT id, unnest([series || ' ' || p_brand, lower(p_brand)]) k FROM ent WHERE id % 10 = 0) GROUP BY k),
  ser AS (SELECT replace(series, ' ', '') sk, count(*) n, min(id) s FROM ent GROUP BY 1),
  sp AS (SELECT replace(series, ' ', '') sk, spec, count(*) n, min(id) s FROM ent GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, coalesce(least(e, a1.a, a2.a), CASE WHEN ser.n = 1 THEN ser.s END,
    CASE WHEN h.spec <> '' AND sp.n = 1 THEN sp.s END) AS entity_id
  FROM hint h LEFT JOIN exact USING (category, series, spec) LEFT JOIN alias a1 ON a1.k = h.series
  LEFT JOIN alias a2 ON a2.k = trim(h.series || ' ' || h.spec) LEFT JOIN ser ON ser.sk = replace(h.series, ' ', '')
  LEFT JOIN sp ON sp.sk = replace(h.series, ' ', '') AND sp.spec = h.spec""")
def resolve_entities(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, d, "part")
    m = F.col("l_linenumber")
    h = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", F.col("p_type").alias("category"),
        F.when(m % 4 == 0, F.col("p_name")).when(m % 4 == 1, F.replace("p_name", F.lit(" "), F.lit("")))
        .when(m % 4 == 2, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.lower("p_brand")).alias("series"),
        F.when(m % 3 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("g（x）"))).alias("spec"))
    return E.resolve_entities(h, part_entities(spark, d)).select("l_orderkey", "l_linenumber", "entity_id")


@R.add("seed_entities", """WITH base AS (SELECT min(p_partkey) entity_id, p_type category, p_name series, p_brand spec FROM part
    WHERE p_partkey % 3 = 0 GROUP BY ALL), seed AS (SELECT p_type category, p_name series, p_brand spec, min(p_partkey) pos FROM part
    GROUP BY ALL), fresh AS (SELECT * FROM seed ANTI JOIN base USING (category, series, spec))
  SELECT entity_id, 'hardware' AS domain, category, series, spec FROM base UNION ALL
  SELECT (SELECT max(entity_id) FROM base) + row_number() OVER (ORDER BY pos), 'hardware', category, series, spec FROM fresh""")
def seed_entities(spark, d):
    rows = table(spark, d, "part").select(F.lit("hardware").alias("domain"), F.col("p_type").alias("category"),
                                          F.col("p_name").alias("series"), F.col("p_brand").alias("spec"), "p_partkey")
    base = (rows.filter("p_partkey % 3 = 0").groupBy("domain", "category", "series", "spec")
            .agg(F.min("p_partkey").alias("entity_id")))
    return E.seed_entities(base, rows.withColumnRenamed("p_partkey", "pos"))


def customers(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("display_name"), F.lit("").alias("category"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("series"), F.lit("").alias("spec"),
        (F.col("c_custkey") % 11 != 0).alias("active"))


def order_obs(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("obs_date"),
                                            F.col("o_totalprice").alias("low_price"))


@R.add("entity_overview", """SELECT c_custkey AS entity_id, c_name AS display_name, count(o_orderkey) AS n_obs,
    CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date, min(o_totalprice) AS min_price, count(o_orderkey) > 0 AS lit
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 11 <> 0 GROUP BY ALL""")
def entity_overview(spark, d):
    return E.entity_overview(customers(spark, d), order_obs(spark, d)).withColumn("last_date", day("last_date"))


@R.add("zero_observation_entities", """SELECT c_custkey AS entity_id, lower('|' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '|')
    AS identity_key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS keyword
  FROM customer WHERE c_custkey % 11 <> 0 AND NOT (c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING')
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def zero_observation_entities(spark, d):
    pending = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.lower(F.concat(F.lit("|"), "c_mktsegment", F.lit("|"))).alias("identity_key"))
    return E.zero_observation_entities(customers(spark, d), order_obs(spark, d).filter("low_price > 250000"), pending)


@R.add("apply_anchors", """WITH a AS (SELECT s_name AS display_name, CAST(s_suppkey % 3 AS DOUBLE) AS anchor FROM supplier WHERE s_suppkey % 2 = 0),
  e AS (SELECT s_suppkey AS entity_id, s_name AS display_name, CASE WHEN s_suppkey % 5 < 3 THEN CAST(s_suppkey % 4 AS DOUBLE) END AS old FROM supplier)
  SELECT entity_id, display_name, anchor AS perf_anchor, CASE WHEN anchor IS NULL AND old IS NULL THEN 'skipped'
    WHEN anchor IS NULL THEN 'cleared' WHEN anchor IS NOT DISTINCT FROM old THEN 'already' ELSE 'set' END AS outcome
  FROM e LEFT JOIN a USING (display_name)""")
def apply_anchors(spark, d):
    s = table(spark, d, "supplier")
    ents = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("display_name"),
                    F.when(F.col("s_suppkey") % 5 < 3, (F.col("s_suppkey") % 4).cast("double")).alias("perf_anchor"))
    anchors = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("display_name"),
                                                   (F.col("s_suppkey") % 3).cast("double").alias("anchor"))
    return E.apply_anchors(ents, anchors)


@R.add("lineage_expand", """WITH RECURSIVE edge AS (SELECT c_custkey AS src, c_custkey - 1 AS dst FROM customer WHERE c_custkey % 5 > 0),
  walk AS (SELECT src, dst FROM edge UNION SELECT w.src, e.dst FROM walk w JOIN edge e ON w.dst = e.src),
  own AS (SELECT o_custkey AS entity_id, o_custkey AS origin_id, o_totalprice FROM orders UNION ALL
    SELECT w.src, o_custkey, o_totalprice FROM orders JOIN walk w ON w.dst = o_custkey)
  SELECT entity_id, count(*) AS n_obs, count(DISTINCT origin_id) AS n_origins, min(o_totalprice) AS min_price FROM own GROUP BY entity_id""")
def lineage_expand(spark, d):
    lin = table(spark, d, "customer").filter("c_custkey % 5 > 0").select(
        F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") - 1).alias("inherits_from"))
    x = L.lineage_expand(order_obs(spark, d), lin)
    return x.groupBy("entity_id").agg(F.count("*").alias("n_obs"), F.countDistinct("origin_id").alias("n_origins"),
                                      F.min("low_price").alias("min_price"))


CHANGES = """one AS (SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'retire' END AS action,
    CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 2 - p_partkey % 4 END AS entity_id, CASE WHEN p_partkey % 13 = 0 THEN 'WOOD' ELSE p_type END AS category,
    CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS series, CASE WHEN p_partkey % 2 = 0 THEN p_size || 'GB' ELSE p_size || 'TB' END AS spec,
    p_brand AS brand FROM part),
  ch AS (SELECT * FROM one UNION ALL SELECT seq + 10000000, action, CASE WHEN seq % 10 = 0 THEN entity_id WHEN action <> 'create' THEN seq + 1 END, category, series, spec, brand FROM one WHERE seq % 5 = 0)"""


@R.add("apply_entity_changes", f"""WITH {CHANGES},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(entity_id AS VARCHAR), category || '|' || series || '|' || spec) ORDER BY seq DESC) AS age FROM ch),
  holder AS (SELECT p_type category, p_name series, p_size || 'GB' spec, min(p_partkey) h FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL),
  o AS (SELECT *, CASE WHEN age > 1 THEN 'superseded'
    WHEN action <> 'create' AND entity_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown_entity' WHEN action = 'retire' THEN 'retired'
    WHEN series = '' THEN 'bad:identity' WHEN category = 'WOOD' THEN 'bad:category'
    WHEN brand IN ('Brand#1', 'Brand#2') THEN 'bad:brand' WHEN h IS NOT NULL AND h IS DISTINCT FROM entity_id THEN 'conflict' END AS refused FROM ranked LEFT JOIN holder USING (category, series, spec))
  SELECT seq, action, entity_id, category, series, spec, coalesce(refused, CASE WHEN row_number() OVER (PARTITION BY refused IS NULL, category, series, spec ORDER BY seq) > 1 THEN 'conflict'
    WHEN action = 'create' THEN 'created' ELSE 'updated' END) AS outcome FROM o""")
def apply_entity_changes(spark, d):
    return E.apply_entity_changes(part_entities(spark, d), changes(spark, d), TYPES, BRANDS)


TYPES = ("ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO")
BRANDS = tuple(f"Brand#{i}" for i in range(3, 100))


def changes(spark, d):
    """Requests made of the parts; a later half repeats some targets, and every fifth asks for its neighbour's identity."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    one = p.select(
        k.alias("seq"), F.when(k % 3 == 0, "create").when(k % 3 == 1, "update").otherwise("retire").alias("action"),
        F.when(k % 3 > 0, k * 2 - k % 4).alias("entity_id"), F.when(k % 13 == 0, "WOOD").otherwise(F.col("p_type")).alias("category"),
        F.when(k % 17 == 0, "").otherwise(F.col("p_name")).alias("series"),
        F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, "GB").otherwise("TB")).alias("spec"),
        F.col("p_brand").alias("brand"))
    again = one.filter("seq % 5 = 0").withColumns({"seq": F.col("seq") + 10_000_000, "entity_id": F.when(F.col("seq") % 10 == 0, F.col("entity_id")).otherwise(F.when(F.col("action") != "create", F.col("seq") + 1))})
    return one.unionByName(again)


@R.add("merge_entity_changes")
def merge_entity_changes(spark, d):
    ents = part_entities(spark, d)
    out = E.merge_entity_changes(ents, E.apply_entity_changes(ents, changes(spark, d), TYPES, BRANDS))
    return out.select("entity_id", "category", "series", "spec", "active")


SQL["merge_entity_changes"] = f"""WITH o AS ({SQL['apply_entity_changes']})
  SELECT p_partkey AS entity_id, CASE WHEN outcome = 'updated' THEN o.category ELSE p_type END AS category,
    CASE WHEN outcome = 'updated' THEN o.series ELSE p_name END AS series, CASE WHEN outcome = 'updated' THEN o.spec ELSE p_size || 'GB' END AS spec,
    p_partkey % 7 <> 0 AND outcome IS DISTINCT FROM 'retired' AS active
  FROM part LEFT JOIN (SELECT * FROM o WHERE outcome IN ('updated', 'retired')) o ON o.entity_id = p_partkey"""


@R.add("rebind_identities")
def rebind_identities(spark, d):
    """Listings named by part identity follow the updates of their parts."""
    ents = part_entities(spark, d)
    rows = ents.select("category", "series", "spec", F.col("entity_id").alias("listing_id"))
    out = E.rebind_identities(rows, ents, E.apply_entity_changes(ents, changes(spark, d), TYPES, BRANDS))
    return out.select("listing_id", "category", "series", "spec", "rebound")


SQL["rebind_identities"] = f"""WITH o AS ({SQL['apply_entity_changes']}),
  m AS (SELECT p_type, p_name, p_size, arg_min((o.category, o.series, o.spec), p_partkey) AS n FROM part JOIN o ON o.entity_id = p_partkey AND o.outcome = 'updated' WHERE p_partkey % 7 <> 0 GROUP BY ALL)
  SELECT p.p_partkey AS listing_id, coalesce(n[1], p.p_type) AS category, coalesce(n[2], p.p_name) AS series, coalesce(n[3], p.p_size || 'GB') AS spec, n IS NOT NULL AS rebound
  FROM part p LEFT JOIN m USING (p_type, p_name, p_size)"""


def users(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("entity_id"), F.col("c_name").alias("display_name"), (k % 7).cast("double").alias("perf_anchor"),
                    F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("category"),
                    F.when(k % 3 == 1, F.lit("南京")).alias("city"), (k % 9 != 0).alias("active"))


def shifted_obs(spark, d):
    """Three sales years on one calendar: the risk metrics need sixty periods."""
    o = observations(spark, d)
    return o.withColumn("obs_date", F.date_add("obs_date", (F.col("event_id") % 3 * 31).cast("int")))


AS_OF = "2024-03-20"
SHIFT = OBS.replace("CAST(ts AS DATE) AS obs_date", "CAST(ts AS DATE) + CAST(event_id % 3 * 31 AS INT) AS obs_date").replace(
    "CASE event_id % 3 WHEN 0 THEN '销量' WHEN 1 THEN '价格' END AS anchor", "'销量' AS anchor")
SALES_DD = """dd AS (SELECT entity_id, CASE WHEN price = 0 THEN 0.0 ELSE greatest(0.0, (price - low) / price) END AS drawdown FROM (SELECT *, min(price) OVER w low, count(*) OVER w lft
  FROM sal WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)) WHERE lft > 15)"""


@R.add("snapshot")
def snapshot(spark, d):
    obs = shifted_obs(spark, d).withColumn("anchor", F.lit("销量"))
    # both sides fold users into ten entities, so that the sales track is long enough for the risk block
    obs = obs.withColumn("entity_id", F.col("entity_id") % 10)
    s = P.compute_snapshot(users(spark, d), obs, F.lit(AS_OF).cast("date"))
    return s.select("entity_id", "display_name", "perf_anchor", "n_periods", "last_price", "slope_7_pct_per_day", "label",
                    "sales_n_periods", "sales_last_price", "sales_label", "median_pct", "p75_pct", "max_pct", "samples", "stab_action")


def _snapshot_sql() -> str:
    obs = SHIFT.replace("user_id AS entity_id", "user_id % 10 AS entity_id")
    def_l0 = l0_sql("def", "entity_id").replace("ranked AS", "d_ranked AS").replace("FROM ranked", "FROM d_ranked").replace(
        "raw AS (", "d_raw AS (").replace("FROM raw)", "FROM d_raw)").replace("calc AS (", "d_calc AS (").replace(
        "FROM calc)", "FROM d_calc)").replace("l0 AS (", "d_l0 AS (")
    return f"""WITH {obs}, def AS (SELECT entity_id, obs_date, min(low_price) price FROM obs WHERE condition = '全新' AND source IN {SELF}
      AND obs_date <= DATE '{AS_OF}' GROUP BY ALL), sal AS (SELECT entity_id, obs_date, min(low_price) price FROM obs
      WHERE source = 'manmanmai' AND anchor = '销量' AND obs_date <= DATE '{AS_OF}' GROUP BY ALL),
      {def_l0}, {l0_sql('sal', 'entity_id')}, {SALES_DD},
      arr AS (SELECT entity_id, list_sort(list(drawdown)) a, median(drawdown) m FROM dd SEMI JOIN (SELECT entity_id FROM sal
        GROUP BY entity_id HAVING count(*) >= 60) USING (entity_id) GROUP BY entity_id),
      q AS (SELECT *, len(a) n, greatest(1, least((len(a) + 1) * 3 // 4, len(a) - 1)) j FROM arr),
      risk AS (SELECT entity_id, round(m * 100, 2) AS median_pct, round((a[j] * (4 - ((n + 1) * 3 - j * 4)) + a[j + 1]
        * ((n + 1) * 3 - j * 4)) / 4 * 100, 2) AS p75_pct, round(a[n] * 100, 2) AS max_pct, n AS samples FROM q),
      nd AS (SELECT entity_id, count(*) n FROM def GROUP BY 1), ns AS (SELECT entity_id, count(*) n FROM sal GROUP BY 1)
      SELECT c_custkey AS entity_id, c_name AS display_name, CAST(c_custkey % 7 AS DOUBLE) AS perf_anchor, coalesce(nd.n, 0) AS n_periods,
        d_l0.last_price, d_l0.slope_7_pct_per_day, d_l0.label, ns.n AS sales_n_periods, l0.last_price AS sales_last_price,
        l0.label AS sales_label, median_pct, p75_pct, max_pct, samples,
        CASE WHEN median_pct IS NULL THEN NULL WHEN median_pct > 10 AND coalesce(l0.slope_7_pct_per_day, 0) < -0.2 THEN 'wait' ELSE 'act_now' END AS stab_action
      FROM customer LEFT JOIN nd ON nd.entity_id = c_custkey LEFT JOIN ns ON ns.entity_id = c_custkey
        LEFT JOIN d_l0 ON d_l0.entity_id = c_custkey LEFT JOIN l0 ON l0.entity_id = c_custkey LEFT JOIN risk ON risk.entity_id = c_custkey"""


SQL["snapshot"] = _snapshot_sql()


@R.add("snapshot_contrast", f"""WITH {OBS.replace('user_id AS', 'user_id % 10 AS')}, ser AS (SELECT entity_id, vendor, obs_date, min(low_price) price FROM obs
    WHERE condition = '全新' AND source = '自采' AND vendor IS NOT NULL AND entity_id = 0 GROUP BY ALL), {l0_sql('ser', 'entity_id, vendor')}
  SELECT entity_id, vendor, last_price, slope_7_pct_per_day, label, round((max(last_price) OVER () - min(last_price) OVER ())
    / min(last_price) OVER () * 100, 2) AS spread_pct FROM l0""")
def snapshot_contrast(spark, d):
    obs = observations(spark, d).withColumn("entity_id", F.col("entity_id") % 10)
    c = P.snapshot_contrast(users(spark, d), obs, F.lit("2024-12-31").cast("date"), VENDORS)
    return c.select("entity_id", "vendor", "last_price", "slope_7_pct_per_day", "label", "spread_pct")


@R.add("verify_snapshot", f"""WITH ser AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, min(value) AS price FROM events GROUP BY ALL),
  {l0_sql('ser', 'entity_id')}, long AS (UNPIVOT (SELECT entity_id, last_price, d1_pct, slope_7_pct_per_day, min_30 FROM l0)
    ON last_price, d1_pct, slope_7_pct_per_day, min_30 INTO NAME metric VALUE published)
  SELECT entity_id, metric, published, published + 0.5 AS recomputed FROM long WHERE metric = 'min_30' AND entity_id % 4 = 0""")
def verify_snapshot(spark, d):
    e = table(spark, d, "events")
    m = S.l0_metrics(S.build_series(e.select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"),
                                             F.col("value").alias("low_price"))))
    off = m.withColumn("min_30", F.col("min_30") + F.when(F.col("entity_id") % 4 == 0, 0.5).otherwise(0.001))
    return P.verify_snapshot(m, off)


@R.add("board", f"""WITH {OBS}, seen AS (SELECT * FROM obs WHERE obs_date <= DATE '2024-01-20'),
  def AS (SELECT entity_id, obs_date, min(low_price) price FROM seen WHERE condition = '全新' AND source IN {SELF} GROUP BY ALL),
  ser AS (SELECT entity_id, count(*) n, string_agg(CAST(obs_date AS VARCHAR) || '=' || CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY obs_date) s FROM def GROUP BY 1),
  trk AS (SELECT entity_id, count(DISTINCT vendor) nv FROM seen SEMI JOIN (SELECT DISTINCT entity_id, vendor FROM seen WHERE source = '自采'
    AND condition = '全新' AND vendor IS NOT NULL) USING (entity_id, vendor) GROUP BY 1),
  ln AS (SELECT entity_id, count(DISTINCT obs_date) nl FROM seen WHERE source = 'manmanmai' GROUP BY 1), {l0_sql('def', 'entity_id')}
  SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '南京' ELSE '其他' END AS "group",
    coalesce(n, 0) AS n_periods, s AS series, nv AS n_vendors, nl AS n_lines, l0.last_price, l0.label
  FROM customer c LEFT JOIN ser ON ser.entity_id = c_custkey LEFT JOIN trk ON trk.entity_id = c_custkey
    LEFT JOIN ln ON ln.entity_id = c_custkey LEFT JOIN l0 ON l0.entity_id = c_custkey WHERE c_custkey % 9 <> 0""")
def board(spark, d):
    b = P.board(users(spark, d), observations(spark, d), F.lit("2024-01-20").cast("date"))
    txt = F.array_join(F.transform("series", lambda p: F.concat_ws(
        "=", F.date_format(p["obs_date"], "yyyy-MM-dd"), F.round(p["price"] * 100).cast("long").cast("string"))), ";")
    return b.select("entity_id", "group", "n_periods", txt.alias("series"),
                    F.when(F.col("tracks").isNotNull(), F.size("tracks").cast("long")).alias("n_vendors"),
                    F.when(F.col("lines").isNotNull(), F.size("lines").cast("long")).alias("n_lines"), "last_price", "label")


@R.add("board_totals")
def board_totals(spark, d):
    return P.board_totals(P.board(users(spark, d), observations(spark, d), F.lit("2024-01-20").cast("date")))


SQL["board_totals"] = (f"SELECT count(*) AS total, count(*) FILTER (n_periods > 0) AS with_data, count(label) AS l0_ok "
                       f"FROM ({SQL['board']})")


@R.add("anchor_board", """WITH e AS (SELECT p_type, p_name, p_size || 'GB' spec, min(p_partkey) AS entity_id FROM part GROUP BY ALL),
  n AS (SELECT l_partkey, count(*) n FROM lineitem GROUP BY 1)
  SELECT p.p_partkey AS url, e.entity_id, coalesce(n.n, 0) AS points FROM part p
  LEFT JOIN e ON e.p_type = p.p_type AND e.p_name = p.p_name AND e.spec = CASE WHEN p.p_partkey % 3 = 0 THEN 'none' ELSE p.p_size || 'GB' END
  LEFT JOIN n ON n.l_partkey = e.entity_id""")
def anchor_board(spark, d):
    ents = part_entities(spark, d)
    reg = ents.select(F.col("entity_id").alias("url"), "category", "series",
                      F.when(F.col("entity_id") % 3 == 0, "none").otherwise(F.col("spec")).alias("spec"))
    obs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"))
    return G.anchor_board(reg, ents, obs).select("url", "entity_id", "points")
