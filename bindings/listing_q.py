"""Listings: titles over part, search rows and screen nodes over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, table
from tidemark.operators import listings as G

R = Registry()
QUERIES, SQL = R.queries, R.sql

TITLE = ("CASE p_partkey % 10 WHEN 0 THEN 'RTX 5070 8GB ' || p_name WHEN 1 THEN 'RTX 5070Ti 8G' WHEN 2 THEN 'RTX 5070/5060 8G' WHEN 3 THEN 'RTX 5070|8G|RTX 5060' "
         "WHEN 4 THEN '主机 RTX 5070 8G' WHEN 5 THEN 'RTX 5070 16G' WHEN 6 THEN 'RTX5070 PRO 8G' WHEN 7 THEN '电脑显卡 RTX 5070 8 GB' "
         "WHEN 8 THEN '主板 B860 支持 RTX 5070 8G' ELSE '270K/265K ' || p_name END || ' ' || p_brand")


@R.add("title_rules", """SELECT p_partkey, p_partkey % 10 IN (0, 4, 7, 8) AS matches, p_partkey % 10 = 4 AS bundle,
  p_partkey % 10 IN (4, 8, 9) AS rejected FROM part""")
def title_rules(spark, d):
    t = F.expr(TITLE)
    return table(spark, d, "part").select("p_partkey", G.match_spec(t, F.lit("RTX 5070"), F.lit("8GB")).alias("matches"),
                                          G.is_bundle(t).alias("bundle"), G.candidate_reject(t, F.lit("显卡")).alias("rejected"))


def targets(spark, d):
    """One target per part type: its search returns every part of the type."""
    p = table(spark, d, "part")
    one = p.groupBy(F.col("p_type").alias("target_id")).agg(F.min_by(F.struct("p_name", "p_size", "p_retailprice"), "p_partkey").alias("t"))
    return one.select("target_id", F.split("t.p_name", " ")[1].alias("series"), F.col("t.p_size").cast("string").alias("spec"),
                      F.array(F.split("t.p_name", " ")[0]).alias("aliases"), F.col("t.p_name").alias("name"),
                      F.col("t.p_retailprice").alias("price"), F.lit("显卡").alias("category"))


BOARD = "b860 z890 z790 b760 z690 b660 b650 b850 x870 x670 x570 b550 lga am5 am4".split()


@R.add("match_candidates", f"""WITH t AS (SELECT p_type, arg_min((p_name, p_size, p_retailprice), p_partkey) AS v FROM part GROUP BY 1),
  r AS (SELECT p.p_type AS target_id, p_partkey AS pos, regexp_replace(lower(v[1] || ' ' || p_brand || ' ' || p_mfgr), '\\s+', '', 'g') AS title, regexp_replace(lower(v[1]), '\\s+', '', 'g') AS target,
      CAST(v[2] AS VARCHAR) AS spec, v[3] AS want, p_retailprice AS price FROM (SELECT *, repeat('z', CAST(p_partkey % 40 AS INT)) AS p_mfgr FROM part) p JOIN t USING (p_type) WHERE p_partkey % 5 <> 0),
  s AS (SELECT target_id, pos, 2.0::DOUBLE * length(target) / (length(target) + length(title)) + CASE WHEN contains(title, spec) THEN 0.15::DOUBLE ELSE 0 END
      - CASE WHEN abs(price - want) / greatest(want, 1.0) > 0.25 THEN 0.25::DOUBLE ELSE 0 END AS score FROM r WHERE NOT ({' OR '.join(f"contains(title, '{w}')" for w in BOARD)}))
  SELECT target_id, pos, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, pos) = 1 AND score >= 0.40""")
def match_candidates(spark, d):
    """Titles are the target's name with words behind it, for which the ratio has a closed form."""
    p, t = table(spark, d, "part"), targets(spark, d)
    filler = F.repeat(F.lit("z"), (F.col("p_partkey") % 40).cast("int"))
    rows = p.join(t.select("target_id", "name"), F.col("p_type") == F.col("target_id")).select(
        "target_id", F.col("p_partkey").alias("pos"), F.concat_ws(" ", "name", "p_brand", filler).alias("title"),
        F.when(F.col("p_partkey") % 5 == 0, "10").otherwise("1").alias("siteid"), F.col("p_partkey").cast("string").alias("skuid"), F.col("p_retailprice").cast("string").alias("price"))
    return G.match_candidates(rows, t).select("target_id", "pos", F.round("score", 6).alias("score"))


def search_rows(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("prourl"),
        F.concat_ws(" ", F.lit("RTX 5070 8G"), "event_type").alias("title"), F.concat(F.lit("¥"), F.col("value").cast("string")).alias("price"),
        F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.concat(F.floor("value").cast("string"), F.lit("+"))).alias("sales"),
        F.when(k % 3 == 0, "10").otherwise("1").alias("siteid"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("url"))


ROWS = """r AS (SELECT user_id AS query_id, event_id AS pos, CASE WHEN k % 10 = 0 THEN '' ELSE 'u' || k END AS url, event_type, value AS price,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE floor(value) END AS sales, CASE WHEN k % 3 = 0 THEN '10' ELSE '1' END AS siteid
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


@R.add("top_sales", f"""WITH {ROWS}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN url = '' THEN event_type ELSE url END ORDER BY pos) = 1)
  SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY sales DESC, pos) AS rank FROM u QUALIFY rank <= 5""")
def top_sales(spark, d):
    return G.top_sales(search_rows(spark, d), 5).select("query_id", "pos", "rank")


@R.add("cheapest", f"""WITH {ROWS} SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY price, pos) AS rank FROM r WHERE price > 0 QUALIFY rank <= 12""")
def cheapest(spark, d):
    return G.cheapest(search_rows(spark, d), 12).select("query_id", "pos", "rank")


@R.add("dual_anchor", f"""WITH {ROWS}, s AS (SELECT query_id, arg_max(url, (sales, -pos)) AS sales_url FROM r WHERE url <> '' GROUP BY 1),
  p AS (SELECT query_id, arg_min(url, (price, pos)) AS price_url FROM r JOIN s USING (query_id) WHERE url <> '' AND url <> sales_url AND sales > 0 AND price > 0 GROUP BY 1)
  SELECT query_id, sales_url, price_url FROM s LEFT JOIN p USING (query_id)""")
def dual_anchor(spark, d):
    return G.dual_anchor(search_rows(spark, d), F.lit("RTX 5070"), F.lit("8GB"))


@R.add("cheap_anchor", f"""WITH {ROWS}, u AS (SELECT * FROM r WHERE siteid = '1' AND url <> '' QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1),
  t AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY price, pos) AS rank FROM u WHERE event_type <> 'error' AND sales > 0 QUALIFY rank <= 3),
  n AS (SELECT url, count(*) AS n_points FROM r GROUP BY url)
  SELECT query_id, url, rank, n_points FROM t JOIN n USING (url) WHERE n_points >= 95""")
def cheap_anchor(spark, d):
    rows = search_rows(spark, d)
    points = rows.groupBy("url").agg(F.count("*").alias("n_points"))
    return G.cheap_anchor(rows, points, 3, 95, F.lit("RTX 5070"), F.lit("8GB"), "error").select("query_id", "url", "rank", "n_points")


# --- screens: sixty consecutive events as the nodes of a screen ---------------------------
VAL = ("CASE event_type WHEN 'view' THEN '¥' WHEN 'click' THEN CAST(CAST(floor(value * 10) AS INT) AS STRING) WHEN 'purchase' THEN '万' "
       "WHEN 'signup' THEN 'lead number ' || event_id || repeat(' long text', 6) ELSE '.5' END")
NODES = """n AS (SELECT event_id // 60 AS screen_id, event_id AS pos, CAST(json_extract_string(props, '$.k') AS INT) * 12 AS y1, CAST(json_extract_string(props, '$.k') AS INT) * 12 + 8 AS y2,
  CASE event_type WHEN 'view' THEN '¥' WHEN 'click' THEN CAST(CAST(floor(value * 10) AS INT) AS VARCHAR) WHEN 'purchase' THEN '万'
    WHEN 'signup' THEN 'lead number ' || event_id || repeat(' long text', 6) ELSE '.5' END AS val FROM events)"""


def nodes(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 60).alias("screen_id"), F.col("event_id").alias("pos"), (k * 12).alias("y1"), (k * 12 + 8).alias("y2"),
                                            F.lit(0).alias("x1"), F.expr(VAL).alias("val"))


def _assemble_sql() -> str:
    leads = ", ".join(f"lead(y1, {i}) OVER w a{i}, lead(val, {i}) OVER w v{i}" for i in range(1, 6))
    cols, prev = [], "true"
    for i in range(1, 6):
        cols.append(f"coalesce({prev} AND abs(a{i} - y1) <= 30, false) AS g{i}, coalesce({prev} AND abs(a{i} - y1) <= 30 AND v{i} <> '万', false) AS c{i}")
        prev = f"c{i}"
    num = " || ".join(f"CASE WHEN g{i} AND regexp_full_match(v{i}, '[0-9.]+') THEN v{i} ELSE '' END" for i in range(1, 6))
    wan = " OR ".join(f"(g{i} AND v{i} = '万')" for i in range(1, 6))
    return f"""{NODES}, ld AS (SELECT *, {leads} FROM n WINDOW w AS (PARTITION BY screen_id ORDER BY pos)),
      f AS (SELECT *, {', '.join(cols)} FROM ld WHERE val = '¥'),
      prices AS (SELECT screen_id, pos, y1, TRY_CAST({num} AS DOUBLE) * CASE WHEN {wan} THEN 10000 ELSE 1 END AS price FROM f WHERE TRY_CAST({num} AS DOUBLE) IS NOT NULL)"""


ASSEMBLE = _assemble_sql()
PAIR = """pair AS (SELECT p.screen_id, p.pos AS price_pos, price, val AS descr, p.y1 - n.y2 AS gap FROM prices p JOIN n ON n.screen_id = p.screen_id AND length(val) > 50
  AND p.y1 - n.y2 >= 0 AND p.y1 - n.y2 < 220 QUALIFY row_number() OVER (PARTITION BY p.screen_id, p.pos ORDER BY p.y1 - n.y2, n.pos) = 1)"""


@R.add("assemble_price", f"WITH {ASSEMBLE} SELECT screen_id, pos, price FROM prices")
def assemble_price(spark, d):
    return G.assemble_price(nodes(spark, d)).select("screen_id", "pos", "price")


@R.add("lead_pairing", f"""WITH {ASSEMBLE}, {PAIR} SELECT screen_id, price_pos, price, descr AS "desc", gap FROM pair""")
def lead_pairing(spark, d):
    n = nodes(spark, d)
    return G.lead_pairing(n, G.assemble_price(n))


@R.add("dedupe_leads", f"""WITH {ASSEMBLE}, {PAIR} SELECT screen_id % 10 AS keyword, min(price_pos) AS pos, substring(descr, 1, 45) AS head FROM pair GROUP BY 1, 3""")
def dedupe_leads(spark, d):
    n = nodes(spark, d)
    leads = G.lead_pairing(n, G.assemble_price(n)).select((F.col("screen_id") % 10).alias("keyword"), F.col("price_pos").alias("pos"), "desc")
    return G.dedupe_leads(leads).select("keyword", "pos", F.substring("desc", 1, 45).alias("head"))


DESC = ("CASE p_partkey % 12 WHEN 0 THEN '监管机 成色好' WHEN 1 THEN '非监管机 64G' WHEN 2 THEN '不是那种监管的' WHEN 3 THEN '可绕过验证 MDM' WHEN 4 THEN '非MDM 企业版' "
        "WHEN 5 THEN '有 mdm 锁' WHEN 6 THEN '无头骑士 极速发' WHEN 7 THEN '库存批发' WHEN 8 THEN '优选店铺 64g' WHEN 9 THEN '个人自用' WHEN 10 THEN '监管不是问题' "
        "ELSE '监管机已解,这台是监管' END || ' ' || p_name")
FLAG = ("CASE p_partkey % 12 WHEN 0 THEN 'MDM!' WHEN 1 THEN '64G' WHEN 3 THEN 'MDM!' WHEN 4 THEN 'CORP?' WHEN 5 THEN 'MDM!' WHEN 6 THEN 'HEADLESS!,TEASER!' "
        "WHEN 7 THEN 'BULK?' WHEN 8 THEN 'SHOP?,64G' WHEN 11 THEN 'MDM!' ELSE '' END")


def flagged(spark, d):
    return G.with_flags(table(spark, d, "part").select("p_partkey", F.expr(DESC).alias("desc")))


@R.add("listing_flags", f"""SELECT p_partkey, {FLAG} AS flags, p_partkey % 12 IN (0, 3, 5, 6, 11) AS blocked, p_partkey % 12 IN (4, 7, 8) AS soft FROM part""")
def listing_flags(spark, d):
    return flagged(spark, d).select("p_partkey", F.array_join("flags", ",").alias("flags"), "blocked", "soft")


@R.add("lead_stats", """SELECT count(*) AS total, count(*) FILTER (p_partkey % 12 IN (1, 8)) AS with_64g, count(*) FILTER (p_partkey % 12 IN (0, 3, 5, 6, 11)) AS blocked,
  count(*) FILTER (p_partkey % 12 IN (4, 7, 8)) AS soft FROM part""")
def lead_stats(spark, d):
    return G.lead_stats(flagged(spark, d))


KEY = "CAST(CAST(l_quantity AS INT) AS VARCHAR) || '|' || substring(p_name || ' ' || p_type || ' item for sale now', 1, 30)"
SEEN = f"""li AS (SELECT {KEY} AS listing_key, l_orderkey * 100 + l_linenumber AS pos, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lead_rows(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_quantity").cast("int").alias("price"), F.concat_ws(" ", "p_name", "p_type", F.lit("item for sale now")).alias("desc"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), "l_returnflag")


def fresh(spark, d):
    rows = lead_rows(spark, d)
    key = F.concat_ws("|", F.col("price").cast("string"), F.substring("desc", 1, 30)).alias("listing_key")
    return G.fresh_listings(rows.filter("l_returnflag <> 'A'"), rows.filter("l_returnflag = 'A' AND price < 26").select(key))


@R.add("fresh_listings", f"WITH {SEEN} SELECT listing_key, min(pos) AS pos FROM li WHERE l_returnflag <> 'A' AND listing_key NOT IN (SELECT listing_key FROM li WHERE l_returnflag = 'A' AND CAST(split_part(listing_key, '|', 1) AS INT) < 26) GROUP BY 1")
def fresh_listings(spark, d):
    return fresh(spark, d)[0].select("listing_key", "pos")


@R.add("seen_after", f"WITH {SEEN} SELECT DISTINCT listing_key FROM li WHERE l_returnflag <> 'A' OR CAST(split_part(listing_key, '|', 1) AS INT) < 26")
def seen_after(spark, d):
    return fresh(spark, d)[1]


def gated(spark, d):
    k = F.col("p_partkey")
    return G.evidence_gate(table(spark, d, "part").select(
        k, F.when(k % 3 == 0, "").otherwise("a.png").alias("screenshot_detail"), F.when(k % 5 != 0, "s").alias("seller_id"),
        F.when(k % 7 == 0, "").otherwise("f.png").alias("screenshot_fav"), F.when(k % 2 == 0, "fav_btn_not_found").otherwise("").alias("reason")))


@R.add("evidence_gate", """SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'fav_btn_not_found' ELSE 'unknown' END AS reject_reason FROM part""")
def evidence_gate(spark, d):
    return gated(spark, d).select("p_partkey", "ok", "reject_reason")


@R.add("gate_stats", """SELECT count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_no_trace FROM
  (SELECT p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part)""")
def gate_stats(spark, d):
    return G.gate_stats(gated(spark, d))


WORDS = "w AS (SELECT user_id AS page_id, CAST(floor(value * 10) AS INT) AS y, event_id % 97 AS x, CASE WHEN event_id % 9 = 0 THEN '¥1' ELSE substring(event_type, 1, 2) END AS text FROM events)"
LINES = f"""{WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, text) rn FROM w),
  fold AS (SELECT page_id, rn, y, x, text, y AS fy FROM o WHERE rn = 1 UNION ALL
    SELECT o.page_id, o.rn, o.y, o.x, o.text, CASE WHEN o.y - f.fy > 12 THEN o.y ELSE f.fy END FROM fold f JOIN o ON o.page_id = f.page_id AND o.rn = f.rn + 1),
  lines AS (SELECT page_id, fy AS y, string_agg(text, '' ORDER BY x, y, text) AS line FROM fold GROUP BY 1, 2)"""


def words(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.floor(F.col("value") * 10).cast("int").alias("y"), (F.col("event_id") % 97).alias("x"),
                                            F.when(F.col("event_id") % 9 == 0, "¥1").otherwise(F.substring("event_type", 1, 2)).alias("text"))


@R.add("line_cluster", f"WITH RECURSIVE {LINES} SELECT * FROM lines")
def line_cluster(spark, d):
    return G.line_cluster(words(spark, d))


@R.add("price_context", f"""WITH RECURSIVE {LINES}, c AS (SELECT *, lag(line, 2) OVER p a, lag(line, 1) OVER p b, lead(line, 1) OVER p c FROM lines WINDOW p AS (PARTITION BY page_id ORDER BY y))
  SELECT page_id, y, concat_ws(chr(10), a, b, line, c) AS context FROM c WHERE regexp_matches(line, '[¥￥]\\s*\\d')""".replace("\\\\", "\\"))
def price_context(spark, d):
    return G.price_context(G.line_cluster(words(spark, d))).select("page_id", "y", "context")


@R.add("candidate_ranking", """WITH c AS (SELECT p_partkey, round(p_size % 10 + p_partkey % 11 + p_size % 7 + p_partkey % 5 + p_size % 3 + CAST(p_partkey % 10 AS DOUBLE) / 10, 1) AS total FROM part)
  SELECT p_partkey, total, rank() OVER (ORDER BY total DESC) AS rank FROM c""")
def candidate_ranking(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = table(spark, d, "part").select("p_partkey", *[x.cast("double").alias(n) for n, x in zip("abcdef", (s % 10, k % 11, s % 7, k % 5, s % 3, (k % 10) / 10))])
    return G.candidate_ranking(c, list("abcdef")).select("p_partkey", "total", "rank")


@R.add("top_n_per_city", """WITH r AS (SELECT c_nationkey AS city, c_custkey AS row_id, round((c_acctbal + 1000) * 12 / ((c_custkey % 50 + 10) * 10007) * 100, 2) AS rr_pct FROM customer)
  SELECT city, row_id, rr_pct, row_number() OVER (PARTITION BY city ORDER BY rr_pct DESC, row_id) AS rank FROM r QUALIFY rank <= 20""")
def top_n_per_city(spark, d):
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("city"), F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") + 1000).alias("rent_per_month"),
                                           ((F.col("c_custkey") % 50 + 10) * 10007).alias("price"))
    return G.top_n_per_city(r).select("city", "row_id", "rr_pct", "rank")
