"""Listing registry, proposals and queues over part, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, table
from tidemark.operators import registry as G

R = Registry()
QUERIES, SQL = R.queries, R.sql


def registry(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("https://item.jd.com/"), k.cast("string"), F.lit(".html")).alias("url"), F.col("p_name").alias("sp_name"),
        F.when(k % 4 == 0, "微星").otherwise("").alias("vendor"), F.when(k % 3 == 0, "自营").otherwise("官旗").alias("channel"),
        F.when(k % 5 == 0, "gwdang").alias("source"), (k % 9 == 0).alias("retired"), k.alias("key"))


@R.add("collection_scope", """SELECT p_partkey AS key FROM part WHERE p_partkey % 9 <> 0 AND contains(p_name, 'ring') AND p_partkey % 5 <> 0""")
def collection_scope(spark, d):
    return G.collection_scope(registry(spark, d), only="ring", source="manmanmai").select("key")


@R.add("resume_targets", """SELECT 'todo' AS part, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
  UNION ALL SELECT 'kept', l_partkey + 1000 * 0 FROM lineitem WHERE l_quantity > 40 AND l_partkey IN (SELECT p_partkey FROM part)""")
def resume_targets(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.concat(F.lit("https://item.jd.com/"), F.col("l_partkey").cast("string"), F.lit(".html")).alias("url"), F.col("l_partkey").alias("key"))
    todo, kept = G.resume_targets(registry(spark, d), done)
    return todo.select(F.lit("todo").alias("part"), "key").unionByName(kept.select(F.lit("kept").alias("part"), "key"))


P_URL = ("CASE l_linenumber WHEN 1 THEN 'https://jingfen.jd.com/detail/' || l_partkey WHEN 2 THEN 'https://item.jd.com/x' || l_partkey || '.html' "
         "WHEN 3 THEN 'https://item.jd.com/9' || l_orderkey || l_partkey || '.html' ELSE 'https://item.jd.com/' || l_partkey || '.html' END")


@R.add("registry_sync", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {P_URL} AS url, CASE WHEN l_partkey % 4 = 0 THEN '微星' ELSE '' END AS vendor,
    CASE WHEN l_partkey % 6 = 0 THEN '自营' WHEN l_partkey % 6 = 1 THEN '' ELSE '官旗' END AS ch FROM lineitem WHERE l_returnflag = 'A'),
  j AS (SELECT p.*, r.p_partkey IS NOT NULL AS have, CASE WHEN r.p_partkey % 3 = 0 THEN '自营' ELSE '官旗' END AS rc FROM p LEFT JOIN part r ON p.url = 'https://item.jd.com/' || r.p_partkey || '.html')
  SELECT CASE WHEN l_linenumber = 1 THEN 'skip_jf' WHEN l_linenumber = 2 THEN 'skip_bad' WHEN NOT have THEN 'add' WHEN rc <> CASE WHEN ch = '' THEN '待核' ELSE ch END THEN 'update' ELSE 'dup' END AS action,
    vendor, CASE WHEN ch = '' THEN '待核' ELSE ch END AS channel, CASE WHEN l_orderkey % 2 = 0 THEN 'gwdang' END AS source, count(*) AS n FROM j GROUP BY ALL""")
def registry_sync(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey")
    p = li.select(F.struct("l_orderkey", "l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "A", G.APPROVED).otherwise(G.PENDING).alias("status"), F.expr(P_URL).alias("url"),
                  F.lit("某").alias("vendor"), F.when(k % 4 == 0, "微星店").otherwise("公版店").alias("sp_name"),
                  F.when(k % 6 == 0, "自营").when(k % 6 == 1, "").otherwise("官旗").alias("channel"), F.when(F.col("l_orderkey") % 2 == 0, "x search 配对 y").alias("match_note"))
    out = G.registry_sync(registry(spark, d), p, ("公版", "七彩虹", "微星"))
    return out.groupBy("action", "vendor", "channel", "source").agg(F.count("*").alias("n"))


@R.add("enrich_proposals", """WITH p AS (SELECT o_orderkey AS pos, o_orderkey % 4 AS m, CASE WHEN o_orderkey % 4 > 0 THEN 'k' || o_custkey END AS sku, c_custkey, c_mktsegment FROM orders
    LEFT JOIN customer ON o_orderkey % 4 > 0 AND c_custkey = o_custkey AND c_custkey % 5 <> 0 WHERE o_orderkey % 4 < 3 AND o_orderkey % 10 <> 0)
  SELECT pos, CASE WHEN c_custkey IS NULL OR c_mktsegment = 'BUILDING' THEN CASE m WHEN 2 THEN 'https://item.jd.com/abc.html' ELSE 'https://jingfen.jd.com/1' END
      WHEN c_custkey % 2 = 0 THEN 'https://item.jd.com/' || c_custkey || '.html' WHEN m = 2 THEN 'https://item.jd.com/abc.html' ELSE 'https://item.jd.com/' || sku || '.html' END AS url,
    CASE WHEN c_custkey IS NULL OR c_mktsegment = 'BUILDING' THEN 'old' WHEN c_custkey % 3 = 0 THEN '自营店' ELSE c_mktsegment || '旗舰' END AS vendor,
    CASE WHEN c_custkey IS NULL OR c_mktsegment = 'BUILDING' THEN 'c' WHEN c_custkey % 3 = 0 THEN '自营' ELSE '官旗' END AS channel,
    CASE WHEN c_custkey IS NULL OR c_mktsegment = 'BUILDING' THEN 'skipped' ELSE 'done' END AS outcome FROM p""")
def enrich_proposals(spark, d):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    p = table(spark, d, "orders").select(
        k.alias("pos"), F.when(k % 10 == 0, G.PENDING).otherwise(G.APPROVED).alias("status"),
        F.when(m > 0, F.concat(F.lit("k"), F.col("o_custkey").cast("string"))).alias("sku"),
        F.when(m == 2, "https://item.jd.com/abc.html").when(m == 3, "https://item.jd.com/5.html").otherwise("https://jingfen.jd.com/1").alias("url"),
        F.lit("old").alias("vendor"), F.lit("c").alias("channel"))
    c = F.col("c_custkey")
    info = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(
        F.concat(F.lit("k"), c.cast("string")).alias("sku"),
        F.when(F.col("c_mktsegment") == "BUILDING", " ").when(c % 3 == 0, "自营店").otherwise(F.concat("c_mktsegment", F.lit("旗舰"))).alias("shop_name"),
        F.when(c % 2 == 0, c.cast("string")).otherwise("x9").alias("source_sku"))
    return G.enrich_proposals(p, info).select("pos", "url", "vendor", "channel", "outcome")


@R.add("latest_picture", """WITH r AS (SELECT lower(p_type || '|' || p_name || '|' || p_size) AS identity_key, CAST(o_orderdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS pos,
    CASE WHEN l_linenumber % 2 = 0 AND o_orderdate < DATE '2001-07-01' THEN 'pic' || l_orderkey || '_' || l_linenumber || '_' || l_partkey END AS pic
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)
  SELECT identity_key, arg_max(pic, (pos, pic)) AS pic, CAST(max(date) AS VARCHAR) AS date FROM r WHERE pic IS NOT NULL AND date = (SELECT max(date) FROM r WHERE pic IS NOT NULL) GROUP BY 1""")
def latest_picture(spark, d):
    li, p, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    pic = F.concat(F.lit("pic"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    show = (F.col("l_linenumber") % 2 == 0) & (F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp_ntz"))
    payload = F.concat(F.lit('{"a":{"spPic":""},"trend":{"deep":[{"spPic": "'), F.when(show, pic).otherwise(""), F.lit('"}]}}'))
    dumps = j.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), pic.alias("p")).alias("pos"),
                     F.col("p_type").alias("category"), F.col("p_name").alias("series"), F.col("p_size").cast("string").alias("spec"), payload.alias("payload"))
    return G.latest_picture(dumps)


PROP = """p AS (SELECT o_orderkey AS pos, 'id' || (o_custkey % 300) AS identity_key, CASE WHEN o_orderkey % 2 = 0 THEN '销量' ELSE '价格' END AS anchor, o_orderkey % 7 = 0 AS is_new,
  CASE WHEN o_orderkey % 5 = 0 THEN '通过' ELSE '待核' END AS status, CASE o_orderkey % 3 WHEN 0 THEN '自营' WHEN 1 THEN '官旗' ELSE '三方店铺' END AS channel,
  CASE WHEN o_orderkey % 11 < 6 THEN 'v' ELSE '' END AS vendor FROM orders)"""


def proposals(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("pos"), F.concat(F.lit("id"), (F.col("o_custkey") % 300).cast("string")).alias("identity_key"), F.when(k % 2 == 0, "销量").otherwise("价格").alias("anchor"),
        F.when(k % 5 == 0, G.APPROVED).otherwise(G.PENDING).alias("status"), F.when(k % 3 == 0, "自营").when(k % 3 == 1, "官旗").otherwise("三方店铺").alias("channel"),
        F.when(k % 11 < 6, "v").otherwise("").alias("vendor"))


@R.add("replace_proposals", f"""WITH {PROP}, n AS (SELECT max(pos) AS pos, identity_key, anchor FROM p WHERE is_new GROUP BY 2, 3)
  SELECT pos, identity_key, anchor FROM p ANTI JOIN n USING (identity_key, anchor) WHERE NOT is_new UNION ALL SELECT pos, identity_key, anchor FROM n""")
def replace_proposals(spark, d):
    p = proposals(spark, d)
    return G.replace_proposals(p.filter("pos % 7 <> 0"), p.filter("pos % 7 = 0")).select("pos", "identity_key", "anchor")


@R.add("approve_proposals", f"""WITH {PROP} SELECT pos, CASE WHEN (identity_key IN ('id7', 'id8') AND anchor = '销量') OR (status = '待核' AND channel IN ('自营', '官旗') AND vendor <> '')
  THEN '通过' ELSE status END AS status FROM p""")
def approve_proposals(spark, d):
    p = proposals(spark, d)
    keys = p.filter(F.col("identity_key").isin("id7", "id8") & (F.col("anchor") == "销量")).select("identity_key", "anchor")
    return G.approve_proposals(p, keys).select("pos", "status")


def queue(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("queue_id"), F.array(F.concat(F.lit("u"), (k % 900).cast("string")), F.concat(F.lit("u"), (k % 700).cast("string"))).alias("urls"),
                                            F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"))


@R.add("queue_dup", """WITH q AS (SELECT o_orderkey, unnest(['u' || (o_orderkey % 900), 'u' || (o_orderkey % 700)]) AS url FROM orders WHERE o_orderstatus <> 'F'),
  b AS (SELECT url, min(o_orderkey) AS busy_in FROM q GROUP BY 1), r AS (SELECT c_custkey AS pos, unnest(['u' || c_custkey, 'u' || (c_custkey * 2)]) AS url FROM customer)
  SELECT pos, count(*) AS n_dup, min(url) AS first_dup, min(busy_in) AS busy_in FROM r JOIN b USING (url) GROUP BY pos""")
def queue_dup(spark, d):
    c = F.col("c_custkey")
    req = table(spark, d, "customer").select(c.alias("pos"), F.array(F.concat(F.lit("u"), c.cast("string")), F.concat(F.lit("u"), (c * 2).cast("string"))).alias("urls"))
    return G.queue_dup(req, queue(spark, d))


@R.add("queue_positions", "SELECT o_orderkey AS queue_id, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'")
def queue_positions(spark, d):
    return G.queue_positions(queue(spark, d)).select("queue_id", "position")


@R.add("apply_anchor_changes", """WITH c AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'retire' ELSE 'upsert' END AS action, o_orderkey % 3 AS m, o_custkey * 2 AS k, o_orderkey FROM orders WHERE o_orderkey % 6 <> 5),
  n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1), r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '微星' ELSE '' END AS vendor,
    CASE WHEN p_partkey % 3 = 0 THEN '自营' ELSE '官旗' END AS channel, p_partkey % 9 = 0 AS retired FROM part)
  SELECT 'https://item.jd.com/' || CASE WHEN action = 'upsert' AND m = 1 THEN k + 5000000 ELSE coalesce(p_partkey, k) END || '.html' AS url,
    CASE WHEN action = 'upsert' THEN 'nv' ELSE vendor END AS vendor, CASE WHEN action = 'upsert' AND m = 0 THEN '三方店铺' ELSE channel END AS channel,
    CASE WHEN action = 'retire' THEN true WHEN action = 'upsert' THEN false ELSE retired END AS retired, CASE WHEN action = 'retire' THEN '2024-01-01 r' || seq END AS retired_note
  FROM r FULL JOIN n ON n.k = r.p_partkey WHERE p_partkey IS NOT NULL OR action = 'upsert'""")
def apply_anchor_changes(spark, d):
    k = F.col("o_custkey") * 2
    m = F.col("o_orderkey") % 3

    def link(x, mobile=False):
        return F.concat(F.lit("https://item.m.jd.com/product/" if mobile else "https://item.jd.com/"), x.cast("string"), F.lit(".html?from=a"))

    ch = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 4 == 0, "retire").otherwise("upsert").alias("action"),
        F.when(F.col("o_orderkey") % 6 == 5, "https://shop.example.com/1").when(m == 1, link(k)).otherwise("").alias("original_url"),
        F.when(F.col("o_orderkey") % 6 == 5, "https://shop.example.com/1").when(m == 1, link(k + 5000000)).otherwise(link(k, True)).alias("url"),
        F.lit("nv").alias("vendor"), F.when(m == 0, "三方店铺").alias("channel"), F.lit("2024-01-01").alias("date"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("reason"))
    return G.apply_anchor_changes(registry(spark, d).select("url", "vendor", "channel", "retired"), ch)


@R.add("config_drift", """WITH a AS (SELECT p_partkey AS id, p_type AS s FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'X' ELSE p_type END AS s FROM part WHERE p_partkey % 7 <> 0)
  SELECT id, a.s AS declared, b.s AS registered, CASE WHEN b.s IS NULL THEN 'not_registered' WHEN a.s IS NULL THEN 'not_declared' ELSE 'setting_differs' END AS reason
  FROM a FULL JOIN b USING (id) WHERE a.s IS DISTINCT FROM b.s""")
def config_drift(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("setting"))
    b = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "X").otherwise(F.col("p_type")).alias("setting"))
    return G.config_drift(a, b)
