"""Observation intake: parsing, validation, merging, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, day, table
from tidemark import fixed
from tidemark.operators import observations as O, registry as G, validate as V

R = Registry()
QUERIES, SQL = R.queries, R.sql
C = fixed.HARDWARE_CONTRACT


def raw_observations(spark, d):
    """events as inbound rows; event_id mod 23 plants one defect of every kind."""
    e = table(spark, d, "events").withColumn("m", F.col("event_id") % 23)
    return e.select(
        "event_id", F.col("event_id").alias("pos"), F.lit("2024-01-20").alias("collected_on"),
        F.expr("CASE WHEN m = 0 THEN NULL WHEN m = 1 THEN map('category', '显卡', 'series', event_type) ELSE "
               "map('category', '显卡', 'series', event_type, 'spec', '8g', 'note', 'x') END").alias("identity_hint"),
        F.expr("map_filter(map('condition', CASE WHEN m = 4 THEN '全新新' ELSE '全新' END, 'channel', CASE WHEN m = 3 THEN '' "
               "WHEN m BETWEEN 5 AND 8 THEN '京东自营' ELSE '国行单卡' END, 'source', '自采', 'promo_event', '店庆', 'color', "
               "CASE WHEN m = 2 THEN 'red' END), (k, v) -> v IS NOT NULL)").alias("attrs_hint"),
        F.expr("CASE m WHEN 9 THEN '-5' WHEN 10 THEN 'abc' WHEN 11 THEN 'NaN' ELSE CAST(value AS STRING) END").alias("low_price"),
        F.expr("CASE WHEN m = 12 THEN '0' END").alias("raw_price"),
        F.expr("CASE WHEN m = 13 THEN '2024/1/1' ELSE date_format(ts, 'yyyy-MM-dd') END").alias("price_date"),
        F.expr("CASE WHEN m = 15 THEN 'rent' END").alias("metric"),
        F.expr("named_struct('name', CASE WHEN m = 14 THEN '' ELSE 'shop' || user_id END, 'platform', '京东', 'url', 'u')").alias("shop"),
        F.expr("CAST(array() AS array<struct<name:string,amount:double,threshold:double,expire:string>>)").alias("coupons"),
        F.lit(True).alias("in_stock"), F.lit("s").alias("source_url"), F.lit("A").alias("source_tier"))


REASON = """CASE WHEN m = 0 THEN 'no_identity_hint' WHEN m = 1 THEN 'identity_keys_missing:[''spec'']'
  WHEN m = 2 THEN 'unknown_attr_key:[''color'']' WHEN m = 3 THEN 'missing_required_attr:channel'
  WHEN m = 4 THEN 'attr_value_not_allowed:condition=全新新' WHEN m = 10 THEN 'bad_price:not_a_number'
  WHEN m IN (9, 11, 12) OR value <= 0 THEN 'bad_price:out_of_domain'
  WHEN m = 13 THEN 'bad_date:''2024/1/1'''
  WHEN CAST(ts AS DATE) > DATE '2024-01-20' THEN 'date_after_collection:' || CAST(CAST(ts AS DATE) AS VARCHAR) || '>2024-01-20'
  WHEN m = 14 THEN 'missing_shop_fields' WHEN m = 15 THEN 'unknown_metric:rent' END"""
TAGGED = f"tagged AS (SELECT *, {REASON} AS reason FROM (SELECT *, event_id % 23 AS m FROM events))"


@R.add("validate_observations", f"WITH {TAGGED} SELECT event_id, reason FROM tagged")
def validate_observations(spark, d):
    return V.tag_observations(raw_observations(spark, d), C).select("event_id", "reason")


@R.add("shape_observations", f"""WITH {TAGGED} SELECT event_id AS pos, event_type AS series, '8GB' AS spec,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS obs_date, value AS low_price, CASE WHEN m BETWEEN 5 AND 8 THEN '自营' ELSE '国行单卡' END
  AS channel, '店庆' AS promo FROM tagged WHERE reason IS NULL""")
def shape_observations(spark, d):
    s = V.shape_observations(V.tag_observations(raw_observations(spark, d), C), C)
    return s.select("pos", F.col("identity.series").alias("series"), F.col("identity.spec").alias("spec"), day("obs_date"),
                    "low_price", "channel", F.col("attrs")["promo_event"].alias("promo"))


@R.add("ingest_stats", f"""WITH {TAGGED} SELECT
  count(*) FILTER (reason IS NULL AND user_id % 9 <> 0 AND event_id % 2 = 0) AS ok,
  count(*) FILTER (reason IS NULL AND user_id % 9 <> 0 AND event_id % 2 = 1) AS updated,
  count(*) FILTER (reason IS NULL AND user_id % 9 = 0) AS no_entity, count(*) FILTER (reason IS NOT NULL) AS bad_row,
  count(*) FILTER (reason IS NULL AND user_id % 9 <> 0) AS ingested,
  count(*) FILTER (reason IS NOT NULL OR user_id % 9 = 0) AS isolated FROM tagged""")
def ingest_stats(spark, d):
    who = table(spark, d, "events").select("event_id", "user_id")
    t = V.tag_observations(raw_observations(spark, d), C).join(who, "event_id")
    return O.ingest_stats(t.withColumn("entity_id", F.when(F.col("user_id") % 9 != 0, F.col("user_id")))
                          .withColumn("exists", F.col("event_id") % 2 == 1))


@R.add("reason_histogram", f"""WITH {TAGGED} SELECT split_part(reason, ':', 1) AS reason_kind, count(*) AS n
  FROM tagged WHERE reason IS NOT NULL GROUP BY 1""")
def reason_histogram(spark, d):
    return O.reason_histogram(V.tag_observations(raw_observations(spark, d), C))


@R.add("validate_registry", """SELECT p_partkey, CASE WHEN p_partkey % 11 = 1 THEN 'bad_url' WHEN p_partkey % 11 = 2 THEN 'bad_channel'
  WHEN p_partkey % 11 = 3 THEN 'bad_source' WHEN p_partkey % 11 = 4 THEN 'bad_vendor' WHEN p_partkey % 11 = 5 THEN 'bad_anchor'
  WHEN p_partkey % 11 = 6 THEN 'identity_missing:[''spec'']' END AS reason FROM part WHERE p_partkey % 11 <> 0""")
def validate_registry(spark, d):
    p = table(spark, d, "part").withColumn("m", F.col("p_partkey") % 11)
    rows = p.select(
        "p_partkey", (F.col("m") == 0).alias("retired"),
        F.expr("CASE WHEN m = 6 THEN map('category', 'c', 'series', p_name) ELSE map('category', 'c', 'series', p_name, "
               "'spec', 's') END").alias("identity"),
        F.expr("CASE WHEN m = 1 THEN 'https://item.example.com/1.html' ELSE 'https://item.jd.com/' || p_partkey || '.html' END").alias("url"),
        F.expr("CASE WHEN m = 2 THEN '淘宝' ELSE '自营' END").alias("channel"), F.expr("CASE WHEN m = 3 THEN 'web' END").alias("source"),
        F.expr("CASE WHEN m = 4 THEN '无名' ELSE '微星' END").alias("vendor"), F.expr("CASE WHEN m = 5 THEN '销' ELSE '' END").alias("anchor"))
    return V.validate_registry(rows, C).select("p_partkey", "reason")


@R.add("validate_registry_files", """WITH r AS (SELECT p_partkey // 20 AS file, p_partkey AS pos, CASE WHEN p_partkey % 97 = 1 THEN 'bad_url' WHEN p_partkey % 89 = 2 THEN 'bad_channel' END AS reason,
    p_partkey % 11 = 0 OR p_partkey // 20 % 13 = 5 AS retired FROM part),
  a AS (SELECT file, count(*) FILTER (NOT retired) AS n, arg_min('listing ' || pos || ': ' || reason, pos) FILTER (NOT retired AND reason IS NOT NULL) AS bad FROM r GROUP BY 1)
  SELECT file, n AS n_listings, CASE WHEN file % 7 = 3 THEN 'bad_domain' WHEN file % 7 = 5 THEN 'bad_source' WHEN bad IS NOT NULL THEN bad WHEN n = 0 THEN 'no_usable_listing' END AS reason FROM a""")
def validate_registry_files(spark, d):
    """Registry files of twenty listings, held against a contract that was read from a file."""
    import json
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.contracts import read_contract
    path = f"{shared_dir(spark)}/contract-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(C, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("file", F.floor(k / 20))
    rows = p.select("file", k.alias("pos"), ((k % 11 == 0) | (F.col("file") % 13 == 5)).alias("retired"),
                    F.expr("map('category', 'c', 'series', p_name, 'spec', 's')").alias("identity"),
                    F.when(k % 97 == 1, "https://item.example.com/1.html").otherwise(F.concat(F.lit("https://item.jd.com/"), k.cast("string"), F.lit(".html"))).alias("url"),
                    F.when(k % 89 == 2, "淘宝").otherwise("自营").alias("channel"), F.lit(None).cast("string").alias("source"), F.lit("微星").alias("vendor"), F.lit("").alias("anchor"))
    f = F.col("file")
    files = p.select("file").distinct().select(f, F.when(f % 7 == 3, "homes").otherwise("hardware").alias("domain"), F.when(f % 7 == 5, "web").otherwise("自采").alias("source"))
    return V.validate_registry_files(files, rows, read_contract(spark, path))


@R.add("collapse_daily", """WITH p AS (SELECT user_id, event_id, value, event_type, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events)
  SELECT user_id, CAST(day AS VARCHAR) AS obs_date, min(value) AS price,
    arg_min(event_type, (value, event_id)) AS remark FROM p GROUP BY user_id, day""")
def collapse_daily(spark, d):
    from tidemark.functions.dates import epoch_micros
    e = table(spark, d, "events")
    pts = e.select("user_id", F.floor(epoch_micros(F.col("ts")) / 1000).alias("ts_ms"), F.col("value").alias("price"),
                   F.col("event_type").alias("remark"), F.col("event_id").alias("pos"))
    return O.collapse_daily(pts, ["user_id"]).select("user_id", day("obs_date"), "price", "remark")


@R.add("parse_date_price", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS n_points,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE 1700000000000 + event_id END AS first_ms,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS first_price,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS first_remark FROM events""")
def parse_date_price(spark, d):
    e = table(spark, d, "events")
    ms = (F.col("event_id") + 1700000000000).cast("string")
    body = F.concat(F.lit("["), ms, F.lit(", "), F.col("value").cast("string"), F.lit(', "'), "event_type",
                    F.lit('"], "junk", [5], ["x", "y"], ['), ms, F.lit(", 1.5]"))
    text = (F.when(F.col("event_id") % 4 == 3, F.lit("[1,2,")).when(F.col("event_id") % 2 == 0, body)
            .otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    p = O.parse_date_price(text)
    first = F.get(p, F.lit(0))
    return e.select("event_id", F.size(p).alias("n_points"), first["ts_ms"].alias("first_ms"),
                    first["price"].alias("first_price"), first["remark"].alias("first_remark"))


@R.add("segment_trend", """SELECT o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 0 END AS n_points,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE (CAST(epoch(o_orderdate) AS BIGINT)) * 1000 END AS first_ms,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE round(CAST(floor(o_totalprice) AS BIGINT) / 100, 2) END AS first_price,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 39.14e0 END AS min_price FROM orders""")
def segment_trend(spark, d):
    from tidemark.functions.dates import epoch_micros
    o = table(spark, d, "orders").withColumn("m", F.col("o_orderkey") % 3)
    x = F.floor(epoch_micros(F.col("o_orderdate")) / 1000000).cast("string")
    pt = F.struct(x.alias("x"), F.floor("o_totalprice").cast("string").alias("y"))
    bad = F.struct(F.lit("q").alias("x"), F.lit("1").alias("y"))
    # the first longest segment wins, malformed points are dropped after the choice
    segs = F.when(F.col("m") == 0, F.array(F.struct(F.lit("a").alias("name"), F.array(bad).alias("data")),
                                           F.struct(F.lit("b").alias("name"), F.array(pt, pt, pt).alias("data")))).when(
        F.col("m") == 1, F.array(F.struct(F.lit("a").alias("name"), F.array(pt, bad, pt).alias("data")),
                                 F.struct(F.lit("b").alias("name"), F.array(pt, pt, pt).alias("data"))))
    src = o.select(F.col("o_orderkey").alias("url"), F.lit("499900").alias("current"),
                   F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise("3914").alias("min"), F.lit("5").alias("max"),
                   segs.alias("series"))
    t = O.normalize_segment_trend(src)
    first = F.get("points", F.lit(0))
    return t.select("url", F.size("points").alias("n_points"), first["ts_ms"].alias("first_ms"),
                    F.round(first["price"], 2).alias("first_price"), "min_price")


@R.add("convert_series", """WITH p AS (SELECT user_id, CAST(ts AS DATE) d, min(event_id) AS event_id, min(value) AS value FROM events GROUP BY ALL),
  g AS (SELECT user_id, list(event_id ORDER BY event_id) e, list(value ORDER BY event_id) v,
    list(CASE WHEN event_id % 5 = 0 THEN '国补价' ELSE 'x' END ORDER BY event_id) r FROM p GROUP BY user_id),
  ok AS (SELECT user_id, unnest(e) eid, unnest(v) low_price, unnest(r) remark FROM g WHERE user_id % 10 <> 0)
  SELECT user_id, 'd' || eid AS price_date, low_price, CASE WHEN contains(remark, '国补') THEN '国补' ELSE '无' END AS promo,
    'gwdang' AS source, '黑' AS color, NULL AS error FROM ok
  UNION ALL SELECT user_id, NULL, NULL, NULL, NULL, NULL, 'length_mismatch:' || (len(e) + 1) || '!=' || len(e) FROM g
  WHERE user_id % 10 = 0""")
def convert_series(spark, d):
    # one point per day first: the arrays are bounded by the calendar
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("event_id").alias("event_id"), F.min("value").alias("value"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value", F.when(F.col("event_id") % 5 == 0, "国补价").otherwise("x").alias("r"))))
    g = e.groupBy("user_id").agg(rows.alias("a")).select(
        "user_id", F.transform("a", lambda x: F.concat(F.lit("d"), x["event_id"].cast("string"))).alias("dates"),
        F.transform("a", lambda x: x["value"]).alias("prices"), F.transform("a", lambda x: x["r"]).alias("remarks"))
    dates = F.when(F.col("user_id") % 10 == 0, F.concat("dates", F.array(F.lit("x")))).otherwise(F.col("dates"))
    src = g.select(F.struct("user_id").alias("identity"), dates.alias("dates"), "prices", "remarks",
                   F.lit("全新").alias("condition"), F.lit("自营").alias("channel"), F.lit("gwdang").alias("source"),
                   F.create_map(F.lit("color"), F.lit("黑"), F.lit("source"), F.lit("old")).alias("extra_attrs"),
                   F.struct(F.lit("n").alias("name")).alias("shop"), F.lit("u").alias("source_url"))
    out = O.convert_series(src)
    err = F.col("error").isNotNull()
    return out.select(F.col("identity.user_id").alias("user_id"), "price_date", "low_price",
                      F.when(~err, F.col("attrs_hint")["promo_event"]).alias("promo"),
                      F.when(~err, F.col("attrs_hint")["source"]).alias("source"),
                      F.when(~err, F.col("attrs_hint")["color"]).alias("color"), "error")


def shop_rows(spark, d, keep):
    e = table(spark, d, "events").filter(keep)
    return e.select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"), F.lit("京东").alias("shop_platform"),
                    F.col("event_type").alias("shop_name"), F.col("value").alias("low_price"), F.col("event_id").alias("raw_json"),
                    F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("source_url"), F.col("event_id").alias("pos"))


KEYS = ["entity_id", "obs_date", "shop_platform", "shop_name"]
ROWS = """r AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, event_type AS shop_name, value AS low_price, event_id,
  'u' || event_id AS source_url FROM events), inc AS (SELECT entity_id, obs_date, shop_name, arg_max(low_price, event_id) lp,
  max(event_id) ev, arg_min(source_url, event_id) su, count(*) n FROM r WHERE event_id % 3 = 0 GROUP BY ALL),
  base AS (SELECT entity_id, obs_date, shop_name, arg_min(low_price, event_id) lp, min(event_id) ev,
  arg_min(source_url, event_id) su FROM r WHERE event_id % 3 <> 0 GROUP BY ALL)"""


def base_rows(spark, d):
    from tidemark.operators.ordered import first_per_key
    return first_per_key(shop_rows(spark, d, "event_id % 3 <> 0"), KEYS, ["pos"]).drop("pos")


@R.add("upsert_observations", f"""WITH {ROWS} SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, shop_name,
    coalesce(inc.lp, base.lp) AS low_price, coalesce(inc.ev, base.ev) AS raw_json, coalesce(base.su, inc.su) AS source_url
  FROM base FULL JOIN inc USING (entity_id, obs_date, shop_name)""")
def upsert_observations(spark, d):
    out = O.upsert_observations(base_rows(spark, d), shop_rows(spark, d, "event_id % 3 = 0"))
    return out.select("entity_id", day("obs_date"), "shop_name", "low_price", "raw_json", "source_url")


@R.add("merge_outcomes", f"""WITH {ROWS} SELECT outcome, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT n,
    CASE WHEN base.ev IS NULL THEN 'inserted' ELSE 'updated' END AS outcome
    FROM inc LEFT JOIN base USING (entity_id, obs_date, shop_name)) GROUP BY outcome""")
def merge_outcomes(spark, d):
    m = O.merge_outcomes(base_rows(spark, d), shop_rows(spark, d, "event_id % 3 = 0"))
    return m.groupBy("outcome").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))


@R.add("dedupe_rows", """WITH r AS (SELECT l_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS dt, l_returnflag, l_orderkey * 10 + l_linenumber AS pos, l_partkey, l_linenumber % 2 AS p FROM lineitem)
  SELECT l_suppkey AS shop_name, l_returnflag AS shop_platform, CAST(dt AS VARCHAR) AS obs_date, l_quantity AS low_price, l_partkey AS spec FROM r
  WHERE p = 0 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.p = 1 AND x.l_suppkey = r.l_suppkey AND x.l_quantity = r.l_quantity
    AND x.dt = r.dt AND x.l_returnflag = r.l_returnflag)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, dt, l_quantity ORDER BY pos) = 1""")
def dedupe_rows(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("shop_name"), F.col("l_returnflag").alias("shop_platform"),
        F.to_date("l_shipdate").alias("obs_date"), F.col("l_quantity").alias("low_price"), "l_linenumber", F.col("l_partkey").alias("spec"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    new, old = li.filter("l_linenumber % 2 = 0").drop("l_linenumber"), li.filter("l_linenumber % 2 = 1")
    return O.dedupe_rows(new, old).select("shop_name", "shop_platform", day("obs_date"), "low_price", "spec")


@R.add("append_rows", """SELECT event_type, count(*) AS n, count(tag) AS n_tagged FROM (SELECT event_type, NULL AS tag FROM events
  WHERE event_id % 2 = 0 UNION ALL SELECT event_type, 'new' FROM events WHERE event_id % 2 = 1) GROUP BY event_type""")
def append_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    both = O.append_rows(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1").withColumn("tag", F.lit("new")))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.count("tag").alias("n_tagged"))


RETRY = "r AS (SELECT CAST(o_orderdate AS DATE) AS collected_on, o_orderkey, o_orderkey % 5 <> 0 AS consumed FROM orders)"


@R.add("replay_stats", f"""WITH {RETRY} SELECT CAST(collected_on AS VARCHAR) AS collected_on, count(*) AS replayed,
  count(*) FILTER (consumed) AS ingested, count(*) FILTER (NOT consumed) AS still_isolated, bool_and(consumed) AS removed
  FROM r GROUP BY collected_on""")
def replay_stats(spark, d):
    return O.replay_quarantine(_retried(spark, d))[0].withColumn("collected_on", day("collected_on"))


@R.add("replay_remaining", f"""WITH {RETRY} SELECT o_orderkey FROM r WHERE collected_on IN (SELECT collected_on FROM r
  WHERE NOT consumed)""")
def replay_remaining(spark, d):
    return O.replay_quarantine(_retried(spark, d))[1].select("o_orderkey")


def _retried(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("collected_on"), "o_orderkey",
                                            (F.col("o_orderkey") % 5 != 0).alias("consumed"))


@R.add("replay_intake", f"""WITH {TAGGED}, q AS (SELECT *, strftime(ts, '%Y-%m-%d') AS on_day, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-20' AND reason LIKE 'date_after%' THEN
      CASE WHEN m = 14 THEN 'x' WHEN m = 15 THEN 'x' END ELSE reason END AS why FROM tagged),
  lost AS (SELECT *, why IS NULL AND event_type IN ('view', 'click', 'purchase') AS consumed FROM q WHERE why IS NOT NULL OR event_type NOT IN ('view', 'click'))
  SELECT on_day AS collected_on, count(*) AS replayed, count(*) FILTER (consumed) AS ingested, count(*) FILTER (NOT consumed) AS still_isolated, bool_and(consumed) AS removed FROM lost GROUP BY 1""")
def replay_intake(spark, d):
    """What the first intake could not place goes through validation and resolution again, after an entity was added."""
    from tidemark.plans import intake as P
    raw = raw_observations(spark, d).join(table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), "event_id")
    raw = raw.withColumn("collected_on", F.col("day")).drop("day", "event_id")
    kinds = spark.createDataFrame([(1, "view"), (2, "click"), (3, "purchase")], "entity_id long, series string")
    ents = kinds.select("entity_id", F.lit("显卡").alias("category"), "series", F.lit("8GB").alias("spec"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"))
    _, lost = P.intake(raw, C, ents.filter("entity_id < 3"))
    again = raw.join(lost.select("pos"), "pos", "left_semi")
    return P.replay(again, C, ents)[1]


@R.add("points_drilldown", """SELECT event_id, event_type AS shop_name, value AS low_price, CAST(json_extract_string(props, '$.k') AS INT)
  AS k FROM events WHERE user_id = 7 AND CAST(ts AS DATE) = DATE '2024-01-05'""")
def points_drilldown(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"),
                                         F.col("event_type").alias("shop_name"), F.col("value").alias("low_price"), "props")
    p = O.points_drilldown(e, 7, "2024-01-05")
    return p.select("event_id", "shop_name", "low_price", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.add("latest_artifact", """SELECT o_custkey, CAST(max(o_orderdate) AS VARCHAR)[1:10] AS date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
  FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey""")
def latest_artifact(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("date"), "o_totalprice")
    out = O.latest_nonempty(o, F.col("o_totalprice") > 100000, ["o_custkey"])
    return out.select("o_custkey", F.date_format("date.o_orderdate", "yyyy-MM-dd").alias("date"),
                      F.col("date.o_orderkey").alias("o_orderkey"))


@R.add("fill_from_registry", """SELECT l_orderkey, l_linenumber, l_partkey AS url,
    CASE WHEN l_linenumber % 2 = 0 THEN 'own' ELSE p_name END AS sp_name,
    CASE WHEN l_linenumber % 3 = 0 THEN '微星' ELSE p_brand END AS vendor,
    CASE WHEN p_size % 2 = 0 THEN 'gwdang' ELSE 'manmanmai' END AS source
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def fill_from_registry(spark, d):
    dump = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("url"),
        F.when(F.col("l_linenumber") % 2 == 0, "own").otherwise("").alias("sp_name"),
        F.when(F.col("l_linenumber") % 3 == 0, "微星").alias("vendor"), F.lit(None).cast("string").alias("source"))
    reg = table(spark, d, "part").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("sp_name"),
                                         F.col("p_brand").alias("vendor"),
                                         F.when(F.col("p_size") % 2 == 0, "gwdang").alias("source"))
    return G.fill_from_registry(dump, reg, ["sp_name", "vendor"], "manmanmai")


@R.add("outlier_gate", """WITH RECURSIVE stored AS (SELECT user_id AS e, CAST(ts AS DATE) AS d, min(value) AS price FROM events WHERE event_id % 3 <> 0 GROUP BY ALL),
  inc AS (SELECT event_id, user_id AS e, CAST(ts AS DATE) AS d, CASE WHEN event_id % 21 = 0 THEN value * 10 ELSE value END AS low_price FROM events WHERE event_id % 3 = 0),
  days AS (SELECT e, d, max(price) AS price, max(prices) AS prices FROM (SELECT e, d, price, NULL::DOUBLE[] AS prices FROM stored UNION ALL SELECT e, d, NULL, list(DISTINCT low_price) FROM inc GROUP BY e, d) GROUP BY e, d),
  n AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY d) AS rn FROM days),
  f AS (SELECT e, d, rn, NULL::DOUBLE AS mean, [list_min(list_append(coalesce(prices, []::DOUBLE[]), price))] AS last FROM n WHERE rn = 1 UNION ALL
    SELECT e, d, rn, mean, CASE WHEN low IS NULL THEN last ELSE list_append(last, low)[-7:] END FROM (
      SELECT *, list_min(list_append(CASE WHEN mean IS NULL THEN coalesce(prices, []::DOUBLE[]) ELSE list_filter(coalesce(prices, []::DOUBLE[]), lambda p: abs(p - mean) <= mean * 0.5) END, price)) AS low FROM (
        SELECT n.e, n.d, n.rn, n.price, n.prices, f.last, CASE WHEN len(f.last) = 7 THEN list_sum(f.last) / 7 END AS mean FROM f JOIN n ON n.e = f.e AND n.rn = f.rn + 1)))
  SELECT event_id, low_price, round(mean, 4) AS mean_7, coalesce(abs(low_price - mean) > mean * 0.5, false) AS outlier FROM inc JOIN f USING (e, d)""")
def outlier_gate(spark, d):
    """Prices of every third event meet the series of the others; every seventh of them is planted ten times too high."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"), "value")
    stored = e.filter("event_id % 3 <> 0").groupBy("entity_id", "obs_date").agg(F.min("value").alias("price"))
    new = e.filter("event_id % 3 = 0").select("event_id", "entity_id", "obs_date", F.when(F.col("event_id") % 21 == 0, F.col("value") * 10).otherwise(F.col("value")).alias("low_price"))
    return O.outlier_gate(new, stored).select("event_id", "low_price", F.round("mean_7", 4).alias("mean_7"), "outlier")
