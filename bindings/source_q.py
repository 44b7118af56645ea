"""Readers and writers: the tables are written in the expected file form to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings.base import VENDORS, Registry, day, folders, observations, table
from bindings.entity_q import SQL as ENTITY_SQL, shifted_obs, users
from bindings.obs_q import ROWS, base_rows, raw_observations, shop_rows
from tidemark.plans import snapshot as P
from tidemark.session import shared_dir
from tidemark.sources import readers as S, writers as K

R = Registry()
QUERIES, SQL = R.queries, R.sql


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("read_observations", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS collected_on, count(*) AS n, count(*) FILTER (event_id % 23 = 0) AS n_no_hint,
  count(*) FILTER (event_id % 23 = 10) AS n_text_price FROM events GROUP BY 1""")
def read_observations(spark, d):
    """One folder per date."""
    path = place(spark, "obs")
    raw = raw_observations(spark, d).join(table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d")), "event_id")
    raw.select("d", "identity_hint", "attrs_hint", "low_price", "raw_price", "price_date", "metric", "shop", "in_stock").write.partitionBy("d").json(path)
    back = S.read_observations(spark, path, lines=True)
    return back.groupBy("collected_on").agg(F.count("*").alias("n"), F.count_if(F.col("identity_hint").isNull()).alias("n_no_hint"),
                                            F.count_if(F.col("low_price") == "abc").alias("n_text_price"))


@R.add("read_trend_dump", """SELECT c_custkey AS listing, count(DISTINCT o_orderdate) AS n_points, min(o_totalprice) AS low FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def read_trend_dump(spark, d):
    """Fifty listings to a dump file."""
    path = place(spark, "dump")
    # one point per day, so that a listing's points are bounded by the calendar
    daily = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("k"), F.min("o_totalprice").alias("low"))
    o = daily.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("["), F.col("k").cast("string"), F.lit(","), F.col("low").cast("string"), F.lit(',"x"]'))), ",").alias("p"))
    c = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    listing = F.struct(F.struct(F.lit("c").alias("category"), F.col("c_name").alias("series")).alias("identity"), F.col("c_custkey").cast("string").alias("url"),
                       F.struct(F.coalesce("p", F.lit("")).alias("datePrice")).alias("trend"))
    dumps = c.groupBy(F.floor(F.col("c_custkey") / 50).alias("f")).agg(F.collect_list(listing).alias("listings"))
    dumps.select(F.to_json(F.struct(F.lit("2024-01-01").alias("fetched_at"), "listings")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = S.read_trend_dump(spark, path)
    return rows.select(F.col("url").cast("long").alias("listing"), F.size("points").cast("long").alias("n_points"), F.array_min(F.transform("points", lambda p: p["price"])).alias("low"))


@R.add("read_sources", """SELECT 't' || s_suppkey AS task_id, pos, CASE pos WHEN 0 THEN 'a' ELSE 'b' END AS source_id, CASE pos WHEN 0 THEN s_name ELSE s_name || '"q' END AS title, NULL AS issue
    FROM supplier, (VALUES (0::INT), (1::INT)) v(pos) WHERE s_suppkey % 5 <> 1 AND (pos = 0 OR s_suppkey % 5 <> 3)
  UNION ALL SELECT 't' || s_suppkey, NULL, NULL, NULL, 'sources_json_invalid' FROM supplier WHERE s_suppkey % 5 = 1""")
def read_sources(spark, d):
    """A folder per task, named as the file would be."""
    path = place(spark, "src")
    k, name = F.col("s_suppkey"), F.col("s_name")
    two = F.to_json(F.array(F.struct(F.lit("a").alias("id"), F.lit(None).cast("string").alias("source_id"), name.alias("title")), F.struct(F.lit(None).cast("string").alias("id"), F.lit("b").alias("source_id"), F.concat(name, F.lit('"q')).alias("title"))))
    one = F.to_json(F.array(F.struct(F.lit("a").alias("id"), name.alias("title"))))
    body = F.when(k % 5 == 0, F.concat(F.lit('{"sources":'), two, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit('[{"id":"'), name, F.lit('""]'))).when(k % 5 == 3, one).otherwise(F.concat(F.lit('{"items":'), two, F.lit("}")))
    folders(table(spark, d, "supplier").select(body.alias("value"), F.concat(F.lit("t"), k.cast("string"), F.lit(".sources.json")).alias("f")), "f").text(path)
    rows, issues = S.read_sources_claims(spark, f"{path}/*", "sources")
    return rows.select("task_id", "pos", "source_id", "title", F.lit(None).cast("string").alias("issue")).unionByName(
        issues.select("task_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("title"), "issue"))


@R.add("read_event_log", """SELECT user_id % 10 AS plan, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY 1""")
def read_event_log(spark, d):
    path = place(spark, "log")
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
                                         (F.col("user_id") % 10).cast("string").alias("plan_id"), F.col("event_type").alias("to_s"), F.col("props").alias("payload"))
    e.write.json(path)
    return S.read_event_log(spark, path).groupBy(F.col("plan_id").cast("long").alias("plan")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@R.add("parse_screen_nodes", """SELECT event_id // 40 AS screen_id, row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) - 1 AS pos, CAST(event_id % 500 AS INT) AS y1, CAST(event_id % 500 + 9 AS INT) AS y2,
  CAST(3 AS INT) AS x1, CASE WHEN event_id % 3 = 0 THEN 'd' || event_type ELSE event_type END AS val FROM events QUALIFY event_id % 11 <> 0""")
def parse_screen_nodes(spark, d):
    k = F.col("event_id")
    text = F.when((k % 3 == 0) | (k % 11 == 0), "​").otherwise(F.concat(F.lit("​"), "event_type"))
    desc = F.when(k % 11 == 0, "").when(k % 3 == 0, F.concat(F.lit("d"), "event_type")).otherwise("x")
    node = F.concat(F.lit('<node index="1" text="'), text, F.lit('" class="a" content-desc="'), desc, F.lit('" bounds="[3,'), (k % 500).cast("string"), F.lit("][9,"), (k % 500 + 9).cast("string"), F.lit(']"/>'))
    xml = table(spark, d, "events").groupBy(F.floor(k / 40).alias("screen_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", node.alias("n")))), lambda s: s["n"]), "\n").alias("xml"))
    return S.parse_screen_nodes(xml).select("screen_id", F.col("pos").cast("long").alias("pos"), "y1", "y2", "x1", "val")


@R.add("read_screen_nodes", """SELECT 'kw_s' || (s_suppkey // 4) AS screen_id, row_number() OVER (PARTITION BY s_suppkey // 4 ORDER BY s_suppkey) - 1 AS pos, CAST(s_suppkey % 500 AS INT) AS y1, s_name AS val FROM supplier""")
def read_screen_nodes(spark, d):
    """Screen files of four nodes."""
    path = place(spark, "screen")
    k = F.col("s_suppkey")
    node = F.concat(F.lit('<node text="'), "s_name", F.lit('" content-desc="" bounds="[3,'), (k % 500).cast("string"), F.lit("][9,"), (k % 500 + 9).cast("string"), F.lit(']"/>'))
    xml = table(spark, d, "supplier").groupBy(F.floor(k / 4).alias("s")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", node.alias("n")))).alias("n"))
    folders(xml.select(F.array_join(F.transform("n", lambda x: x["n"]), "\n").alias("value"), F.concat(F.lit("kw_s"), F.col("s").cast("string"), F.lit(".xml")).alias("f")), "f").text(path)
    return S.read_screen_nodes(spark, f"{path}/*").select("screen_id", F.col("pos").cast("long").alias("pos"), "y1", "val")


@R.add("read_ocr_words", """SELECT 'p' || n_nationkey || '.json' AS page_id, CAST(c_custkey % 300 AS INT) AS y, CAST(c_custkey AS INT) AS x, c_name AS text FROM customer JOIN nation ON n_nationkey = c_custkey % 25""")
def read_ocr_words(spark, d):
    """A page per nation."""
    path = place(spark, "ocr")
    w = F.struct(F.concat(F.lit(" "), "c_name").alias("Text"), F.struct((F.col("c_custkey") % 300).alias("Top"), F.col("c_custkey").alias("Left")).alias("BoundingRect"))
    pages = table(spark, d, "customer").groupBy((F.col("c_custkey") % 25).alias("n")).agg(F.to_json(F.struct(F.collect_list(w).alias("Words"))).alias("value"))
    pages.select("value", F.concat(F.lit("p"), F.col("n").cast("string"), F.lit(".json")).alias("f")).write.partitionBy("f").text(path)
    return S.read_ocr_words(spark, f"{path}/*").select("page_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "text")


@R.add("ocr_text_values", r"""SELECT page_id, md5('a' || page_id || '|' || 'b"q' || CASE WHEN trim(html, ' ') = '' THEN '' ELSE '|' || trim(html, ' ') END) AS digest FROM pages""")
def ocr_text_values(spark, d):
    """The page's own html among the values, as JSON text."""
    p = table(spark, d, "pages")
    html = F.substring(F.to_json(F.struct(F.col("html").alias("Text"))), 2, 1_000_000_000)
    body = F.concat(F.lit('{"k":[{"Text": "a'), F.col("page_id").cast("string"), F.lit('","w":{"Text":" "}},{"Text":"b\\"q"},{'), html, F.lit("]}"))
    # values come back as they stand in the JSON text
    values = F.transform(S.all_text_values(body), lambda v: F.get_json_object(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "$.v"))
    return p.select("page_id", F.md5(F.array_join(values, "|").cast("binary")).alias("digest"))


@R.add("source_lists", """SELECT doc_id AS task_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'sources_json_invalid' WHEN 2 THEN 'sources_json_bad_shape' ELSE NULL END AS issue,
  CASE doc_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS n FROM documents""")
def source_lists(spark, d):
    k = F.col("doc_id")
    body = (F.when(k % 5 == 0, '{"sources":[{"id":"a"},{"source_id":"b"},5]}').when(k % 5 == 1, '[{"id":"a", "t": "A"x""}]').when(k % 5 == 2, '{"other":[]}')
            .when(k % 5 == 3, '[{"id":"a"}]').otherwise('{"items":[{"id":"a"},{"id":"b"}]}'))
    t = table(spark, d, "documents").select(k.alias("task_id"), body.alias("body"))
    items = S.parse_wrapped_list(F.col("body"), "sources")
    issue = S.list_issue(F.col("body"), items)
    return t.select("task_id", issue.alias("issue"), F.when(issue.isNull(), F.size(items)).otherwise(0).alias("n"))


@R.add("artifact_manifest", r"""WITH l AS (SELECT lang, doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS line FROM documents)
  SELECT lang, count(*) AS n_docs, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes, count(*) - count(DISTINCT doc_id % 4) AS rows, count(DISTINCT doc_id % 4) AS n_files FROM l GROUP BY 1""")
def artifact_manifest(spark, d):
    path = place(spark, "man")
    docs = table(spark, d, "documents").select("lang", F.regexp_replace("text", r"[\r\n]+", " ").alias("value"), (F.col("doc_id") % 4).alias("part"))
    docs.repartition("lang", "part").write.partitionBy("lang", "part").text(path)
    m = S.artifact_manifest(spark, f"{path}/*/*")
    m = m.withColumn("lang", F.regexp_extract("path", "lang=([^/]+)", 1))
    return m.groupBy("lang").agg((F.sum("rows") + F.count("*")).alias("n_docs"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("n_files"))


@R.add("file_hashes", r"""WITH f AS (SELECT doc_id % 5 AS part, string_agg(md5(text) || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1) SELECT CAST(part AS INT) AS part, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM f""")
def file_hashes(spark, d):
    path = place(spark, "sha")
    docs = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("value"), (F.col("doc_id") % 5).alias("part"), "doc_id")
    docs.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    return S.file_hashes(spark, f"{path}/*").select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), "bytes", "sha256")


@R.add("report_catalog", """SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS n_files, 'Report' AS label FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS d, o_orderpriority FROM orders)
  GROUP BY d ORDER BY 1 DESC LIMIT 5""")
def report_catalog(spark, d):
    path = place(spark, "cat")
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-01").alias("day"), "o_orderpriority").distinct()
    o.select(F.lit("x").alias("value"), "o_orderpriority", "day").repartition("o_orderpriority", "day").write.partitionBy("o_orderpriority", "day").text(path)
    cat = S.report_catalog(spark, path, 5, {})
    return cat.select("date", F.size("files").cast("long").alias("n_files"), F.when(F.size("files") > 0, "Report").alias("label"))


@R.add("read_market_csv", """SELECT n_name AS market, '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS day FROM nation WHERE n_nationkey % 4 <> 0""")
def read_market_csv(spark, d):
    path = place(spark, "csv")
    n = table(spark, d, "nation")
    n.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("市场"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))).alias("交易日(YYYY-MM-DD)"),
             F.lit(1).alias("价")).write.option("header", True).csv(path)
    return S.read_market_csv(spark, path)


@R.add("upsert_partitions", f"""WITH {ROWS}, b2 AS (SELECT * FROM base), i2 AS (SELECT * FROM inc)
  SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, shop_name, coalesce(i2.lp, b2.lp) AS low_price, coalesce(b2.su, i2.su) AS source_url
  FROM b2 FULL JOIN i2 USING (entity_id, obs_date, shop_name)""")
def upsert_partitions(spark, d):
    path = place(spark, "table")
    base_rows(spark, d).write.partitionBy("obs_date").parquet(path)
    inc = shop_rows(spark, d, "event_id % 3 = 0")
    out = K.upsert_partitions(spark, path, inc)
    out = K.upsert_partitions(spark, path, inc)       # delivered twice, same table
    return out.select("entity_id", day("obs_date"), "shop_name", "low_price", "source_url")


@R.add("prometheus_lines", """WITH m AS (SELECT replace(event_type, 'e', '-') AS name, CAST(user_id % 3 AS VARCHAR) || '"' AS plan_id, CAST(round(value * 100) AS BIGINT) AS v FROM events),
  r AS (SELECT replace(name, '-', '_') AS n, replace(plan_id, '"', '\\"') AS p, count(*) AS c, sum(v) AS s FROM m GROUP BY ALL)
  SELECT 'orchestrator_' || n || '_count{plan_id="' || p || '"} ' || c AS line FROM r UNION ALL SELECT 'orchestrator_' || n || '_sum{plan_id="' || p || '"} ' || s || '.0000' FROM r
  UNION ALL SELECT 'orchestrator_' || n || '_avg{plan_id="' || p || '"} ' || printf('%.4f', CAST(s AS DOUBLE) / c) FROM r
  UNION ALL SELECT 'orchestrator_tasks{plan_id="' || p || '",status="' || st || '"} ' || c FROM (SELECT o_custkey % 3 AS p, CASE o_orderstatus WHEN 'O' THEN 'READY' ELSE 'DONE' END AS st, count(*) AS c FROM orders GROUP BY ALL)
  UNION ALL SELECT 'orchestrator_ready ' || count(*) FILTER (o_orderstatus = 'O') FROM orders""")
def prometheus_lines(spark, d):
    m = table(spark, d, "events").select(F.replace("event_type", F.lit("e"), F.lit("-")).alias("name"), F.concat((F.col("user_id") % 3).cast("string"), F.lit('"')).alias("plan_id"),
                                         F.round(F.col("value") * 100).alias("value"))
    t = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("plan_id"), F.when(F.col("o_orderstatus") == "O", "READY").otherwise("DONE").alias("status"))
    return K.prometheus_lines(m, t)


@R.add("write_snapshot", f"SELECT entity_id, n_periods, label, sales_n_periods, median_pct, stab_action FROM ({ENTITY_SQL['snapshot']})")
def write_snapshot(spark, d):
    path = place(spark, "snap")
    obs = shifted_obs(spark, d).withColumn("anchor", F.lit("销量")).withColumn("entity_id", F.col("entity_id") % 10)
    as_of = F.lit("2024-03-20").cast("date")
    ents = users(spark, d)
    K.write_snapshot(P.compute_snapshot(ents, obs, as_of), P.snapshot_contrast(ents, obs, as_of, ("七彩虹", "微星")), "2024-03-20", path)
    doc = spark.read.schema("entity_id long, default struct<n_periods:long,metrics:struct<label:string>>, sales struct<n_periods:long,stab_risk:struct<median_pct:double>,stab_action:string>").json(f"{path}/date=*/entities")
    return doc.select("entity_id", F.col("default.n_periods").alias("n_periods"), F.col("default.metrics.label").alias("label"), F.col("sales.n_periods").alias("sales_n_periods"),
                      F.col("sales.stab_risk.median_pct").alias("median_pct"), F.col("sales.stab_action").alias("stab_action"))


@R.add("snapshot_contrast_files", ENTITY_SQL["snapshot_contrast"])
def snapshot_contrast_files(spark, d):
    """The contrast rows of a written snapshot."""
    path = place(spark, "snap")
    ents, obs, as_of = users(spark, d), observations(spark, d).withColumn("entity_id", F.col("entity_id") % 10), F.lit("2024-12-31").cast("date")
    K.write_snapshot(P.compute_snapshot(ents, obs, as_of), P.snapshot_contrast(ents, obs, as_of, VENDORS), "2024-12-31", path)
    return spark.read.schema("entity_id long, vendor string, last_price double, slope_7_pct_per_day double, label string, spread_pct double").json(f"{path}/date=*/contrasts")


@R.add("write_evidence_set", """SELECT o_custkey % 50 AS task_id, o_orderkey AS claim_id FROM orders WHERE o_orderkey % 17 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
  OR (o_orderkey % 3 = 0 AND NOT (o_orderkey % 2000 IN (SELECT c_custkey FROM customer) AND o_orderkey % 2000 % 50 = o_custkey % 50))""")
def write_evidence_set(spark, d):
    from bindings.evidence_q import claim_sources, claims
    path = place(spark, "evid")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("task_id"), "text")
    return K.write_evidence_set(claim_sources(spark, d), claims(spark, d), t, t, path)


@R.add("evidence_set_files", """SELECT 'claims' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'sources', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
  UNION ALL SELECT 'report', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents UNION ALL SELECT 'tuning', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents""")
def evidence_set_files(spark, d):
    """The four sets as they were written."""
    from bindings.evidence_q import claim_sources, claims
    path = place(spark, "evid")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("task_id"), "text")
    K.write_evidence_set(claim_sources(spark, d), claims(spark, d), t, t, path)
    parts = [(n, spark.read.schema(s).json(f"{path}/{n}").select(v.alias("v"))) for n, s, v in (
        ("claims", "claim_id long", F.col("claim_id")), ("sources", "source_id long", F.col("source_id")), ("report", "text string", F.length("text")), ("tuning", "text string", F.length("text")))]
    rows = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("v").cast("long").alias("total")) for n, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@R.add("export_plans", """SELECT o_custkey AS plan_id, count(*) AS n_tasks, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS tasks FROM orders GROUP BY 1
  UNION ALL SELECT c_custkey, 0, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def export_plans(spark, d):
    path = place(spark, "plans")
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("priority"))
    K.write_plans(t, table(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"), "c_name"), path)
    back = spark.read.schema("plan_id long, tasks array<struct<seq:long,task_id:long,status:string,priority:int>>").json(path)
    return back.select("plan_id", F.when(F.col("tasks").isNull(), 0).otherwise(F.size("tasks")).cast("long").alias("n_tasks"),
                       F.array_join(F.transform("tasks", lambda x: x["seq"].cast("string")), ",").alias("tasks"))


@R.add("file_tails", """WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id || ' ' || event_type || ' ' || user_id AS line, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id DESC) AS place FROM events)
  SELECT day, place, line FROM l WHERE place <= 25""")
def file_tails(spark, d):
    """One log file a day; of each the last lines, read from its end."""
    base = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.concat_ws(" ", "event_id", "event_type", "user_id").alias("value"))
    e.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").text(base)
    return S.file_tails(spark, base, 25).select(F.regexp_extract("path", "day=([0-9-]+)", 1).alias("day"), "place", "line")
