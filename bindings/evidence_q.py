"""Evidence packs over pages, and sources / claims derived from documents, labels, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import Registry, table
from tidemark import fixed
from tidemark.operators import evidence as E

R = Registry()
QUERIES, SQL = R.queries, R.sql

DAY = "strftime(TIMESTAMP '1999-01-01' + page_id * INTERVAL 5 DAY, '%Y-%m-%d')"


def page_results(spark, d):
    """pages as search results: official and forum hosts, repeated urls, blank urls, missing dates."""
    p = table(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id")
    url = F.replace(F.replace("url", F.lit("example.org"), F.lit("gov.cn")), F.lit("example.net"), F.lit("zhihu.com"))
    day = F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), (k * 5).cast("int")), "yyyy-MM-dd")
    return p.select(
        F.floor(k / 50).alias("pack_id"), k.alias("pos"),
        F.when(k % 17 == 0, " ").when(k % 3 == 0, F.regexp_extract(url, "^(https?://[^/]+)", 1)).otherwise(url).alias("url"),
        F.concat(F.lit("t"), k.cast("string")).alias("title"), F.concat(F.lit("s"), F.col("url")).alias("snippet"),
        F.when(k % 7 == 0, None).when(k % 11 == 0, "last year").otherwise(day).alias("published_at"))


RES = rf"""res AS (SELECT page_id // 50 AS pack_id, page_id AS pos, CASE WHEN page_id % 17 = 0 THEN ' ' WHEN page_id % 3 = 0 THEN regexp_extract(u, '^(https?://[^/]+)', 1)
    ELSE u END AS url, 't' || page_id AS title, 's' || url0 AS snippet,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 'last year' ELSE {DAY} END AS published_at
  FROM (SELECT page_id, url AS url0, replace(replace(url, 'example.org', 'gov.cn'), 'example.net', 'zhihu.com') AS u FROM pages)),
  uniq AS (SELECT * EXCLUDE (rn), 'src' || (row_number() OVER (PARTITION BY pack_id ORDER BY pos) - 1) AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY
    pack_id, trim(url) ORDER BY pos) rn FROM res) WHERE rn = 1),
  tag AS (SELECT *, CASE WHEN TRY_CAST(published_at AS DATE) IS NULL THEN 'no_published_at' WHEN CAST(published_at AS DATE) < DATE '2002-01-01' - 730 THEN 'too_old' END AS drop_reason FROM uniq),
  hosted AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\.', '') AS host FROM tag),
  pri AS (SELECT *, CASE WHEN host LIKE '%.gov.cn' THEN 'A' END AS prior, CASE WHEN host LIKE '%.gov.cn' THEN 'official_domain:gov.cn'
    WHEN host LIKE '%.zhihu.com' THEN 'ugc_domain:zhihu.com' ELSE '' END AS prior_reason FROM hosted),
  cache AS (SELECT url, 'B' AS tier, 'seen' AS tier_reason, 'llm' AS decided_by FROM pri GROUP BY url HAVING min(pos) % 4 = 0),
  judged AS (SELECT url, CASE min(pos) % 3 WHEN 0 THEN 'Sure: {{"tier":"b","reason":" fine "}}' WHEN 1 THEN 'cannot say' END AS reply FROM pri GROUP BY url),
  tiers AS (SELECT p.pack_id, p.pos, p.source_id, p.url, p.title, p.snippet, p.drop_reason, CASE WHEN prior IS NOT NULL THEN 'A' WHEN c.url IS NOT NULL THEN 'B'
      WHEN reply LIKE 'Sure%' THEN 'B' ELSE 'C' END AS tier,
    CASE WHEN prior IS NOT NULL THEN prior_reason WHEN c.url IS NOT NULL THEN 'seen' WHEN reply LIKE 'Sure%' THEN 'fine' WHEN reply IS NULL THEN 'no_llm_default_C'
      ELSE 'llm_unparseable:cannot say' END AS tier_reason,
    CASE WHEN prior IS NOT NULL THEN 'domain_prior' WHEN c.url IS NOT NULL THEN 'llm+cache' WHEN reply IS NULL OR reply NOT LIKE 'Sure%' THEN 'fallback'
      WHEN prior_reason <> '' THEN 'llm_ugc' ELSE 'llm' END AS decided_by
    FROM pri p LEFT JOIN cache c ON c.url = p.url LEFT JOIN judged j ON j.url = p.url),
  kept AS (SELECT * FROM tiers WHERE drop_reason IS NULL)"""
NOW = "2002-01-01"


def chain(spark, d):
    """raw -> unique -> kept/dropped -> tiers, as the pipeline runs it."""
    raw = page_results(spark, d)
    uniq = E.dedupe_urls(raw, ["pack_id"], width=100)
    kept, dropped = E.freshness_filter(uniq, "recent", F.lit(NOW))
    per_url = uniq.groupBy("url").agg(F.min("pos").alias("m"))
    cache = per_url.filter("m % 4 = 0").select("url", F.lit("B").alias("tier"), F.lit("seen").alias("tier_reason"), F.lit("llm").alias("decided_by"))
    judged = per_url.select("url", F.when(F.col("m") % 3 == 0, 'Sure: {"tier":"b","reason":" fine "}').when(F.col("m") % 3 == 1, "cannot say").alias("reply"))
    return raw, uniq, kept, dropped, cache, judged




@R.add("parse_search_response", """WITH v(provider, pos) AS (VALUES ('flat', 0), ('flat', 1), ('pages', 0), ('pages', 1), ('blocks', 0), ('blocks', 1))
  SELECT provider, page_id AS query_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 0 THEN 'first' ELSE '' END AS title, CASE WHEN pos = 0 THEN url ELSE 'u2' END AS url,
    CASE WHEN provider = 'pages' AND pos = 1 THEN 'short' WHEN pos = 0 THEN 'text' ELSE '' END AS snippet,
    CASE WHEN pos = 0 THEN '2024-01-0' || (page_id % 9 + 1) END AS published_at FROM pages, v""")
def parse_search_response(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), "url")
    day = F.concat(F.lit("2024-01-0"), (F.col("query_id") % 9 + 1).cast("string"))
    text, none = F.lit("text"), F.lit(None).cast("string")

    def item(a, b, c, e, names):
        return F.struct(*[x.alias(n) for x, n in zip((a, b, c, e), names)])

    n1 = ("title", "url", "content", "published_date")
    flat = F.to_json(F.struct(F.array(item(F.lit("first"), F.col("url"), text, day, n1), item(none, F.lit("u2"), none, none, n1),
                                      item(none, F.lit("u3"), none, none, n1)).alias("results")))
    n2 = ("name", "url", "summary", "dateLastCrawled")
    w1 = item(F.lit("first"), F.col("url"), text, day, n2).withField("snippet", F.lit("x"))
    w2 = item(none, F.lit("u2"), F.lit(""), none, n2).withField("snippet", F.lit("short"))
    bing = F.to_json(F.struct(F.struct(F.struct(F.array(w1, w2, w2).alias("value")).alias("webPages")).alias("data")))
    n3 = ("title", "url", "content", "page_age")
    b = item(F.lit("first"), F.col("url"), text, day, n3).withField("type", F.lit("web_search_result"))
    b2 = item(none, F.lit("u2"), none, none, n3).withField("type", F.lit("web_search_result"))
    other = item(none, F.lit("no"), none, none, n3).withField("type", F.lit("note"))
    first = F.struct(F.lit("web_search_tool_result").alias("type"), F.array(other, b).alias("content"))
    second = F.struct(F.lit("web_search_tool_result").alias("type"), F.array(b2, b2).alias("content"))
    skip = F.struct(F.lit("text").alias("type"), F.array(other).alias("content"))
    blocks = F.to_json(F.struct(F.array(skip, first, second).alias("content")))
    out = None
    for name, body in (("flat", flat), ("pages", bing), ("blocks", blocks)):
        rows = E.parse_search_response(p.withColumn("body", body), name, 2).withColumn("provider", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add("dedupe_urls", f"WITH {RES} SELECT pack_id, pos, url, source_id FROM uniq")
def dedupe_urls(spark, d):
    return chain(spark, d)[1].select("pack_id", "pos", "url", "source_id")


@R.add("freshness_filter", f"WITH {RES} SELECT pack_id, pos, drop_reason FROM tag WHERE drop_reason IS NOT NULL")
def freshness_filter(spark, d):
    return chain(spark, d)[3].select("pack_id", "pos", "drop_reason")


@R.add("freshness_modes", """WITH o AS (SELECT o_orderkey, o_orderdate AS t FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'no_published_at' WHEN t < TIMESTAMP '2000-01-01' - INTERVAL 180 DAY THEN 'too_old' END AS strict,
    CASE WHEN o_orderkey % 13 = 0 THEN 'no_published_at' WHEN t < TIMESTAMP '2000-01-01' - INTERVAL 730 DAY THEN 'too_old' END AS recent FROM o""")
def freshness_modes(spark, d):
    o = table(spark, d, "orders")
    pub = F.when(F.col("o_orderkey") % 13 == 0, "2000").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    now = F.lit("2000-01-01 00:00:00")
    return o.select("o_orderkey", E.freshness_reason(pub, "strict", now).alias("strict"), E.freshness_reason(pub, "recent", now).alias("recent"))


@R.add("prior_tier", f"WITH {RES} SELECT pack_id, pos, prior, prior_reason FROM pri")
def prior_tier(spark, d):
    return E.prior_tier(chain(spark, d)[1]).select("pack_id", "pos", "prior", "prior_reason")


@R.add("assign_tiers", f"WITH {RES} SELECT pack_id, source_id, tier, tier_reason, decided_by FROM kept")
def assign_tiers(spark, d):
    _, _, kept, _, cache, judged = chain(spark, d)
    return E.assign_tiers(kept, cache, judged).select("pack_id", "source_id", "tier", "tier_reason", "decided_by")


@R.add("cache_writeback", f"""WITH {RES}, fresh AS (SELECT url, min((tier, tier_reason, decided_by)) v FROM kept WHERE decided_by NOT LIKE '%+cache' GROUP BY url)
  SELECT url, tier, tier_reason, decided_by FROM cache ANTI JOIN fresh USING (url)
  UNION ALL SELECT url, v[1], v[2], v[3] FROM fresh""")
def cache_writeback(spark, d):
    _, _, kept, _, cache, judged = chain(spark, d)
    return E.cache_writeback(E.assign_tiers(kept, cache, judged), cache)


@R.add("pack_summary", f"""WITH {RES}, a AS (SELECT pack_id, count(*) AS raw_count FROM res GROUP BY 1), b AS (SELECT pack_id, count(*) AS unique_count,
    count(*) FILTER (drop_reason = 'no_published_at') AS dropped_no_date, count(*) FILTER (drop_reason = 'too_old') AS dropped_too_old FROM tag GROUP BY 1),
  c AS (SELECT pack_id, count(*) AS kept, count(*) FILTER (tier = 'A') AS a FROM kept GROUP BY 1)
  SELECT pack_id, raw_count, unique_count, dropped_no_date, dropped_too_old, coalesce(kept, 0) AS kept, round(coalesce(a / kept, 0), 4) AS a_ratio,
    coalesce(a / kept, 0) >= 0.2 AS meets_bar FROM a JOIN b USING (pack_id) LEFT JOIN c USING (pack_id)""")
def pack_summary(spark, d):
    raw, uniq, kept, dropped, cache, judged = chain(spark, d)
    return E.pack_summary(raw, uniq, dropped, E.assign_tiers(kept, cache, judged))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@R.add("analysis_context", f"""WITH {RES} SELECT pack_id, md5({_sql_text(fixed.CONTEXT_HEAD)} || chr(10) || string_agg('- [' || tier || '] ' || title || chr(10) || '  ' || url
    || chr(10) || '  分级理由: ' || tier_reason || chr(10) || '  片段: ' || substring(snippet, 1, 400), chr(10) ORDER BY pos) || chr(10)
    || {_sql_text(fixed.CONTEXT_FOOT)}) AS digest FROM kept GROUP BY pack_id""")
def analysis_context(spark, d):
    _, _, kept, _, cache, judged = chain(spark, d)
    c = E.analysis_context(E.assign_tiers(kept, cache, judged))
    return c.select("pack_id", F.md5(F.col("context").cast("binary")).alias("digest"))


def claims(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("task_id"), k.alias("claim_id"),
        F.when(k % 17 == 0, F.array().cast("array<bigint>")).when(k % 3 == 0, F.array(F.col("o_custkey"), k % 2000))
        .otherwise(F.array("o_custkey")).alias("source_ids"))


def claim_sources(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select((c % 50).alias("task_id"), c.alias("source_id"),
                                              F.when(c % 400 == 7, "ftp://x").otherwise("https://x").alias("url"))


BAD = """bad AS (SELECT o_custkey % 50 AS task_id, o_orderkey AS claim_id, o_orderkey % 17 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
    OR (o_orderkey % 3 = 0 AND NOT (o_orderkey % 2000 IN (SELECT c_custkey FROM customer) AND o_orderkey % 2000 % 50 = o_custkey % 50)) AS bad FROM orders)"""


@R.add("traceability", f"WITH {BAD} SELECT * FROM bad")
def traceability(spark, d):
    return E.traceability(claims(spark, d), claim_sources(spark, d))


@R.add("bad_urls", "SELECT c_custkey AS source_id FROM customer WHERE c_custkey % 400 = 7")
def bad_urls(spark, d):
    return E.bad_urls(claim_sources(spark, d)).select("source_id")


GRADED = """g AS (SELECT source AS task_id, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS source_tier, CASE WHEN doc_id % 4 = 0 THEN 'A' WHEN doc_id % 4 = 1 THEN 'B' END AS tier,
  CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN ' ' ELSE 'r' END AS tier_reason, doc_id FROM documents JOIN labels USING (doc_id))"""


def graded(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    k = F.col("doc_id")
    return j.select(F.col("source").alias("task_id"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("source_tier"),
                    F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").alias("tier"),
                    F.when((F.col("toxic") == 1) | (k % 5 == 0), " ").otherwise("r").alias("tier_reason"), "doc_id")


@R.add("research_ratio", f"""WITH {GRADED} SELECT form, task_id, count(*) FILTER (tier_reason = 'r' AND CASE form WHEN 'rule' THEN source_tier = 'A' OR coalesce(tier, '') = 'A'
    ELSE source_tier = 'A' AND coalesce(tier, 'A') = 'A' END) AS n_a, count(*) FILTER (tier_reason = 'r') AS n_counted, count(*) AS n_sources,
    round(coalesce(count(*) FILTER (tier_reason = 'r' AND CASE form WHEN 'rule' THEN source_tier = 'A' OR coalesce(tier, '') = 'A'
    ELSE source_tier = 'A' AND coalesce(tier, 'A') = 'A' END) / nullif(count(*) FILTER (tier_reason = 'r'), 0), 0), 6) AS ratio
  FROM g, (VALUES ('rule'), ('report')) f(form) GROUP BY form, task_id""")
def research_ratio(spark, d):
    g = graded(spark, d)
    both = [E.research_ratio(g, ["task_id"], f).withColumn("form", F.lit(f)) for f in ("rule", "report")]
    return both[0].unionByName(both[1]).withColumn("ratio", F.round("ratio", 6))
