"""Search results to graded, traceable evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.dates import parse_any_date
from tidemark.functions.web import domain_of, host_suffixes
from tidemark.operators.ordered import first_per_key, running_sum

_FLAT = "struct<results:array<struct<title:string,url:string,content:string,published_date:string>>>"
_BING = ("struct<data:struct<webPages:struct<value:array<struct<name:string,url:string,summary:string,snippet:string,"
         "dateLastCrawled:string,siteName:string>>>>>")
_BLOCK = "struct<type:string,content:string>"
_ITEM = "struct<type:string,title:string,url:string,page_age:string,content:string>"


def _result(title, url, snippet, published):
    blank = F.lit("")
    return F.struct(F.coalesce(title, blank).alias("title"), F.coalesce(url, blank).alias("url"),
                    F.coalesce(snippet, blank).alias("snippet"), published.alias("published_at"))


def parse_search_response(df: DataFrame, provider: str, top_k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Stored provider answers (JSON text in `body`) as result rows, at most top_k per answer.

    provider: `flat` (results[]), `pages` (data.webPages.value[]), `blocks` (tool-result content blocks).
    """
    body = F.col("body")
    if provider == "flat":
        arr = F.transform(F.from_json(body, _FLAT)["results"],
                          lambda r: _result(r["title"], r["url"], r["content"], r["published_date"]))
    elif provider == "pages":
        arr = F.transform(F.from_json(body, _BING)["data"]["webPages"]["value"],
                          lambda r: _result(r["name"], r["url"], F.coalesce(F.when(r["summary"] != "", r["summary"]), r["snippet"]),
                                            r["dateLastCrawled"]))
    elif provider == "blocks":
        content = F.coalesce(F.get_json_object(body, "$.content"), F.lit("[]"))

        def as_list(c):
            return F.when(F.startswith(F.trim(c), F.lit("[")), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))

        blocks = F.filter(F.from_json(as_list(content), f"array<{_BLOCK}>"), lambda b: b["type"] == "web_search_tool_result")
        items = F.flatten(F.transform(blocks, lambda b: F.from_json(as_list(b["content"]), f"array<{_ITEM}>")))
        arr = F.transform(F.filter(items, lambda i: i["type"] == "web_search_result"),
                          lambda r: _result(r["title"], r["url"], r["content"], r["page_age"]))
    else:
        raise ValueError(f"unknown provider shape {provider}")
    rows = df.select(*keys, F.posexplode(F.slice(F.coalesce(arr, F.array()), 1, top_k)).alias("pos", "_r"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "_r.*")


def dedupe_urls(results: DataFrame, keys: Sequence[str] = ("pack_id",), width: int = 1_000_000) -> DataFrame:
    """First result per trimmed url and pack in position order, renumbered src0, src1, ...

    Blank urls count as one url. Numbers come from a chunked running count, so one huge pack is no single task.
    """
    r = results.withColumn("_u", F.trim(F.coalesce("url", F.lit(""))))
    first = first_per_key(r, [*keys, "_u"], ["pos"]).drop("_u")
    n = running_sum(first, keys, ["pos"], F.floor(F.col("pos") / width), F.lit(1), "_n")
    return n.withColumn("source_id", F.concat(F.lit("src"), (F.col("_n") - 1).cast("string"))).drop("_n")


def freshness_reason(published: Column, mode: str, now: Column) -> Column:
    """Why a result is dropped: no date, or older than the mode allows; null when kept."""
    if mode not in fixed.FRESHNESS_DAYS:
        return F.lit(None).cast("string")
    at = parse_any_date(published)
    cutoff = now.cast("timestamp") - F.expr(f"INTERVAL {fixed.FRESHNESS_DAYS[mode]} DAYS")
    return F.when(at.isNull(), "no_published_at").when(at < cutoff, "too_old")


def freshness_filter(results: DataFrame, mode: str, now: Column) -> tuple[DataFrame, DataFrame]:
    tagged = results.withColumn("drop_reason", freshness_reason(F.col("published_at"), mode, now))
    return tagged.filter("drop_reason is null").drop("drop_reason"), tagged.filter("drop_reason is not null")


def _listed(host: Column, domains: Sequence[str]) -> Column:
    """First listed domain that is the host or a parent of it (array_intersect keeps the list order)."""
    known = F.array(*[F.lit(d.lower()) for d in domains])
    return F.get(F.array_intersect(known, host_suffixes(host)), F.lit(0))


def prior_tier(results: DataFrame, official: Sequence[str] = fixed.OFFICIAL_DOMAINS,
               ugc: Sequence[str] = fixed.UGC_DOMAINS) -> DataFrame:
    """Adds prior (A or null) and prior_reason; the lists are configuration, so no join is needed."""
    d = results.withColumn("_host", domain_of(F.col("url")))
    a, u = _listed(F.col("_host"), official), _listed(F.col("_host"), ugc)
    return d.withColumn("prior", F.when(a.isNotNull(), "A")).withColumn(
        "prior_reason", F.coalesce(F.concat(F.lit("official_domain:"), a), F.concat(F.lit("ugc_domain:"), u), F.lit(""))).drop("_host")


def parse_verdict(reply: Column) -> Column:
    """struct(tier, reason) of a judge's reply, null unless tier is A, B or C and the reason is not blank."""
    text = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    v = F.from_json(text, "struct<tier:string,reason:string>")
    tier, reason = F.upper(v["tier"]), F.trim(v["reason"])
    return F.when(tier.isin("A", "B", "C") & (reason != ""), F.struct(tier.alias("tier"), reason.alias("reason")))


def assign_tiers(results: DataFrame, cache: DataFrame, judged: DataFrame) -> DataFrame:
    """Tier per result: domain prior, then cache, then a supplied verdict, then C.

    cache: url, tier, tier_reason, decided_by; judged: url, reply. Both hold one row per url.
    """
    r = prior_tier(results)
    c = cache.select("url", F.col("tier").alias("_ct"), F.col("tier_reason").alias("_cr"), F.col("decided_by").alias("_cd"))
    j = r.join(c, "url", "left").join(judged.select("url", "reply"), "url", "left")
    v = parse_verdict(F.col("reply"))
    prior, cached = F.col("prior").isNotNull(), F.col("_ct").isNotNull()
    no_reply = F.col("reply").isNull()
    tier = F.when(prior, F.col("prior")).when(cached, F.col("_ct")).otherwise(F.coalesce(v["tier"], F.lit("C")))
    reason = (F.when(prior, F.col("prior_reason")).when(cached, F.col("_cr")).when(v.isNotNull(), v["reason"])
              .when(no_reply, "no_llm_default_C")
              .otherwise(F.concat(F.lit("llm_unparseable:"), F.substring("reply", 1, 120))))
    by = (F.when(prior, "domain_prior").when(cached, F.concat(F.coalesce("_cd", F.lit("")), F.lit("+cache")))
          .when(v.isNull(), "fallback").when(F.col("prior_reason") != "", "llm_ugc").otherwise("llm"))
    return j.select(*results.columns, tier.alias("tier"), reason.alias("tier_reason"), by.alias("decided_by"))


def cache_writeback(tiers: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache after a run: fresh and prior decisions replace old rows of the same url."""
    new = (tiers.filter(~F.endswith("decided_by", F.lit("+cache")))
           .groupBy("url").agg(F.min(F.struct("tier", "tier_reason", "decided_by")).alias("_v")).select("url", "_v.*"))
    return cache.join(new.select("url"), "url", "left_anti").unionByName(new)


def traceability(claims: DataFrame, sources: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Adds `bad` to claims: no source id at all, or one that is unknown."""
    ids = sources.select(*keys, F.col("source_id").alias("_sid"), F.lit(True).alias("_known")).distinct()
    x = claims.select(*keys, "claim_id", F.explode_outer("source_ids").alias("_sid"))
    return (x.join(ids, [*keys, "_sid"], "left").groupBy(*keys, "claim_id")
            .agg(F.bool_or(F.col("_sid").isNull() | F.col("_known").isNull()).alias("bad")))


def bad_urls(sources: DataFrame) -> DataFrame:
    return sources.filter(~F.rlike(F.coalesce("url", F.lit("")), F.lit("^https?://")))


def research_ratio(sources: DataFrame, keys: Sequence[str] = ("task_id",), form: str = "rule") -> DataFrame:
    """Share of A sources among rows with a reason; the report form is stricter than the rule form."""
    counted = F.trim(F.coalesce("tier_reason", F.lit(""))) != ""
    st, t = F.coalesce("source_tier", F.lit("")), F.col("tier")
    is_a = ((st == "A") & (t.isNull() | (t == "A"))) if form == "report" else ((st == "A") | t.eqNullSafe("A"))
    n, a = F.count_if(counted), F.count_if(counted & is_a)
    return sources.groupBy(*keys).agg(a.alias("n_a"), n.alias("n_counted"), F.count(F.lit(1)).alias("n_sources"),
                                      F.coalesce(F.try_divide(a, n), F.lit(0.0)).alias("ratio"))


def pack_summary(raw: DataFrame, unique: DataFrame, dropped: DataFrame, tiers: DataFrame,
                 keys: Sequence[str] = ("pack_id",)) -> DataFrame:
    """Counts of a pack from hit to grade, with the A share and whether it meets the bar."""
    keys = list(keys)
    out = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_count"))
    parts = [unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_count")),
             dropped.groupBy(*keys).agg(F.count_if(F.col("drop_reason") == "no_published_at").alias("dropped_no_date"),
                                        F.count_if(F.col("drop_reason") == "too_old").alias("dropped_too_old")),
             tiers.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("tier") == "A").alias("_a"))]
    for p in parts:
        out = out.join(p, keys, "left")
    out = out.fillna(0)
    ratio = F.coalesce(F.try_divide(F.col("_a"), F.col("kept")), F.lit(0.0))
    return out.withColumn("a_ratio", F.round(ratio, 4)).withColumn("meets_bar", ratio >= fixed.A_TIER_BAR).drop("_a")


def analysis_context(tiers: DataFrame, keys: Sequence[str] = ("pack_id",), head: str = fixed.CONTEXT_HEAD, foot: str = fixed.CONTEXT_FOOT) -> DataFrame:
    """One text per pack: graded results in order with clipped snippets between a head and a foot."""
    line = F.concat(F.lit("- ["), "tier", F.lit("] "), "title", F.lit("\n  "), "url", F.lit("\n  分级理由: "), "tier_reason",
                    F.lit("\n  片段: "), F.substring(F.coalesce("snippet", F.lit("")), 1, 400))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("l"))))
    body = F.array_join(F.transform(ordered, lambda s: s["l"]), "\n")
    return tiers.groupBy(*keys).agg(F.concat_ws("\n", F.lit(head), body, F.lit(foot)).alias("context"))
