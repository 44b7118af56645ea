"""Listing registry and proposals: fill, sync, enrichment, approval, change requests, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.text import brand_of, channel_of
from tidemark.functions.web import norm_product_url
from tidemark.operators.ordered import first_per_key, number_rows

# fixed values: url forms, statuses and channel names of the registry
_NUMERIC_URL = r"item\.jd\.com/\d+\.html$"
_DIRECT = "item.jd.com"
_INDIRECT = "jingfen"
APPROVED, PENDING = "通过", "待核"
AUTO_CHANNELS = ("自营", "官旗")
MATCH_NOTE = "search 配对"


def _blank_to(col: Column, other: Column) -> Column:
    return F.coalesce(F.when(col != "", col), other)


def fill_from_registry(dump: DataFrame, registry: DataFrame, fields: Sequence[str], default_source: str) -> DataFrame:
    """Dump rows with empty fields filled by url from the registry; source falls back to the default."""
    reg = registry.select("url", *[F.col(c).alias(f"_r_{c}") for c in (*fields, "source")])
    j = dump.join(reg, "url", "left")
    keep = [c for c in dump.columns if c not in (*fields, "source")]
    return j.select(*keep, *[_blank_to(F.col(c), F.col(f"_r_{c}")).alias(c) for c in fields],
                    _blank_to(F.col("source"), F.coalesce("_r_source", F.lit(default_source))).alias("source"))


def collection_scope(registry: DataFrame, only: str | None = None, urls: Sequence[str] | None = None,
                     source: str | None = None) -> DataFrame:
    """Active registry rows by substring of url or name, exact urls, and source."""
    out = registry.filter(~F.coalesce("retired", F.lit(False)))
    if only:
        out = out.filter(F.contains("url", F.lit(only)) | F.contains("sp_name", F.lit(only)))
    if urls:
        out = out.filter(F.col("url").isin(*urls))
    if source:
        out = out.filter(F.coalesce("source", F.lit(fixed.SALES_SOURCE)) == source)
    return out


def resume_targets(registry: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(still to collect, collected rows whose url is still registered)."""
    return (registry.join(done.select("url").distinct(), "url", "left_anti"),
            done.join(registry.select("url").distinct(), "url", "left_semi"))


def registry_sync(registry: DataFrame, proposals: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Action per approved proposal: add, update (vendor or channel differ), dup, skip_bad, skip_jf."""
    p = proposals.filter(F.col("status") == APPROVED)
    url = F.coalesce("url", F.lit(""))
    vendor = brand_of(F.concat(F.coalesce("sp_name", F.lit("")), F.coalesce("vendor", F.lit(""))), brands)
    p = p.withColumn("_vendor", vendor).withColumn(
        "_channel", _blank_to(F.col("channel"), F.lit("待核"))).withColumn(
        "_source", F.when(F.contains(F.coalesce("match_note", F.lit("")), F.lit(MATCH_NOTE)), "gwdang"))
    reg = registry.select("url", F.col("vendor").alias("_rv"), F.col("channel").alias("_rc"), F.lit(True).alias("_have"))
    j = p.join(reg, "url", "left")
    action = (F.when(~F.contains(url, F.lit(_DIRECT)), "skip_jf").when(~F.rlike(url, F.lit(_NUMERIC_URL)), "skip_bad")
              .when(F.col("_have").isNull(), "add")
              .when(~F.col("_rv").eqNullSafe(F.col("_vendor")) | ~F.col("_rc").eqNullSafe(F.col("_channel")), "update")
              .otherwise("dup"))
    return j.select("pos", "url", F.col("_vendor").alias("vendor"), F.col("_channel").alias("channel"),
                    F.col("_source").alias("source"), action.alias("action"))


def enrich_proposals(proposals: DataFrame, product_info: DataFrame) -> DataFrame:
    """Approved proposals without a canonical url joined to product info by sku.

    A shop name gives vendor and channel, a numeric source id the canonical url; no shop means a person
    has to look (outcome `skipped`).
    """
    todo = proposals.filter((F.col("status") == APPROVED)
                            & (F.contains(F.coalesce("url", F.lit("")), F.lit(_INDIRECT))
                               | (F.col("sku").isNotNull() & ~F.rlike(F.coalesce("url", F.lit("")), F.lit(_NUMERIC_URL)))))
    j = todo.join(product_info.select("sku", "shop_name", "source_sku"), "sku", "left")
    shop = F.trim(F.coalesce("shop_name", F.lit("")))
    canonical = F.when(F.rlike(F.coalesce("source_sku", F.lit("")), F.lit(r"^\d+$")),
                       F.format_string("https://item.jd.com/%s.html", "source_sku"))
    fallback = F.when(F.contains(F.coalesce("url", F.lit("")), F.lit(_DIRECT)), F.col("url")).otherwise(
        F.format_string("https://item.jd.com/%s.html", "sku"))
    ok = shop != ""
    return j.select("pos", "sku", F.when(ok, F.coalesce(canonical, fallback)).otherwise(F.col("url")).alias("url"),
                    F.when(ok, shop).otherwise(F.col("vendor")).alias("vendor"),
                    F.when(ok, channel_of(shop)).otherwise(F.col("channel")).alias("channel"),
                    F.when(ok, "done").otherwise("skipped").alias("outcome"))


def anchor_board(registry: DataFrame, entities: DataFrame, obs: DataFrame) -> DataFrame:
    """Registry rows with their entity (by identity equality) and its number of observations."""
    ident = ["category", "series", "spec"]
    ids = entities.groupBy(*ident).agg(F.min("entity_id").alias("entity_id"))
    n = obs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("points"))
    return (registry.join(ids, ident, "left").join(n, "entity_id", "left")
            .withColumn("points", F.coalesce("points", F.lit(0).cast("long"))))


def latest_picture(dumps: DataFrame) -> DataFrame:
    """Pictures of the newest dump date that has any: identity key -> first picture url in the payload.

    dumps: date, pos, category, series, spec, payload (JSON text); the last listing of an identity wins.
    """
    key = F.lower(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("category", "series", "spec")]))
    pic = F.regexp_extract("payload", r'"spPic"\s*:\s*"([^"]+)"', 1)
    rows = dumps.select(key.alias("identity_key"), "date", "pos", pic.alias("pic")).filter("pic <> ''")
    newest = rows.agg(F.max("date")).scalar()
    return (rows.filter(F.col("date") == newest).groupBy("identity_key")
            .agg(F.max_by("pic", "pos").alias("pic"), F.max("date").alias("date")))


def replace_proposals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New proposals replace pending ones of the same identity and anchor."""
    key = ["identity_key", "anchor"]
    newest = first_per_key(new, key, [F.col("pos").desc()])
    return existing.join(newest.select(*key), key, "left_anti").unionByName(newest)


def approve_proposals(proposals: DataFrame, approved_keys: DataFrame) -> DataFrame:
    """Batch approval touches every duplicate; safe channels with a vendor approve themselves."""
    hit = approved_keys.select("identity_key", "anchor", F.lit(True).alias("_hit")).distinct()
    j = proposals.join(hit, ["identity_key", "anchor"], "left")
    auto = ((F.col("status") == PENDING) & F.col("channel").isin(*AUTO_CHANNELS)
            & (F.coalesce("vendor", F.lit("")) != ""))
    status = F.when(F.coalesce("_hit", F.lit(False)) | auto, APPROVED).otherwise(F.col("status"))
    return j.withColumn("status", status).drop("_hit")


def queue_dup(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """Requested urls (pos, urls array) that are already queued or running."""
    busy = (queue.filter(F.col("status").isin("queued", "running")).select(F.explode("urls").alias("url"), "queue_id")
            .groupBy("url").agg(F.min("queue_id").alias("busy_in")))
    return requests.select("pos", F.explode("urls").alias("url")).join(busy, "url").groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_dup"), F.min("url").alias("first_dup"), F.min("busy_in").alias("busy_in"))


def queue_positions(queue: DataFrame) -> DataFrame:
    """1-based place of every queued entry in id order."""
    return number_rows(queue.filter("status = 'queued'"), "queue_id", "position")


def apply_anchor_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert and retire by original url; the newest change of a url wins, retired rows stay with a reason.

    changes: seq, action (upsert / retire), original_url, url, vendor, channel, date, reason.
    """
    ch = first_per_key(changes.withColumn("_key", norm_product_url(F.coalesce(
        F.when(F.col("original_url") != "", F.col("original_url")), F.col("url")))).filter("_key is not null"),
        ["_key"], [F.col("seq").desc()])
    ch = ch.select("_key", "action", norm_product_url(F.col("url")).alias("_url"), F.col("vendor").alias("_v"),
                   F.col("channel").alias("_c"), F.col("date").alias("_d"), F.col("reason").alias("_why"))
    mine = registry.withColumnRenamed("url", "_key").withColumn("_known", F.lit(True))
    j = mine.join(ch, "_key", "full_outer")
    up, gone = F.col("action").eqNullSafe("upsert"), F.col("action").eqNullSafe("retire")
    return j.filter(F.col("_known").eqNullSafe(True) | up).select(
        F.when(up, F.coalesce("_url", "_key")).otherwise(F.col("_key")).alias("url"),
        F.when(up, F.coalesce("_v", "vendor")).otherwise(F.col("vendor")).alias("vendor"),
        F.when(up, F.coalesce("_c", "channel")).otherwise(F.col("channel")).alias("channel"),
        F.when(gone, F.lit(True)).when(up, F.lit(False)).otherwise(F.col("retired")).alias("retired"),
        F.when(gone, F.concat_ws(" ", "_d", "_why")).alias("retired_note"))


def config_drift(declared: DataFrame, registered: DataFrame) -> DataFrame:
    """Jobs on one side only, or with different settings (id, setting)."""
    a = declared.select("id", F.col("setting").alias("declared"), F.lit(True).alias("_a"))
    b = registered.select("id", F.col("setting").alias("registered"), F.lit(True).alias("_b"))
    reason = (F.when(F.col("_b").isNull(), "not_registered").when(F.col("_a").isNull(), "not_declared")
              .when(~F.col("declared").eqNullSafe(F.col("registered")), "setting_differs"))
    return (a.join(b, "id", "full_outer").withColumn("reason", reason).filter("reason is not null")
            .select("id", "declared", "registered", "reason"))
