"""Marketplace listings: title rules, anchors, screen leads, flags, candidates."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed
from tidemark.functions.text import any_word, norm_title, norm_token, parse_price
from tidemark.operators.ordered import first_per_key, top_per_key
from tidemark.session import cut_lineage


#: Least score of a candidate, and what rounding may take from a bound.
SURE, SLIP = 0.40, 1e-9


def match_spec(title: Column, series: Column, spec: Column) -> Column:
    """Title names this series and spec, no suffixed sibling, and no second model."""
    t, s = norm_token(title), norm_token(series)
    rest = F.substr(t, F.instr(t, s) + F.length(s))
    bleed = F.lit(False)
    for suffix in fixed.SERIES_SUFFIXES:
        bleed = bleed | (~F.endswith(s, F.lit(suffix)) & F.startswith(rest, F.lit(suffix)))
    models = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?U)({fixed.PREFIXED_MODEL})"), 1))
    return (F.contains(t, s) & F.contains(t, norm_token(spec)) & ~bleed
            & ~F.rlike(t, F.lit(f"(?U){fixed.ADJACENT_MODELS}")) & (F.size(models) < 2))


def is_bundle(title: Column) -> Column:
    """Whole-machine words, not counting those that only qualify a graphics card."""
    return any_word(F.regexp_replace(F.coalesce(title, F.lit("")), fixed.HOST_WORD_EXEMPT, ""), fixed.HOST_WORDS)


def candidate_reject(title: Column, category: Column) -> Column:
    """Bundles, board words on anything but a board, and pages listing several models."""
    t = norm_title(title)
    board = (F.coalesce(category, F.lit("")) != "") & (category != fixed.BOARD_CATEGORY) & any_word(t, fixed.BOARD_WORDS)
    return any_word(t, fixed.BUNDLE_WORDS) | board | F.rlike(t, F.lit(f"(?U){fixed.MULTI_SKU}"))


@F.pandas_udf(T.DoubleType())
def _similarity(target: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() if a else 0.5 for a, b in zip(target, title)])


def _key_variants(series: Column, aliases: Column) -> Column:
    """Normalised series and aliases, each also without one brand word."""
    base = F.filter(F.concat(F.array(norm_title(series)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), norm_title)),
                    lambda k: k != "")
    less = F.flatten(F.transform(base, lambda k: F.array(*[F.replace(k, F.lit(w), F.lit("")) for w in fixed.BRAND_NOISE])))
    return F.array_distinct(F.filter(F.concat(base, less), lambda k: k != ""))


def _letters(text: Column) -> Column:
    """How often each character stands in a text."""
    return F.transform(F.array_distinct(F.split(text, "")), lambda c: F.struct(c.alias("c"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("n")))


def candidate_bounds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The pairs that pass the filters, with what is known without the similarity: `bonus`, added to it, and `bound`, which the score cannot exceed.

    Two texts have no more in common than the characters of one that the other has as well, each as often as it stands in both.
    """
    t = targets.select("target_id", _key_variants(F.col("series"), F.col("aliases")).alias("_keys"),
                       norm_title(F.col("spec")).alias("_spec"), norm_title(F.col("name")).alias("_target"),
                       F.col("price").alias("_want"), "category").withColumn("_letters", _letters(F.col("_target")))
    ok = rows.filter((F.col("siteid").cast("string") == "1") & (F.coalesce("skuid", F.lit("")) != ""))
    j = ok.join(t, "target_id").withColumn("_title", norm_title(F.col("title")))
    j = j.filter((F.size("_keys") == 0) | F.exists("_keys", lambda k: F.contains("_title", k)))
    j = j.filter(~candidate_reject(F.col("title"), F.col("category")))
    price = parse_price(F.col("price"))
    off = (F.col("_want") > 0) & (price > 0) & (F.abs(price - F.col("_want")) / F.greatest(F.col("_want"), F.lit(1.0)) > 0.25)
    bonus = (F.when((F.col("_spec") != "") & F.contains("_title", F.col("_spec")), 0.15).otherwise(0.0)
             - F.when(F.coalesce(off, F.lit(False)), 0.25).otherwise(0.0))
    la, lb = F.length("_target"), F.length("_title")
    common = F.aggregate("_letters", F.lit(0), lambda n, x: n + F.least(x["n"], lb - F.length(F.replace(F.col("_title"), x["c"], F.lit("")))))
    likely = F.when(F.col("_target") == "", 0.5).otherwise(2 * common / (la + lb))
    j = j.filter((F.col("_target") == "") | (2 * F.least(la, lb) / (la + lb) + 0.15 >= SURE))
    return j.select("target_id", "pos", "skuid", "title", "_target", "_title", bonus.alias("bonus"), (likely + bonus).alias("bound"))


def contenders(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pair of the highest bound of each target with its score, the other pairs whose bound reaches that score): no other can win. Give it a written table, or Spark works out bounds twice."""
    pairs = pairs.filter(F.col("bound") >= SURE - SLIP)
    scored = lambda d: d.withColumn("score", _similarity("_target", "_title") + F.col("bonus"))
    lead = cut_lineage(scored(first_per_key(pairs, ["target_id"], [F.col("bound").desc(), F.col("pos")])))
    rest = pairs.join(lead.select("target_id", F.col("score").alias("_bar"), F.col("pos").alias("_lead")), "target_id").filter((F.col("pos") != F.col("_lead")) & (F.col("bound") >= F.col("_bar") - SLIP))
    return lead, rest.drop("_bar", "_lead")


def match_candidates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Best candidate per target among the rows its search returned.

    rows: target_id, pos, title, siteid, skuid, price; targets: target_id, series, spec, aliases, name, price,
    category. Rows meet only their own target, filters run before the similarity, which is worked out for the likeliest pair of a target first and then for those that could still beat it.
    """
    lead, rest = contenders(cut_lineage(candidate_bounds(rows, targets)))
    scored = lead.unionByName(rest.withColumn("score", _similarity("_target", "_title") + F.col("bonus")))
    best = F.max_by(F.struct("pos", "skuid", "title", "score"), F.struct(F.col("score"), -F.col("pos")))
    return scored.groupBy("target_id").agg(best.alias("_b")).filter(F.col("_b.score") >= SURE).select("target_id", "_b.*")


def top_sales(rows: DataFrame, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Per query the k best sellers; url, else title, tells duplicates, the first of them counts."""
    dup = F.coalesce(F.when(F.col("prourl") != "", F.col("prourl")), F.when(F.col("title") != "", F.col("title")))
    uniq = first_per_key(rows.withColumn("_d", dup).filter("_d is not null"), [*keys, "_d"], ["pos"])
    return top_per_key(uniq, keys, [parse_price(F.col("sales")).desc(), "pos"], k).drop("_d")


def cheapest(rows: DataFrame, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    r = rows.withColumn("price_num", parse_price(F.col("price"))).filter("price_num > 0")
    return top_per_key(r, keys, ["price_num", "pos"], k)


def dual_anchor(rows: DataFrame, series: Column, spec: Column, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Sales anchor: best seller that fits. Price anchor: cheapest fitting row with sales and another url."""
    fit = rows.filter((F.col("url") != "") & ~is_bundle(F.col("title")) & match_spec(F.col("title"), series, spec))
    sales, price = parse_price(F.col("sales")), parse_price(F.col("price"))
    top = fit.groupBy(*keys).agg(F.max_by("url", F.struct(sales, -F.col("pos"))).alias("sales_url"))
    rest = fit.join(top, list(keys)).filter((sales > 0) & (price > 0) & (F.col("url") != F.col("sales_url")))
    low = rest.groupBy(*keys).agg(F.min_by("url", F.struct(price, F.col("pos"))).alias("price_url"))
    return top.join(low, list(keys), "left")


def cheap_anchor(rows: DataFrame, points: DataFrame, k: int, min_points: int = 50, series: Column | None = None,
                 spec: Column | None = None, reject: str | None = None, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """k cheapest sold rows with distinct urls, then only those whose trend is long enough (points: url, n_points)."""
    r = first_per_key(rows.filter((F.col("siteid").cast("string") == "1") & (F.col("url") != "")), [*keys, "url"], ["pos"])
    if series is not None:
        r = r.filter(~is_bundle(F.col("title")) & match_spec(F.col("title"), series, spec))
    if reject:
        r = r.filter(~F.rlike(F.coalesce("title", F.lit("")), F.lit(reject)))
    r = r.filter(parse_price(F.col("sales")) > 0)
    top = top_per_key(r, keys, [parse_price(F.col("price"), "inf"), "pos"], k)
    return top.join(points.select("url", "n_points"), "url").filter(F.col("n_points") >= min_points)


# --- screen dumps -------------------------------------------------------------------------

def assemble_price(nodes: DataFrame, screen: Sequence[str] = ("screen_id",)) -> DataFrame:
    """Price per currency-sign node from up to five following nodes on the same line.

    nodes: screen, pos, y1, y2, x1, val. A screen holds what fits on a display, so its window is small.
    """
    nxt = F.collect_list(F.struct("y1", "val")).over(W.partitionBy(*screen).orderBy("pos").rowsBetween(1, 5))

    def step(s, n):
        stop = s["stop"] | (F.abs(n["y1"] - F.col("y1")) > 30)
        wan = ~stop & (n["val"] == "万")
        num = F.when(~stop & F.rlike(n["val"], F.lit(r"^[\d.]+$")), F.concat(s["num"], n["val"])).otherwise(s["num"])
        return F.struct(num.alias("num"), F.when(wan, 10000).otherwise(s["mult"]).alias("mult"), (stop | wan).alias("stop"))

    start = F.struct(F.lit("").alias("num"), F.lit(1).alias("mult"), F.lit(False).alias("stop"))
    folded = nodes.withColumn("_next", nxt).filter(F.col("val") == "¥").withColumn("_f", F.aggregate("_next", start, step))
    price = F.col("_f.num").try_cast("double") * F.col("_f.mult")
    return folded.select(*screen, "pos", "y1", price.alias("price")).filter("price is not null")


def lead_pairing(nodes: DataFrame, prices: DataFrame, screen: Sequence[str] = ("screen_id",), reach: int = 220) -> DataFrame:
    """Each price with the nearest description that ends above it (0 <= gap < reach).

    Both kinds are laid on one vertical axis and the last description is carried down: an as-of look-up in one
    window, no pair of nodes is ever formed. At equal height the description earlier in the document wins.
    """
    text = nodes.filter((F.length("val") > 50) & ~F.rlike("val", F.lit(r"^[\d.万¥]+$")))
    d = text.select(*screen, F.col("y2").alias("y"), F.lit(0).alias("kind"), (-F.col("pos")).alias("ord"),
                    F.struct(F.col("y2").alias("y2"), F.col("val").alias("desc")).alias("d"), F.lit(None).cast("double").alias("price"),
                    F.lit(None).cast("long").alias("price_pos"))
    p = prices.select(*screen, F.col("y1").alias("y"), F.lit(1).alias("kind"), F.col("pos").alias("ord"),
                      F.lit(None).cast(d.schema["d"].dataType).alias("d"), "price", F.col("pos").cast("long").alias("price_pos"))
    carried = F.last("d", ignorenulls=True).over(W.partitionBy(*screen).orderBy("y", "kind", "ord")
                                                .rowsBetween(W.unboundedPreceding, W.currentRow))
    both = d.unionByName(p).withColumn("_d", carried).filter("kind = 1")
    gap = F.col("y") - F.col("_d.y2")
    return both.filter(gap < reach).select(*screen, "price_pos", "price", F.col("_d.desc").alias("desc"), gap.alias("gap"))


def dedupe_leads(leads: DataFrame, keys: Sequence[str] = ("keyword",)) -> DataFrame:
    """First lead per keyword and 45 leading characters of its description."""
    return first_per_key(leads.withColumn("_k", F.substring("desc", 1, 45)), [*keys, "_k"], ["pos"]).drop("_k")


def listing_flags(desc: Column) -> Column:
    """Warning flags of a description; `!` blocks, `?` warns. Negated lock words do not count."""
    d = F.coalesce(desc, F.lit(""))
    low = F.lower(d)
    words = "|".join(fixed.LOCK_WORDS)
    locked = F.rlike(d, F.lit(rf"(?<![非无][\s\S]{{0,5}})(?<!不是[\s\S]{{0,4}})(?:{words})(?![\s\S]?[非无])(?!不是)"))
    at = F.instr(low, F.lit("mdm"))
    before = F.substr(d, F.greatest(at - 6, F.lit(1)), F.least(at - 1, F.lit(6)))
    named = (at > 0) & ~F.rlike(before, F.lit("[非不]"))
    return F.array_compact(F.array(
        F.when(locked | named, "MDM!"), F.when(any_word(d, ("企业机", "企业版")), "CORP?"), F.when(d.contains("无头"), "HEADLESS!"),
        F.when(any_word(d, fixed.TEASER_WORDS), "TEASER!"), F.when(any_word(d, fixed.BULK_WORDS), "BULK?"),
        F.when(any_word(d, fixed.SHOP_WORDS), "SHOP?"), F.when(low.contains("64g"), "64G")))


def with_flags(leads: DataFrame) -> DataFrame:
    f = listing_flags(F.col("desc"))
    d = leads.withColumn("flags", f)
    blocked = F.exists("flags", lambda x: F.endswith(x, F.lit("!")))
    return d.withColumn("blocked", blocked).withColumn("soft", ~blocked & F.exists("flags", lambda x: F.endswith(x, F.lit("?"))))


def lead_stats(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.array_contains("flags", "64G")).alias("with_64g"),
        F.count_if("blocked").alias("blocked"), F.count_if("soft").alias("soft"))


def fresh_listings(rows: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows not seen before, seen keys afterwards); the key is `price|first 30 characters`."""
    key = F.concat_ws("|", F.col("price").cast("string"), F.substring("desc", 1, 30))
    new = first_per_key(rows.withColumn("listing_key", key), ["listing_key"], ["pos"]).join(
        seen.select("listing_key").distinct(), "listing_key", "left_anti")
    return new, seen.select("listing_key").distinct().unionByName(new.select("listing_key"))


def evidence_gate(leads: DataFrame) -> DataFrame:
    """Adds ok (screenshot, seller and favourite all there) and the reason of a rejection."""
    def has(c):
        return F.coalesce(F.col(c), F.lit("")) != ""

    ok = has("screenshot_detail") & has("seller_id") & has("screenshot_fav")
    return leads.withColumn("ok", ok).withColumn("reject_reason", F.when(~ok, F.coalesce(
        F.when(F.col("reason") != "", F.col("reason")), F.lit("unknown"))))


def gate_stats(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_no_trace"))


def line_cluster(words: DataFrame, page: Sequence[str] = ("page_id",), tol: int = 12) -> DataFrame:
    """Words to text lines: a new line starts when y is more than `tol` below the first word of the line. words: page, y, x, text.

    Only the distinct heights of a page are folded to line starts, which the page's height bounds; each word then takes the last start above it. Within a line words stand by
    x, those with equal x in reading order.
    """
    heights = words.groupBy(*page).agg(F.sort_array(F.collect_set("y")).alias("_ys"))
    kind = words.schema["y"].dataType.simpleString()
    starts = F.aggregate("_ys", F.array().cast(f"array<{kind}>"), lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > tol), F.array_append(acc, y)).otherwise(acc))
    placed = words.join(heights.select(*page, starts.alias("_starts")), list(page)).withColumn("first_y", F.array_max(F.filter("_starts", lambda s: s <= F.col("y"))))
    return placed.groupBy(*page, F.col("first_y").alias("y")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("x", F.col("y").alias("at"), "text"))), lambda t: t["text"]), "").alias("line"))


def price_context(lines: DataFrame, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """Lines that hold a price together with the two lines before and the one after."""
    w = W.partitionBy(*page).orderBy("y")
    around = F.array_compact(F.array(F.lag("line", 2).over(w), F.lag("line", 1).over(w), F.col("line"), F.lead("line", 1).over(w)))
    return lines.withColumn("context", F.array_join(around, "\n")).filter(F.rlike("line", F.lit(r"[¥￥]\s*\d")))


def candidate_ranking(candidates: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Sum of the sub-scores and its rank (1 = best). Ranks come from the counts per distinct total."""
    total = sum((F.col(c) for c in scores[1:]), F.col(scores[0]))
    c = candidates.withColumn("total", F.round(total, 1))
    hist = c.groupBy("total").agg(F.count(F.lit(1)).alias("_n"))
    better = F.sum("_n").over(W.orderBy(F.col("total").desc()).rowsBetween(W.unboundedPreceding, -1))
    ranks = hist.select("total", (F.coalesce(better, F.lit(0)) + 1).alias("rank"))
    return c.join(ranks, "total")


def top_n_per_city(rows: DataFrame, n: int = 20) -> DataFrame:
    """n best rent returns per city, rank 1..n; rr_pct is a year's rent over the price."""
    rr = F.round(F.try_divide(F.col("rent_per_month") * 12, F.col("price")) * 100, 2)
    return top_per_key(rows.withColumn("rr_pct", rr), ["city"], [F.col("rr_pct").desc(), "row_id"], n)
