"""From parsed dumps to the observation table: reshaping, merging, replay, counters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import first_per_key, top_per_key

from tidemark.functions.text import promo_event

OBS_KEY = ("entity_id", "obs_date", "shop_platform", "shop_name")
#: columns a conflicting row may overwrite; all others keep the value of the first insert
OBS_UPDATED = ("low_price", "raw_price", "attrs", "coupons", "in_stock", "collected_on", "raw_json")

_POINTS = "array<struct<ts_ms:bigint,price:double,remark:string>>"


def parse_date_price(col: Column) -> Column:
    """Points of a `[[ms, price, remark?], ...]` text with or without its outer brackets.

    Points with fewer than two items or without numbers are dropped; unreadable text gives [].
    """
    c = F.trim(F.coalesce(col, F.lit("")))
    wrapped = F.when(F.startswith(c, F.lit("[[")), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    items = F.coalesce(F.from_json(wrapped, "array<string>"), F.array().cast("array<string>"))
    parts = F.filter(F.transform(items, lambda x: F.from_json(x, "array<string>")), lambda a: F.size(a) >= 2)
    points = F.transform(parts, lambda a: F.struct(
        F.get(a, F.lit(0)).try_cast("double").cast("bigint").alias("ts_ms"),
        F.get(a, F.lit(1)).try_cast("double").alias("price"),
        F.coalesce(F.get(a, F.lit(2)), F.lit("")).alias("remark")))
    return F.filter(points, lambda p: p["ts_ms"].isNotNull() & p["price"].isNotNull())


def normalize_segment_trend(df: DataFrame) -> DataFrame:
    """Second provider's payload (schemas.SEGMENT_TREND): the longest segment, seconds to ms, cents to units."""
    seg = F.coalesce(F.col("series"), F.array())
    longest = F.array_max(F.transform(seg, lambda s, i: F.struct(F.size(s["data"]).alias("n"), (-i).alias("back"))))
    data = F.coalesce(F.get(seg, -longest["back"])["data"], F.array())
    points = F.transform(data, lambda p: F.struct(
        (p["x"].try_cast("double") * 1000).cast("bigint").alias("ts_ms"),
        (p["y"].try_cast("double") / 100).alias("price"), F.lit("").alias("remark")))

    def unit(name):
        return (F.col(name).try_cast("double") / 100).alias(f"{name}_price")

    return df.select("url", F.filter(points, lambda p: p["ts_ms"].isNotNull() & p["price"].isNotNull()).alias("points"),
                     unit("current"), unit("min"), unit("max"))


def business_day_of_ms(ts_ms: Column) -> Column:
    """Calendar day at UTC+8 of epoch milliseconds, independent of the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ts_ms + 8 * 3600 * 1000) / 86_400_000).cast("int"))


def collapse_daily(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest price per (keys, business day) with the remark of that point; ties go to the first position."""
    day = business_day_of_ms(F.col("ts_ms"))
    return (points.groupBy(*keys, day.alias("obs_date"))
            .agg(F.min_by(F.struct("price", "remark"), F.struct("price", "pos")).alias("_b"))
            .select(*keys, "obs_date", F.col("_b.price").alias("price"), F.col("_b.remark").alias("remark")))


def convert_series(series: DataFrame) -> DataFrame:
    """Flat series rows (dates, prices, remarks arrays plus shop and attribute columns) to raw observations.

    Unequal array lengths give one row with `error`; fixed attributes override the extra ones.
    """
    equal = F.size("dates") == F.size("prices")
    bad = (F.when(~equal, F.format_string("length_mismatch:%d!=%d", F.size("dates"), F.size("prices"))))
    rows = series.withColumn("error", bad).withColumn(
        "_p", F.explode_outer(F.when(equal, F.arrays_zip("dates", "prices", "remarks"))))
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in ("condition", "channel", "source", "promo_event")]),
                            F.array("condition", "channel", "source", promo_event(F.col("_p.remarks"))))
    extra = F.map_filter(F.coalesce("extra_attrs", F.create_map().cast("map<string,string>")),
                         lambda k, v: ~k.isin("condition", "channel", "source", "promo_event"))
    return rows.filter(F.col("_p").isNotNull() | F.col("error").isNotNull()).select(
        "identity", F.map_concat(extra, own).alias("attrs_hint"), F.col("_p.prices").alias("low_price"),
        F.col("_p.dates").alias("price_date"), "shop", F.lit(True).alias("in_stock"), "source_url",
        F.lit("C").alias("source_tier"), "error")


def dedupe_rows(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows whose (shop, platform, date, price) is not on file; of equal ones in the batch the first by `pos`."""
    key = ["shop_name", "shop_platform", "obs_date", "low_price"]
    return first_per_key(new, key, ["pos"]).join(existing.select(*key).distinct(), key, "left_anti")


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def upsert_observations(base: DataFrame, incoming: DataFrame, key: Sequence[str] = OBS_KEY,
                        updated: Sequence[str] = OBS_UPDATED, pos: str = "pos") -> DataFrame:
    """Merge by key. On conflict only `updated` columns change, and the last incoming row wins them;
    a key that is new takes its other columns from its first incoming row. One shuffle per side, and
    repeated delivery of the same rows changes nothing."""
    upd = [c for c in base.columns if c in updated]
    kept = [c for c in base.columns if c not in updated and c not in key]
    folded = incoming.groupBy(*key).agg(
        F.max_by(F.struct(*upd), pos).alias("_u"),
        *([F.min_by(F.struct(*kept), pos).alias("_k")] if kept else []))
    mine = base.select(*key, F.struct(*upd).alias("_bu"), *([F.struct(*kept).alias("_bk")] if kept else []),
                       F.lit(True).alias("_old"))
    j = mine.join(folded, list(key), "full_outer")
    new_row = F.col("_u").isNotNull()
    out = {c: F.when(new_row, F.col(f"_u.{c}")).otherwise(F.col(f"_bu.{c}")) for c in upd}
    out |= {c: F.when(F.col("_old"), F.col(f"_bk.{c}")).otherwise(F.col(f"_k.{c}")) for c in kept}
    return j.select(*[F.col(c) if c in key else out[c].alias(c) for c in base.columns])


def merge_outcomes(base: DataFrame, incoming: DataFrame, key: Sequence[str] = OBS_KEY) -> DataFrame:
    """Per incoming key: inserted or updated, and how many rows carried it."""
    n = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(base.select(*key, F.lit(True).alias("_old")), list(key), "left").select(
        *key, "n_rows", F.when(F.col("_old"), "updated").otherwise("inserted").alias("outcome"))


def ingest_stats(resolved: DataFrame) -> DataFrame:
    """Counters over tagged rows holding reason, entity_id and exists (key already on file)."""
    good = F.col("reason").isNull()
    hit = good & F.col("entity_id").isNotNull()
    return resolved.agg(
        F.count_if(hit & ~F.col("exists")).alias("ok"), F.count_if(hit & F.col("exists")).alias("updated"),
        F.count_if(good & F.col("entity_id").isNull()).alias("no_entity"), F.count_if(~good).alias("bad_row"),
        F.count_if(hit).alias("ingested"), F.count_if(~hit).alias("isolated"))


def reason_histogram(tagged: DataFrame) -> DataFrame:
    return (tagged.filter(F.col("reason").isNotNull())
            .groupBy(F.split("reason", ":")[0].alias("reason_kind")).agg(F.count(F.lit(1)).alias("n")))


def replay_quarantine(retried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats per date, rows that stay). A date leaves quarantine only when all of its rows were consumed.

    retried: quarantine rows with `consumed` telling whether the row now validates and resolves.
    """
    stats = retried.groupBy("collected_on").agg(
        F.count(F.lit(1)).alias("replayed"), F.count_if("consumed").alias("ingested"),
        F.count_if(~F.col("consumed")).alias("still_isolated"), F.every("consumed").alias("removed"))
    stay = retried.join(stats.filter("removed").select("collected_on"), "collected_on", "left_anti")
    return stats, stay


def points_drilldown(obs: DataFrame, entity_id: int, obs_date: str) -> DataFrame:
    """All raw rows behind one point of a series, cheapest first (both filters reach the scan)."""
    return obs.filter((F.col("entity_id") == entity_id) & (F.col("obs_date") == F.lit(obs_date).cast("date"))
                      ).orderBy("low_price", "shop_name")


def latest_nonempty(artifacts: DataFrame, usable: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Newest row (by `date`) per key that satisfies `usable`; newer but empty ones are passed over."""
    rest = [c for c in artifacts.columns if c not in keys]
    return (artifacts.filter(usable).groupBy(*keys).agg(F.max_by(F.struct(*rest), "date").alias("_r"))
            .select(*keys, "_r.*"))


def outlier_gate(incoming: DataFrame, stored: DataFrame, key: str = "entity_id", limit: float = 0.5, periods: int = 7) -> DataFrame:
    """Incoming rows (key, obs_date, low_price) with mean_7 and outlier: prices more than `limit` off the mean of the last seven periods before their day.

    A period is a day with its lowest price, stored or let in: days of the batch count for the days after them, without the rows that were kept out. stored: key, obs_date, price, one row per day.
    Only the stored days that can matter are read on: the last seven before an entity's first incoming day and those after it. Rows without a price or a day, and days with fewer than
    seven periods before them, pass. An entity's days go by in order, one at a time, each with its distinct prices.
    """
    days = incoming.filter(F.col("low_price").isNotNull() & F.col("obs_date").isNotNull()).groupBy(key, "obs_date").agg(F.collect_set("low_price").alias("prices"))
    first = days.groupBy(key).agg(F.min("obs_date").alias("_first"))
    near = stored.select(key, "obs_date", F.col("price").cast("double").alias("price")).join(first, key)
    before = top_per_key(near.filter("obs_date < _first"), [key], [F.col("obs_date").desc()], periods, "_rank")
    known = before.unionByName(near.filter("obs_date >= _first"), allowMissingColumns=True).select(key, "obs_date", "price", F.lit(None).cast("array<double>").alias("prices"))
    merged = known.unionByName(days.select(key, "obs_date", F.lit(None).cast("double").alias("price"), F.col("prices").cast("array<double>").alias("prices")))
    merged = merged.groupBy(key, "obs_date").agg(F.min("price").alias("price"), F.max("prices").alias("prices"))
    schema = T.StructType([merged.schema[key], merged.schema["obs_date"], T.StructField("mean_7", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), []
        for b in batches:
            means = []
            for who, price, prices in zip(b.column(key).to_pylist(), b.column("price").to_pylist(), b.column("prices").to_pylist()):
                if who != now:
                    now, last = who, []
                mean = sum(last) / periods if len(last) == periods else None
                means.append(mean)
                inside = [p for p in prices or () if mean is None or abs(p - mean) <= mean * limit]
                inside += [] if price is None else [price]
                if inside:
                    last = [*last, min(inside)][-periods:]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("obs_date"), pa.array(means, pa.float64())], names=schema.names)

    means = merged.repartition(key).sortWithinPartitions(key, "obs_date").mapInArrow(run, schema)
    off = F.coalesce(F.abs(F.col("low_price") - F.col("mean_7")) > F.col("mean_7") * limit, F.lit(False))
    return incoming.join(means.filter("mean_7 IS NOT NULL"), [key, "obs_date"], "left").withColumn("outlier", off).select(*incoming.columns, "mean_7", "outlier")
