"""Observation table -> trend snapshot and board, in one pass over the observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import series as S

TRACK_KEYS = ("entity_id", "track")
_METRICS = ("last_price", "last_date", "d1_pct", "slope_7_pct_per_day", "vol_7_pct", "avg_7", "min_30",
            "pct_from_30d_low", "label", "sufficiency")


def both_tracks(obs: DataFrame, as_of: Column) -> DataFrame:
    """Default-scope and sales-anchor series of every entity from one scan and one aggregation."""
    default = S.attr_filter(S.DEFAULT_SCOPE)
    sales = (F.col("source") == fixed.SALES_SOURCE) & (F.col("anchor") == fixed.SALES_ANCHOR)
    daily = (obs.filter((F.col("obs_date") <= as_of) & (default | F.coalesce(sales, F.lit(False))))
             .groupBy("entity_id", "obs_date")
             .agg(F.min(F.when(default, F.col("low_price"))).alias("a"),
                  F.min(F.when(sales, F.col("low_price"))).alias("b")))
    pair = F.array(F.struct(F.lit("default").alias("track"), F.col("a").alias("price")),
                   F.struct(F.lit("sales").alias("track"), F.col("b").alias("price")))
    return (daily.select("entity_id", "obs_date", F.inline(pair)).filter("price is not null"))


def compute_snapshot(entities: DataFrame, obs: DataFrame, as_of: Column) -> DataFrame:
    """All entities, inactive ones too: metrics of the default track, and of the sales track with its risk."""
    ser = both_tracks(obs, as_of)
    n = ser.groupBy(*TRACK_KEYS).agg(F.count(F.lit(1)).alias("n_periods"))
    metrics = S.l0_metrics(ser, TRACK_KEYS).drop("n_periods", "change_7_pct")
    risk = S.stab_risk(ser.filter("track = 'sales'"), TRACK_KEYS)
    per_track = n.join(metrics, list(TRACK_KEYS), "left").join(risk, list(TRACK_KEYS), "left")

    def pick(track, c):
        return F.max(F.when(F.col("track") == track, F.col(c)))

    wide = per_track.groupBy("entity_id").agg(
        pick("default", "n_periods").alias("n_periods"), *[pick("default", c).alias(c) for c in _METRICS],
        pick("sales", "n_periods").alias("sales_n_periods"),
        *[pick("sales", c).alias(f"sales_{c}") for c in _METRICS],
        *[pick("sales", c).alias(c) for c in ("median_pct", "p75_pct", "max_pct", "samples")])
    slope = F.coalesce("sales_slope_7_pct_per_day", F.lit(0.0))
    out = entities.select("entity_id", "display_name", "perf_anchor").join(wide, "entity_id", "left")
    return out.withColumn("n_periods", F.coalesce("n_periods", F.lit(0).cast("long"))).withColumn(
        "stab_action", F.when(F.col("median_pct").isNotNull(), S.risk_action(F.col("median_pct"), slope)))


def snapshot_contrast(entities: DataFrame, obs: DataFrame, as_of: Column, vendors) -> DataFrame:
    """Vendor contrast of the first entity over its own new-condition rows."""
    first = entities.agg(F.min("entity_id")).scalar()
    scope = {"condition": fixed.NEW_CONDITION, "source": fixed.SELF_SOURCES[0]}
    return S.contrast(obs.filter(F.col("entity_id") == first), "vendor", vendors, scope, as_of)


def snapshot_documents(snapshot: DataFrame) -> DataFrame:
    """One nested document per entity, ready for write.json; entities stay separate rows at any size."""
    def block(prefix, extra=()):
        return F.struct(F.col(f"{prefix}n_periods").alias("n_periods"),
                        F.when(F.col(f"{prefix}label").isNotNull(),
                               F.struct(*[F.col(prefix + c).alias(c) for c in _METRICS])).alias("metrics"), *extra)

    risk = F.when(F.col("median_pct").isNotNull(), F.struct("median_pct", "p75_pct", "max_pct", "samples"))
    return snapshot.select("entity_id", "display_name", "perf_anchor", block("").alias("default"),
                           F.when(F.col("sales_n_periods").isNotNull(),
                                  block("sales_", (risk.alias("stab_risk"), F.col("stab_action")))).alias("sales"))


def verify_snapshot(published: DataFrame, recomputed: DataFrame, tol: float = 0.01,
                    metrics=("last_price", "d1_pct", "slope_7_pct_per_day", "min_30")) -> DataFrame:
    """Metric values that differ by more than the tolerance; nulls on either side are passed over."""
    def long(df, name):
        vals = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])
        return df.select("entity_id", F.inline(vals))

    j = long(published, "published").join(long(recomputed, "recomputed"), ["entity_id", "metric"])
    return j.filter(F.abs(F.col("published") - F.col("recomputed")) > tol)


def board(entities: DataFrame, obs: DataFrame, as_of: Column) -> DataFrame:
    """Per active entity: group, number of periods, the series, vendor tracks, the two lines and the metrics.

    Arrays hold at most one element per calendar day (and vendor), in date order.
    """
    seen = obs.filter(F.col("obs_date") <= as_of)
    daily = S.daily_series(seen)
    ser = daily.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_periods"), F.array_sort(F.collect_list(F.struct("obs_date", "price"))).alias("series"))
    trk = (S.tracks(seen).groupBy("entity_id", "vendor")
           .agg(F.array_sort(F.collect_list(F.struct("obs_date", "price"))).alias("points"))
           .groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("vendor", "points"))).alias("tracks")))
    lines = S.floor_and_sales_lines(seen).groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("obs_date", "floor_price", "sales_price"))).alias("lines"))
    m = S.l0_metrics(daily).select("entity_id", "last_price", "slope_7_pct_per_day", "label")
    group = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.when(F.col("city") != "", F.col("city")),
                       F.lit("其他"))
    out = entities.filter("active").select("entity_id", "display_name", group.alias("group"))
    for part in (ser, trk, lines, m):
        out = out.join(part, "entity_id", "left")
    return out.withColumn("n_periods", F.coalesce("n_periods", F.lit(0).cast("long")))


def board_totals(b: DataFrame) -> DataFrame:
    return b.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_periods") > 0).alias("with_data"),
                 F.count_if(F.col("label").isNotNull()).alias("l0_ok"))
