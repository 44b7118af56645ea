"""Observation series and the metrics over them.

A series has one row per (keys, obs_date). Building it is a partial aggregation, so a key that owns a
third of all raw rows shrinks to one row per day before anything is shuffled; the windows below
therefore work on groups bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.stats import exclusive_p75, safe_pct

KEYS = ("entity_id",)


def attr_filter(filters: Mapping[str, object]) -> Column:
    """Scalar values mean equality, sequences mean IN; all must hold."""
    cond = F.lit(True)
    for name, want in filters.items():
        many = isinstance(want, (list, tuple, set))
        cond = cond & (F.col(name).isin(*want) if many else (F.col(name) == want))
    return cond


DEFAULT_SCOPE = {"condition": fixed.NEW_CONDITION, "source": fixed.SELF_SOURCES}


def build_series(obs: DataFrame, keys: Sequence[str] = KEYS, scope: Mapping[str, object] | None = None,
                 as_of: Column | None = None) -> DataFrame:
    """Lowest price per (keys, obs_date) of the rows in scope, up to a date."""
    rows = obs.filter(attr_filter(scope)) if scope else obs
    if as_of is not None:
        rows = rows.filter(F.col("obs_date") <= as_of)
    return rows.groupBy(*keys, "obs_date").agg(F.min("low_price").alias("price"))


def daily_series(obs: DataFrame, as_of: Column | None = None) -> DataFrame:
    return build_series(obs, KEYS, DEFAULT_SCOPE, as_of)


def series_with_attrs(obs: DataFrame, scope: Mapping[str, object], as_of: Column | None = None) -> DataFrame:
    return build_series(obs, KEYS, scope, as_of)


def tracks(obs: DataFrame) -> DataFrame:
    """Per-vendor series over the three self-collected sources, only for vendors that have own rows."""
    own = F.max((F.col("source") == fixed.SELF_SOURCES[0]).cast("int"))
    daily = (obs.filter(F.col("vendor").isNotNull() & F.col("source").isin(*fixed.SELF_SOURCES)
                        & (F.col("condition") == fixed.NEW_CONDITION))
             .groupBy("entity_id", "vendor", "obs_date")
             .agg(F.min("low_price").alias("price"), own.alias("own")))
    any_own = F.max("own").over(W.partitionBy("entity_id", "vendor"))
    return daily.withColumn("own", any_own).filter("own = 1").drop("own")


def floor_and_sales_lines(obs: DataFrame) -> DataFrame:
    """Two lines of the backfill source: daily floor over all rows, and over sales-anchor rows only."""
    sales = F.when(F.col("anchor") == fixed.SALES_ANCHOR, F.col("low_price"))
    return (obs.filter(F.col("source") == fixed.SALES_SOURCE)
            .groupBy("entity_id", "obs_date")
            .agg(F.min("low_price").alias("floor_price"), F.min(sales).alias("sales_price")))


def sales_series(obs: DataFrame, as_of: Column | None = None) -> DataFrame:
    scope = {"source": fixed.SALES_SOURCE, "anchor": fixed.SALES_ANCHOR}
    return build_series(obs, KEYS, scope, as_of)


def trend_label(slope: Column, vol: Column) -> Column:
    return (F.when(slope <= -1.0, "fast_drop").when(slope < -0.2, "drop")
            .when((F.abs(slope) < 0.2) & (vol < 2.0), "stable")
            .when(slope < 1.0, "rise").otherwise("fast_rise"))


def l0_metrics(series: DataFrame, keys: Sequence[str] = KEYS, min_periods: int = 5) -> DataFrame:
    """Trend metrics of the latest point per key; keys with too few periods are left out.

    Only the last 30 points matter, so they are picked by one window and folded by one aggregation
    on the same keys: a single shuffle and a single sort.
    """
    back = W.partitionBy(*keys).orderBy(F.col("obs_date").desc())
    tail = (series.withColumn("_rn", F.row_number().over(back))
            .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
            .filter((F.col("_rn") <= 30) & (F.col("_n") >= min_periods)))
    price, rn = F.col("price"), F.col("_rn")
    week = F.when(rn <= 7, price)
    raw = tail.groupBy(*keys).agg(
        F.max("_n").alias("n_periods"),
        F.max(F.when(rn == 1, price)).alias("last_price"),
        F.max(F.when(rn == 1, F.col("obs_date"))).alias("last_date"),
        F.max(F.when(rn == 2, price)).alias("_prev"),
        F.max(F.when(rn == 8, price)).alias("_eighth"),
        F.max(F.when(rn == F.col("_n"), price)).alias("_first"),
        F.avg(week).alias("_avg7"),
        F.stddev_pop(week).alias("_sd7"),
        F.regr_slope(week, -F.when(rn <= 7, rn)).alias("_slope"),
        F.min(price).alias("_min30"))
    out = raw.select(
        *keys, "n_periods", "last_price", "last_date",
        F.round(safe_pct(F.col("last_price") - F.col("_prev"), F.col("_prev")), 2).alias("d1_pct"),
        safe_pct(F.col("_slope"), F.col("_avg7")).alias("_s"),
        safe_pct(F.col("_sd7"), F.col("_avg7")).alias("_v"),
        F.round("_avg7", 2).alias("avg_7"),
        F.round("_min30", 2).alias("min_30"),
        F.round(safe_pct(F.col("last_price") - F.col("_min30"), F.col("_min30")), 2).alias("pct_from_30d_low"),
        safe_pct(F.col("last_price") - F.coalesce("_eighth", "_first"),
                 F.coalesce("_eighth", "_first")).alias("change_7_pct"))
    return out.select(
        *keys, "n_periods", "last_price", "last_date", "d1_pct",
        F.round("_s", 3).alias("slope_7_pct_per_day"), F.round("_v", 2).alias("vol_7_pct"),
        "avg_7", "min_30", "pct_from_30d_low", F.round("change_7_pct", 4).alias("change_7_pct"),
        trend_label(F.col("_s"), F.col("_v")).alias("label"),
        F.format_string("OK(%d)", "n_periods").alias("sufficiency"))


def change_7(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Change of the last point against the eighth from last, or the first of a shorter series."""
    back = W.partitionBy(*keys).orderBy(F.col("obs_date").desc())
    tail = series.withColumn("_rn", F.row_number().over(back)).filter("_rn <= 8")
    base = F.max_by("price", "_rn")
    last = F.min_by("price", "_rn")
    return tail.groupBy(*keys).agg(safe_pct(last - base, base).alias("change_7_pct"))


def forward_drawdown(series: DataFrame, keys: Sequence[str] = KEYS, window: int = 30,
                     min_window: int = 15) -> DataFrame:
    """Per point: fall to the lowest price of the next `window` periods, as a share of the price."""
    fwd = W.partitionBy(*keys).orderBy("obs_date")
    low = F.min("price").over(fwd.rowsBetween(0, window))
    left = F.count(F.lit(1)).over(fwd.rowsBetween(0, window))
    dd = F.when(F.col("price") == 0, 0.0).otherwise((F.col("price") - F.col("_low")) / F.col("price"))
    return (series.withColumn("_low", low).withColumn("_left", left)
            .filter(F.col("_left") > min_window)
            .select(*keys, "obs_date", "price", F.greatest(F.lit(0.0), dd).alias("drawdown")))


def stab_risk(series: DataFrame, keys: Sequence[str] = KEYS, window: int = 30, min_history: int = 60,
              min_window: int = 15) -> DataFrame:
    """Median, third exclusive quartile and maximum of the forward drawdowns of long enough series."""
    whole = F.count(F.lit(1)).over(W.partitionBy(*keys))
    long_enough = series.withColumn("_n", whole).filter(F.col("_n") >= min_history).drop("_n")
    dd = forward_drawdown(long_enough, keys, window, min_window)
    arr = dd.groupBy(*keys).agg(F.sort_array(F.collect_list("drawdown")).alias("_a"),
                                F.median("drawdown").alias("_m"))
    return arr.select(
        *keys, F.round(F.col("_m") * 100, 2).alias("median_pct"),
        F.round(exclusive_p75(F.col("_a")) * 100, 2).alias("p75_pct"),
        F.round(F.element_at("_a", -1) * 100, 2).alias("max_pct"),
        F.size("_a").cast("long").alias("samples"))


def risk_action(median_pct: Column, slope: Column, inclusive: bool = False) -> Column:
    """`wait` while past buyers mostly sat on a loss and the price still falls; else `act_now`."""
    falling = (slope <= -0.2) if inclusive else (slope < -0.2)
    return F.when((median_pct > 10) & falling, "wait").otherwise("act_now")


def contrast(obs: DataFrame, vary: str, values: Sequence[str], fixed_attrs: Mapping[str, object],
             as_of: Column | None = None) -> DataFrame:
    """One row per (entity, value of `vary`) with its metrics and the price spread of the entity."""
    rows = obs.filter(F.col(vary).isin(*values))
    m = l0_metrics(build_series(rows, ("entity_id", vary), fixed_attrs, as_of), ("entity_id", vary))
    per = W.partitionBy("entity_id")
    lo, hi = F.min("last_price").over(per), F.max("last_price").over(per)
    return m.select("entity_id", vary, "last_price", "slope_7_pct_per_day", "vol_7_pct", "label",
                    F.round(safe_pct(hi - lo, lo), 2).alias("spread_pct"))
