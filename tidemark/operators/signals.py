"""Signals across domains: rush (fomo_index), settling (stabilization) and supply (supply_heat), their factors computed from tables.

Every factor is one row per entity, folded from (entity, day) rows; the composite scales each over its own range and weighs them. Weights come from the
caller or the contract; a negative one turns a factor round. An entity without listings, mentions or viewings has zero there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import quotient, safe_pct
from tidemark.operators.design import composite_index

THIRD = 1 / 3
WAIT_ABOVE = 70
FOMO = {"slope": THIRD, "listings_change": THIRD, "mention_density": THIRD}
STABLE = {"vol_convergence": THIRD, "spread_convergence": THIRD, "supply_gap": -THIRD}
HEAT = {"on_sale": -THIRD, "viewings": THIRD, "room": -THIRD}


def _within(day: str, as_of: Column, days: int, back: int = 0) -> Column:
    """Days of the span of `days` that ends `back` days before as_of."""
    return (F.col(day) > F.date_sub(as_of, days + back)) & (F.col(day) <= F.date_sub(as_of, back))


def listings_change(listings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(entity_id, n_now, n_before, listings_change): listings (entity_id, obs_date) of the last days against those before, in percent; from none to some is 100."""
    now, before = (F.count_if(_within("obs_date", as_of, days, back)) for back in (0, days))
    d = listings.filter(_within("obs_date", as_of, 2 * days)).groupBy("entity_id").agg(now.alias("n_now"), before.alias("n_before"))
    pct = F.when(F.col("n_before") > 0, safe_pct(F.col("n_now") - F.col("n_before"), F.col("n_before"))).otherwise(F.when(F.col("n_now") > 0, 100.0).otherwise(0.0))
    return d.withColumn("listings_change", pct)


def mention_density(mentions: DataFrame, docs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(entity_id, mention_density): share of the last days' documents that mention the entity, in percent. mentions: entity_id, obs_date, n_docs; docs: obs_date."""
    total = docs.filter(_within("obs_date", as_of, days)).agg(F.count(F.lit(1))).scalar()
    return mentions.filter(_within("obs_date", as_of, days)).groupBy("entity_id").agg(F.sum("n_docs").alias("n_docs")).select("entity_id", safe_pct(F.col("n_docs"), total).alias("mention_density"))


def joined(base: DataFrame, *factors: DataFrame) -> DataFrame:
    for f in factors:
        base = base.join(f, "entity_id", "left")
    return base


def signal(factors: DataFrame, weights: Mapping[str, float], out: str, above: str, below: str) -> DataFrame:
    names = list(weights)
    filled = factors.select("entity_id", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return composite_index(filled, names, out, weights).withColumn("action", F.when(F.col(out) > WAIT_ABOVE, above).otherwise(below))


def fomo_index(l0: DataFrame, listings: DataFrame, mentions: DataFrame, docs: DataFrame, as_of: Column, weights: Mapping[str, float] = FOMO) -> DataFrame:
    """Price slope, change of listings and density of mentions as 0-100; above 70 the action is to wait. l0: entity_id, slope_7_pct_per_day."""
    slope = l0.select("entity_id", F.col("slope_7_pct_per_day").alias("slope"))
    factors = joined(slope, listings_change(listings, as_of).select("entity_id", "listings_change"), mention_density(mentions, docs, as_of))
    return signal(factors, weights, "fomo_index", "wait", "none")


def volatility_convergence(series: DataFrame, periods: int = 7) -> DataFrame:
    """(entity_id, vol_convergence): by how many percent the spread of the last periods, relative to their mean, is below that of the periods before."""
    rn = F.row_number().over(W.partitionBy("entity_id").orderBy(F.col("obs_date").desc()))
    d = series.withColumn("_rn", rn).filter(F.col("_rn") <= 2 * periods)
    vol = lambda cond: quotient(F.stddev_pop(F.when(cond, F.col("price"))), F.avg(F.when(cond, F.col("price"))))
    v = d.groupBy("entity_id").agg(vol(F.col("_rn") <= periods).alias("now"), vol(F.col("_rn") > periods).alias("before"), F.max("_rn").alias("n")).filter(F.col("n") == 2 * periods)
    return v.select("entity_id", safe_pct(F.col("before") - F.col("now"), F.col("before")).alias("vol_convergence"))


def spread_convergence(obs: DataFrame, as_of: Column, days: int = 30, platform: str = "shop_platform") -> DataFrame:
    """(entity_id, spread_convergence): by how many percent the same-day gap between platforms shrank against the span before.

    A day whose lowest price is 0 has an infinite gap, or none that is a number.
    """
    low = obs.filter(_within("obs_date", as_of, 2 * days)).groupBy("entity_id", "obs_date", platform).agg(F.min("low_price").alias("p"))
    gap = low.groupBy("entity_id", "obs_date").agg(F.count(F.lit(1)).alias("n"), quotient(F.max("p") - F.min("p"), F.min("p")).alias("gap")).filter("n >= 2")
    of = lambda back: F.avg(F.when(_within("obs_date", as_of, days, back), F.col("gap")))
    g = gap.groupBy("entity_id").agg(of(0).alias("now"), of(days).alias("before")).filter("now IS NOT NULL AND before IS NOT NULL")
    return g.select("entity_id", safe_pct(F.col("before") - F.col("now"), F.col("before")).alias("spread_convergence"))


def stabilization(series: DataFrame, obs: DataFrame, listings: DataFrame, as_of: Column, weights: Mapping[str, float] = STABLE) -> DataFrame:
    """Converging volatility, converging platforms and balanced supply as 0-100, for entities with two full runs of periods; above 70 it is time to act."""
    supply = listings_change(listings, as_of).select("entity_id", F.abs("listings_change").alias("supply_gap"))
    return signal(joined(volatility_convergence(series), spread_convergence(obs, as_of), supply), weights, "stabilization", "act_now", "wait")


def supply_heat(offers: DataFrame, viewings: DataFrame, as_of: Column, days: int = 30, weights: Mapping[str, float] = HEAT) -> DataFrame:
    """Stock on sale, viewings and room for bargaining as 0-100, hot where stock and room are small; above 70 wait, else try an offer.

    offers: entity_id, obs_date, ask, deal (null while on sale); viewings: entity_id, obs_date.
    """
    room = F.avg(F.when(F.col("deal").isNotNull(), safe_pct(F.col("ask") - F.col("deal"), F.col("ask"))))
    stock = offers.filter(_within("obs_date", as_of, days)).groupBy("entity_id").agg(F.count_if(F.col("deal").isNull()).alias("on_sale"), room.alias("room"))
    seen = viewings.filter(_within("obs_date", as_of, days)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("viewings"))
    return signal(joined(stock, seen), weights, "supply_heat", "wait", "probe_offer")
