"""Further series metrics: waiting value, list-price check, spreads, percentiles, premiums, composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import first_per_key

from tidemark.functions.stats import safe_pct

# fixed values: periods each metric needs
SUFFICIENCY = {"l0": 5, "stab_risk": 60, "wait_value": 120, "anchor_check": 30, "offer_percentile": 20,
               "distress_signal": 30, "depreciation": 60, "promo_delta": 30}
# fixed values: which kinds of value and which sources a metric may use; None stands for every source
OWN, FILLED, APPS = ("自采", "manmanmai", "gwdang"), ("manmanmai", "gwdang"), ("自采", "beike_app", "xianyi_app")
ROUTES = {
    "l0": (("price", "unit_price", "rr_pct"), OWN),
    "stab_risk": (("price", "unit_price"), OWN),
    "wait_value": (("price", "unit_price"), OWN),
    "anchor_check": (("price",), ("自采",)),
    "sloth_tax": (("price",), ("自采",)),
    "promo_delta": (("price",), ("自采",)),
    "offer_percentile": (("unit_price",), APPS),
    "distress_signal": (("unit_price",), APPS),
    "stabilization": (("unit_price",), APPS),
    "flagship_premium": (("price", "unit_price"), OWN),
    "depreciation": (("price", "unit_price"), OWN),
    "fomo_index": (("price", "unit_price"), None),
    "arb_window": (("price", "unit_price"), None),
    "supply_heat": (("price", "unit_price"), None),
}
# fixed values: metrics that say so when their value rests on a source filled in later, and what they say
MARKED, BASIS = ("stab_risk", "wait_value", "flagship_premium", "depreciation"), "标价近似"


def _enough(series: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return series.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter(F.col("_n") >= n)


def wait_value(series: DataFrame, keys: Sequence[str] = ("entity_id",), window: int = 90,
               min_history: int = SUFFICIENCY["wait_value"]) -> DataFrame:
    """Mean share saved by waiting up to `window` periods for the lowest price."""
    ahead = F.min("price").over(W.partitionBy(*keys).orderBy("obs_date").rowsBetween(0, window))
    d = _enough(series, keys, min_history).withColumn("_low", ahead)
    saved = F.when(F.col("price") > 0, (F.col("price") - F.col("_low")) / F.col("price")).otherwise(0.0)
    return d.groupBy(*keys).agg((F.avg(saved) * 100).alias("wait_value_pct"), F.max("_n").alias("n_periods"))


def anchor_check(series: DataFrame, claimed: DataFrame, keys: Sequence[str] = ("entity_id",),
                 min_history: int = SUFFICIENCY["anchor_check"]) -> DataFrame:
    """How often the claimed list price (claimed: keys, list_price) was really asked or exceeded."""
    j = _enough(series, keys, min_history).join(claimed, list(keys))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_periods"),
                                F.avg((F.col("price") >= F.col("list_price")).cast("int")).alias("occurrence"))


def sloth_tax(obs: DataFrame, platform: str = "shop_platform", keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Same-day spread of the lowest prices over at least two platforms."""
    per = obs.groupBy(*keys, "obs_date", platform).agg(F.min("low_price").alias("p"))
    return per.groupBy(*keys, "obs_date").agg(F.count(F.lit(1)).alias("n_platforms"), (F.max("p") - F.min("p")).alias("spread")).filter("n_platforms >= 2")


def offer_percentile(series: DataFrame, targets: DataFrame, keys: Sequence[str] = ("entity_id",), window: int = 90,
                     min_history: int = SUFFICIENCY["offer_percentile"]) -> DataFrame:
    """Share of the last `window` prices at or below the target (targets: keys, target)."""
    back = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("obs_date").desc()))
    d = _enough(series, keys, min_history).withColumn("_rn", back).filter(F.col("_rn") <= window)
    return d.join(targets, list(keys)).groupBy(*keys).agg(
        F.avg((F.col("price") <= F.col("target")).cast("int")).alias("percentile"), F.count(F.lit(1)).alias("n_window"))


def flagship_premium(latest: DataFrame, generation: Sequence[str]) -> DataFrame:
    """Premium over the generation's anchor beyond the performance multiple.

    latest: entity_id, price, perf_anchor (1.0 marks the anchor), generation columns.
    """
    base = latest.filter("perf_anchor = 1.0").groupBy(*generation).agg(F.min("price").alias("anchor_price"))
    j = latest.filter("perf_anchor > 0").join(base, list(generation))
    return j.withColumn("premium_pct", safe_pct(F.col("price") / F.col("anchor_price") - F.col("perf_anchor"), F.col("perf_anchor")))


def distress_signal(series: DataFrame, group: Sequence[str], keys: Sequence[str] = ("entity_id",), below_pct: float = 10.0,
                    drop_pct: float = 5.0, min_history: int = SUFFICIENCY["distress_signal"]) -> DataFrame:
    """Points well under the median of their peers of the day that also fell steeply against the previous period."""
    d = _enough(series, [*group, *keys], min_history)
    prev = F.lag("price").over(W.partitionBy(*group, *keys).orderBy("obs_date"))
    d = d.withColumn("_prev", prev)
    # counted per distinct price first, so that a large group's median holds prices, not members
    med = (d.groupBy(*group, "obs_date", "price").agg(F.count(F.lit(1)).alias("_c")).groupBy(*group, "obs_date")
           .agg(F.percentile("price", 0.5, F.col("_c")).alias("peer_median")))
    j = d.join(med, [*group, "obs_date"])
    below = safe_pct(F.col("peer_median") - F.col("price"), F.col("peer_median"))
    fall = safe_pct(F.col("_prev") - F.col("price"), F.col("_prev"))
    return j.withColumn("below_pct", below).withColumn("fall_pct", fall).filter(
        (F.col("below_pct") >= below_pct) & (F.col("fall_pct") >= drop_pct)).select(*group, *keys, "obs_date", "price", "peer_median", "below_pct", "fall_pct")


def depreciation(obs: DataFrame, keys: Sequence[str] = ("entity_id",), min_rows: int = SUFFICIENCY["depreciation"]) -> DataFrame:
    """Price lost per month of use, from a regression of price on months used (mergeable sums only)."""
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (-F.regr_slope("low_price", "months_used")).alias("loss_per_month")).filter(F.col("n") >= min_rows)


def promo_delta(obs: DataFrame, keys: Sequence[str] = ("entity_id",), none: str = "无", min_rows: int = SUFFICIENCY["promo_delta"]) -> DataFrame:
    """Average price outside promotions less the average inside."""
    inside = F.coalesce(F.col("promo_event"), F.lit(none)) != none
    a = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(inside, F.col("low_price"))).alias("in_promo"),
                               F.avg(F.when(~inside, F.col("low_price"))).alias("out_promo"))
    return a.filter((F.col("n") >= min_rows) & F.col("in_promo").isNotNull() & F.col("out_promo").isNotNull()).withColumn(
        "delta", F.col("out_promo") - F.col("in_promo"))


def composite_index(factors: DataFrame, names: Sequence[str], out: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """0-100 index: each factor scaled over its own range, then weighted (equal weights unless given).

    A negative weight turns its factor round. The ranges are one aggregated row. The factors of the signals across domains are in `signals`.
    """
    w = weights or {n: 1.0 / len(names) for n in names}
    span = factors.agg(F.struct(*[F.min(n).alias(f"_lo_{n}") for n in names], *[F.max(n).alias(f"_hi_{n}") for n in names])).scalar()
    j = factors.withColumn("_span", span).select(*factors.columns, "_span.*")
    score = F.lit(0.0)
    for n in names:
        width = F.col(f"_hi_{n}") - F.col(f"_lo_{n}")
        up = (F.col(n) - F.col(f"_lo_{n}")) if w[n] >= 0 else (F.col(f"_hi_{n}") - F.col(n))
        score = score + F.lit(abs(w[n])) * F.when(width == 0, 0.0).otherwise(up / width)
    return j.select(*factors.columns, (score * 100).alias(out))


def arb_window(prices: DataFrame, cost_pct: float) -> DataFrame:
    """Home against foreign price: gap in percent and whether it beats duty and freight (prices: home, abroad)."""
    gap = safe_pct(F.col("home") - F.col("abroad"), F.col("abroad"))
    return prices.withColumn("gap_pct", gap).withColumn("open", F.col("gap_pct") > cost_pct)


def sufficiency_note(counts: DataFrame, metric: str) -> DataFrame:
    """`OK(n)` or a placeholder `n/need`, instead of hiding the metric."""
    need = SUFFICIENCY[metric]
    return counts.withColumn("sufficiency", F.when(F.col("n_periods") >= need, F.format_string("OK(%d)", "n_periods"))
                             .otherwise(F.format_string(f"%d/{need}", "n_periods")))


def sufficiency_forecast(series: DataFrame, metric: str, keys: Sequence[str] = ("entity_id",), pending: DataFrame | None = None, recent: int = 30, need: int | None = None) -> DataFrame:
    """(keys, n_periods, need, cadence_days, expected, sufficiency): when a metric will have its periods, from how often the series was collected of late.

    The cadence is the lower median of the last `recent` gaps between periods, kept as counts per gap, which add up over partial results. `pending` (keys, n_pending) are periods that backfill
    tasks under way will bring. A series of one period has no cadence and no date.
    """
    need = need or SUFFICIENCY[metric]
    w = W.partitionBy(*keys).orderBy("obs_date")
    d = series.select(*keys, "obs_date").distinct().withColumn("_gap", F.date_diff("obs_date", F.lag("obs_date").over(w)))
    d = d.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("obs_date").desc())))
    late = F.when(F.col("_rn") <= recent, F.col("_gap"))
    gaps = d.groupBy(*keys, late.alias("gap")).agg(F.count(F.lit(1)).alias("c"), F.max("obs_date").alias("last"))
    half = F.expr("(aggregate(h, 0L, (a, x) -> a + x.c) + 1) div 2")
    g = gaps.groupBy(*keys).agg(F.sum("c").alias("n_periods"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("gap", "c")))).alias("h"))
    g = g.withColumn("_half", half)
    g = g.withColumn("cadence_days", F.expr("aggregate(h, named_struct('left', _half, 'gap', CAST(null AS INT)), (a, x) -> named_struct('left', a.left - x.c, 'gap', if(a.left > 0, x.gap, a.gap)), a -> a.gap)"))
    if pending is not None:
        g = g.join(pending.select(*keys, "n_pending"), list(keys), "left")
    missing = F.lit(need) - F.col("n_periods") - (F.coalesce("n_pending", F.lit(0)) if pending is not None else F.lit(0))
    expected = F.when(F.col("n_periods") < need, F.date_add("last", (F.greatest(missing, F.lit(0)) * F.col("cadence_days")).cast("int")))
    note = F.when(F.col("n_periods") >= need, F.format_string("OK(%d)", "n_periods")).when(expected.isNull(), F.format_string(f"%d/{need}", "n_periods")).otherwise(
        F.concat(F.format_string(f"%d/{need}, ", "n_periods"), F.date_format(expected, "yyyy-MM-dd")))
    return g.select(*keys, "n_periods", F.lit(need).alias("need"), "cadence_days", expected.alias("expected"), note.alias("sufficiency"))


def significant_change(now: DataFrame, before: DataFrame, abs_d1_pct: float = 1.0) -> DataFrame:
    """Entities whose label changed since the last snapshot or that moved by more than the threshold."""
    j = now.join(before.select("entity_id", F.col("label").alias("_was")), "entity_id", "left")
    return j.filter((F.col("_was").isNotNull() & (F.col("_was") != F.col("label"))) | (F.abs("d1_pct") > abs_d1_pct)).withColumnRenamed("_was", "label_before")


def price_outliers(series: DataFrame, keys: Sequence[str] = ("entity_id",), limit: float = 0.5) -> DataFrame:
    """Points more than 50 % off the mean of the seven periods before them."""
    w = W.partitionBy(*keys).orderBy("obs_date").rowsBetween(-7, -1)
    d = series.withColumn("mean_7", F.avg("price").over(w)).withColumn("_c", F.count(F.lit(1)).over(w))
    return d.filter((F.col("_c") == 7) & (F.abs(F.col("price") - F.col("mean_7")) > F.col("mean_7") * limit)).drop("_c")


def adopt_proposals(quarantine: DataFrame, proposals: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Outcome of model proposals for quarantined rows: merge_to, create_entity, or stays. The surest proposal counts; of equally sure ones the smallest by action and target."""
    p = first_per_key(proposals, ["quarantine_id"], [F.col("confidence").desc_nulls_last(), F.col("action").asc_nulls_last(), F.col("target_entity_id").asc_nulls_last()])
    p = p.select("quarantine_id", F.struct("action", "target_entity_id", "confidence").alias("_p"))
    j = quarantine.join(p, "quarantine_id", "left")
    sure = F.coalesce(F.col("_p.confidence") >= threshold, F.lit(False))
    ok = (F.col("_p.action") == "create_entity") | ((F.col("_p.action") == "merge_to") & F.col("_p.target_entity_id").isNotNull())
    return j.select("quarantine_id", F.when(sure & ok, F.col("_p.action")).otherwise("stays").alias("outcome"),
                    F.when(sure & ok, F.col("_p.target_entity_id")).alias("target_entity_id"))


def routes_of(contract: dict | None) -> dict:
    """The routing matrix: the fixed one, with what a contract's metrics say (`allowed_sources`, by metric, in a kind of value's declaration) in place of it.

    A kind of value that the contract declares with allowed sources feeds just the metrics named there; kinds that it doesn't declare feed none.
    """
    declared = (contract or {}).get("metric_rules") or {}
    if not any(r["allowed_sources"] for r in declared.values()):
        return ROUTES
    out: dict = {}
    for kind, rule in declared.items():
        for name, sources in (rule["allowed_sources"] or {n: s for n, (kinds, s) in ROUTES.items() if kind in kinds}).items():
            kinds, before = out.get(name, ((), ()))
            out[name] = ((*kinds, kind), None if sources is None or before is None else tuple(dict.fromkeys([*before, *sources])))
    return out


def _allowed(kinds, sources):
    ok = F.col("metric").isin(*kinds)
    return ok if sources is None else ok & F.col("source").isin(*sources)


def basis(metric_name: str, source="source"):
    """What a value rests on: the mark of filled-in sources for the metrics that show it, else null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(c.isin(*FILLED), F.lit(BASIS)) if metric_name in MARKED else F.lit(None).cast("string")


def route(obs: DataFrame, metric_name: str, contract: dict | None = None) -> DataFrame:
    """Rows a metric may use, by kind of value and source (a plain filter that reaches the scan), with their `basis`."""
    return obs.filter(_allowed(*routes_of(contract)[metric_name])).withColumn("basis", basis(metric_name))


def route_matrix(obs: DataFrame, contract: dict | None = None) -> DataFrame:
    """Rows per metric that the routing lets through, and how many of them rest on filled-in sources where the metric says so."""
    hits = F.array_compact(F.array(*[F.when(_allowed(k, s), F.struct(F.lit(m).alias("target"), basis(m).isNotNull().alias("marked"))) for m, (k, s) in routes_of(contract).items()]))
    return obs.select(F.explode(hits).alias("h")).groupBy("h.target").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("h.marked")).alias("n_marked"))
