"""Entity tables: resolution of hints, seeding, anchors, lineage, change requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_name
from tidemark.operators.ordered import first_per_key, number_rows

IDENTITY = ("category", "series", "spec")


def _no_blank(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def resolve_entities(hints: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds entity_id to rows holding category, series, spec (raw or normalised), null when nothing fits.

    Exact identity or a normalised alias first (smallest id over both), then the series alone when it
    names one entity, then series plus spec. The entity side is folded to one row per lookup key and
    the hints to their distinct identities, so no join can multiply rows, a hot identity costs one, and
    names are normalised once per identity instead of once per row.
    """
    ents = (entities.filter("active")
            .withColumn("n_series", normalize_name(F.col("series")))
            .withColumn("n_spec", normalize_name(F.col("spec"))))
    exact = ents.groupBy(*[F.col(k).alias(f"_n_{k}") for k in IDENTITY]).agg(F.min("entity_id").alias("_exact"))
    alias = (ents.select("entity_id", F.explode(F.transform("aliases", normalize_name)).alias("_key"))
             .groupBy("_key").agg(F.min("entity_id").alias("_id")))
    series = ents.groupBy(_no_blank(F.col("n_series")).alias("_series_key")).agg(
        F.count(F.lit(1)).alias("_n_series_hits"), F.min("entity_id").alias("_by_series"))
    spec = ents.groupBy(_no_blank(F.col("n_series")).alias("_series_key"), F.col("n_spec").alias("_n_spec")).agg(
        F.count(F.lit(1)).alias("_n_spec_hits"), F.min("entity_id").alias("_by_spec"))

    h = hints.select(*[F.col(k).alias(f"_{k}") for k in IDENTITY]).distinct()
    h = h.select("*", *[normalize_name(F.col(f"_{k}")).alias(f"_n_{k}") for k in IDENTITY])
    h = h.withColumn("_full", normalize_name(F.concat_ws(" ", "_n_series", "_n_spec"))).withColumn(
        "_series_key", _no_blank(F.col("_n_series")))
    h = (h.join(exact, [f"_n_{k}" for k in IDENTITY], "left")
         .join(alias.select(F.col("_key").alias("_n_series"), F.col("_id").alias("_a1")), "_n_series", "left")
         .join(alias.select(F.col("_key").alias("_full"), F.col("_id").alias("_a2")), "_full", "left")
         .join(series, "_series_key", "left").join(spec, ["_series_key", "_n_spec"], "left"))
    first = F.least("_exact", "_a1", "_a2")
    named = F.col("_n_series") != ""
    found = (F.when(first.isNotNull(), first).when(named & (F.col("_n_series_hits") == 1), F.col("_by_series"))
             .when(named & (F.col("_n_spec") != "") & (F.col("_n_spec_hits") == 1), F.col("_by_spec")))
    h = h.select(*[f"_{k}" for k in IDENTITY], found.alias("entity_id"))
    same = F.lit(True)
    for k in IDENTITY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return hints.join(h, same, "left").drop(*[f"_{k}" for k in IDENTITY])


def seed_entities(base: DataFrame, seed: DataFrame) -> DataFrame:
    """Insert-ignore of seed rows (domain, identity columns, pos) by (domain, identity); new ids follow the maximum."""
    keys = ["domain", *IDENTITY]
    fresh = first_per_key(seed, keys, ["pos"]).join(base.select(*keys), keys, "left_anti")
    top = base.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("m")).scalar()
    numbered = number_rows(fresh, "pos", "_rn").withColumn("entity_id", F.col("_rn") + top)
    return base.select("entity_id", *keys).unionByName(numbered.select("entity_id", *keys))


def entity_overview(entities: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts, newest date and lowest price per active entity, with zero rows for silent ones."""
    stats = obs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_obs"), F.max("obs_date").alias("last_date"),
                                         F.min("low_price").alias("min_price"))
    return (entities.filter("active").select("entity_id", "display_name").join(stats, "entity_id", "left")
            .withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long"))).withColumn("lit", F.col("n_obs") > 0))


def zero_observation_entities(entities: DataFrame, obs: DataFrame, pending: DataFrame) -> DataFrame:
    """Active entities without any observation and without a pending proposal, with a search keyword."""
    ident = F.lower(F.concat_ws("|", *IDENTITY))
    keyword = F.trim(F.concat_ws(" ", "series", "spec"))
    return (entities.filter("active").join(obs.select("entity_id").distinct(), "entity_id", "left_anti")
            .withColumn("identity_key", ident)
            .join(pending.select("identity_key").distinct(), "identity_key", "left_anti")
            .select("entity_id", "identity_key",
                    F.when(keyword != "", keyword).otherwise(F.col("display_name")).alias("keyword")))


def apply_anchors(entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sets the anchor by exact display name, clears it elsewhere, and says what happened."""
    new, old = F.col("new_anchor"), F.col("perf_anchor")
    outcome = (F.when(new.isNull() & old.isNull(), "skipped").when(new.isNull(), "cleared")
               .when(new.eqNullSafe(old), "already").otherwise("set"))
    a = anchors.select("display_name", F.col("anchor").alias("new_anchor"))
    return entities.join(a, "display_name", "left").select(
        "entity_id", "display_name", new.alias("perf_anchor"), outcome.alias("outcome"))


def apply_entity_changes(entities: DataFrame, changes: DataFrame, categories, brands) -> DataFrame:
    """Outcome of every create / update / retire request.

    changes: seq, action, entity_id, category, series, spec, brand. Only the newest request per target counts, earlier ones are superseded. An identity held by another
    active entity is a conflict; of several requests for one identity the earliest gets it. An identity given up in this batch is free from the next one on. Observations are never touched.
    """
    target = F.coalesce(F.col("entity_id").cast("string"), F.concat_ws("|", *IDENTITY))
    last = changes.groupBy(target.alias("_target")).agg(F.max("seq").alias("_last"))
    asked = changes.withColumn("_target", target).join(last, "_target")
    holder = entities.filter("active").groupBy(*IDENTITY).agg(F.min("entity_id").alias("holder_id"))
    known = entities.select("entity_id", F.lit(True).alias("_known"))
    j = asked.join(holder, list(IDENTITY), "left").join(known, "entity_id", "left")
    blank = F.lit(False)
    for k in IDENTITY:
        blank = blank | (F.coalesce(F.col(k), F.lit("")) == "")
    bad = (F.when(blank, "bad:identity").when(~F.col("category").isin(*categories), "bad:category")
           .when((F.coalesce("brand", F.lit("")) != "") & ~F.col("brand").isin(*brands), "bad:brand"))
    refused = F.coalesce(
        F.when(F.col("seq") < F.col("_last"), "superseded"),
        F.when((F.col("action") != "create") & F.col("_known").isNull(), "unknown_entity"),
        F.when(F.col("action") == "retire", "retired"), bad,
        F.when(F.col("holder_id").isNotNull() & ~F.col("holder_id").eqNullSafe(F.col("entity_id")), "conflict"))
    j = j.withColumn("_o", refused)
    winner = j.filter("_o IS NULL").groupBy(*IDENTITY).agg(F.min("seq").alias("_winner"))
    outcome = F.coalesce("_o", F.when(F.col("seq") > F.col("_winner"), "conflict").when(F.col("action") == "create", "created").otherwise("updated"))
    return j.join(winner, list(IDENTITY), "left").select("seq", "action", "entity_id", *IDENTITY, outcome.alias("outcome"))


def rebind_identities(rows: DataFrame, entities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Registry or seed rows that carry an identity: those bound to an entity's old identity take its new one; `rebound` says which."""
    new = outcomes.filter("outcome = 'updated'").select("entity_id", F.struct(*IDENTITY).alias("_new"))
    moved = entities.filter("active").join(new, "entity_id").groupBy(*IDENTITY).agg(F.min_by("_new", "entity_id").alias("_new"))
    j = rows.join(moved, list(IDENTITY), "left")
    rest = [c for c in rows.columns if c not in IDENTITY]
    return j.select(*[F.coalesce(f"_new.{k}", k).alias(k) for k in IDENTITY], *rest, F.col("_new").isNotNull().alias("rebound"))


def merge_entity_changes(entities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entity table after the applied updates and retirements (created rows go through seed_entities)."""
    upd = outcomes.filter(F.col("outcome").isin("updated", "retired")).select(
        "entity_id", F.col("outcome").alias("_o"), *[F.col(k).alias(f"_{k}") for k in IDENTITY])
    j = entities.join(upd, "entity_id", "left")
    return j.select("entity_id", *[F.when(F.col("_o") == "updated", F.col(f"_{k}")).otherwise(F.col(k)).alias(k)
                                   for k in IDENTITY],
                    (F.col("active") & ~F.col("_o").eqNullSafe("retired")).alias("active"))
