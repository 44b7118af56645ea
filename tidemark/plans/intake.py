"""Intake as one plan: raw rows are validated and resolved; what fails is kept with its reason and can be replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import entities as E
from tidemark.operators import observations as O
from tidemark.operators import validate as V
from tidemark.session import cut_lineage


def intake(raw: DataFrame, contract: dict, entities: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows for the table, quarantine). raw holds collected_on and pos; both results are written once, so that neither runs the parsing again.

    With the stored daily series (entity_id, obs_date, price), prices far off an entity's last seven periods are kept out as `price_outlier`.
    """
    tagged = cut_lineage(V.tag_observations(raw, contract))
    good = V.shape_observations(tagged, contract, normalize=False)
    flat = good.select(*[F.col(f"identity.{k}").alias(k) for k in contract["identity"]], *[c for c in good.columns if c != "identity"])
    resolved = cut_lineage(E.resolve_entities(flat, entities))
    rows = (resolved.filter("entity_id is not null").drop(*contract["identity"])
            .withColumn("raw_json", F.to_json(F.struct("low_price", "raw_price"))))
    lost = resolved.filter("entity_id is null").select("collected_on", "pos", F.lit("no_entity").alias("reason"),
                                                       F.to_json(F.struct(*contract["identity"])).alias("raw_json"))
    kept_out = V.quarantine_rows(tagged).unionByName(lost)
    if stored is None:
        return rows, kept_out
    gated = cut_lineage(O.outlier_gate(rows, stored))
    off = gated.filter("outlier").select("collected_on", "pos", F.lit("price_outlier").alias("reason"), "raw_json")
    return gated.filter("NOT outlier").drop("mean_7", "outlier"), kept_out.unionByName(off)


def replay(raw: DataFrame, contract: dict, entities: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quarantined raw rows once more through validation and resolution: (rows for the table, stats per date, raw rows that stay)."""
    rows, _ = intake(raw, contract, entities, stored)
    taken = rows.select("collected_on", "pos", F.lit(True).alias("consumed"))
    retried = raw.join(taken, ["collected_on", "pos"], "left").fillna(False, ["consumed"])
    stats, stay = O.replay_quarantine(retried)
    return rows, stats, stay.drop("consumed")
