"""Order-dependent building blocks that keep every task bounded.

A plain window over a key puts all rows of that key into one task. The helpers here cut each key into
chunks (a time slice or an id range), work inside the chunks, and carry only one small row per chunk
across the borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lag_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
               take: Mapping[str, str]) -> DataFrame:
    """Adds `out = previous row's col` for each `out -> col`, per key in the given order.

    `chunk` must be monotone in the order. Rows are windowed per (keys, chunk); the last row of the
    previous non-empty chunk is looked up for the first row of a chunk.
    """
    d = df.withColumn("_chunk", chunk)
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    row = F.struct(*[F.col(c).alias(o) for o, c in take.items()])
    d = d.withColumn("_prev", F.lag(row).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    tail = d.groupBy(*keys, "_chunk").agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    carried = tail.withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_chunk"))).drop("_tail")
    d = d.join(carried, [*keys, "_chunk"], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return d.select(*df.columns, *[prev[o].alias(o) for o in take])


def time_slice(df: DataFrame, keys: Sequence[str], ts: str, rows: int = 1_000_000) -> Column:
    """Slice number of an integer time such that even the busiest key has about `rows` rows per slice.

    The width comes from one aggregated row (count and span per key), read as a scalar subquery; small inputs
    end up with a single slice per key.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(ts) - F.min(ts) + 1).alias("span"))
    busy = F.when(F.col("n") > rows, F.greatest(F.col("span") * (rows / F.col("n")), F.lit(1.0)))
    width = per_key.agg(F.coalesce(F.min(busy), F.max("span"), F.lit(1)).cast("long")).scalar()
    return F.floor(F.col(ts) / width)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column,
                out: str) -> DataFrame:
    """Adds the inclusive running sum of `value` per key, chunk by chunk."""
    d = df.withColumn("_chunk", chunk).withColumn("_v", value)
    inner = F.sum("_v").over(W.partitionBy(*keys, "_chunk").orderBy(*order)
                             .rowsBetween(W.unboundedPreceding, W.currentRow))
    total = d.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    before = F.sum("_t").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    total = total.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_t")
    return (d.withColumn("_inner", inner).join(total, [*keys, "_chunk"], "left")
            .select(*df.columns, (F.col("_before") + F.col("_inner")).alias(out)))


def number_rows(df: DataFrame, pos: str, out: str, width: int = 1_000_000) -> DataFrame:
    """Adds 1-based row numbers in the order of the integer column `pos`, without a global sort.

    Rows are numbered inside id ranges of `width`; only the range counts are summed in one place.
    """
    d = df.withColumn("_chunk", F.floor(F.col(pos) / width))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy("_chunk").orderBy(pos)))
    counts = d.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_t"))
    before = F.sum("_t").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_t")
    return d.join(counts, "_chunk").select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias(out))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key; the filter on row_number lets Spark cut each map task to one row per key."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """The k first rows per key with their rank (also cut per map task before the shuffle)."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rn).filter(F.col(out) <= k).withColumn(out, F.col(out).cast("long"))
