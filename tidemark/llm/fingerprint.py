"""Document fingerprints by a threshold-scaled sketch: every shingle hash below a fixed fraction of the hash range is kept.

Because the threshold is the same for all texts, the sketch of a union is the union of sketches, and the share of a sketch found in
another estimates how much of one text the other contains, however different their lengths. A text none of whose hashes fall below
the threshold keeps its smallest one, so that only a text without words has an empty sketch.

All expressions are built-in functions. A null text counts as empty; equal texts have equal fingerprints; rows are independent.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_GAP, query, table

WORDS = 5           # words of a shingle
BELOW = "2"         # hex prefix under which a hash is kept: 2/16 of the range
HEX = 16            # hex digits kept of a hash
BUCKET = 1024       # documents that share one window when neighbours are looked up


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word shingles, in text order; a text of fewer words is one shingle, one without words has none."""
    one = lambda s: F.substring(F.md5(F.concat_ws(" ", s)), 1, HEX)
    return let(F.array_remove(F.split(text, WORD_GAP), ""), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(
        F.size(w) <= words, F.array(one(w))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: one(F.slice(w, i, words)))))


def sketch(text: Column, words: int = WORDS, below: str = BELOW) -> Column:
    """The kept hashes of a text, distinct and in order."""
    return let(shingle_hashes(text, words), lambda h: let(F.array_min(h), lambda m: F.array_sort(F.array_distinct(F.filter(h, lambda x: (x < below) | (x == m))))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of text a's shingles that b has too; 1 for two texts without words, 0 if only a has none."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, below: str = BELOW) -> Column:
    """The sketch of two texts' shingles taken together."""
    return let(F.array_sort(F.array_union(a, b)), lambda h: let(F.array_min(h), lambda m: F.filter(h, lambda x: (x < below) | (x == m))))


def in_ranges(df: DataFrame, key: str, order: list[str], bucket: int = BUCKET) -> DataFrame:
    """`df` with `range_no` and `guest`: rows cut into ranges of the key of about `bucket` rows, and the first
    row of each range, in descending order of `key` and `order`, once more as the guest that ends the range above it.

    The key's span is cut evenly; a range that gets too many rows is cut evenly over its own span, and so on, so that neither gaps nor outliers crowd a range (rows of one and the
    same key stay together). A range is named by its lower bound. Rows without a key come last, spread over ranges of their own by a hash. The highest
    range's first row is the guest of the lowest.
    """
    whole = F.col(key).cast("decimal(38,0)")
    exact = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    lo, hi, n = df.agg(F.min(whole), F.max(whole), F.count(key)).first()
    lo, hi = int(lo or 0), int(hi or 0)
    width = max(1, (hi - lo + 1) * bucket // max(1, n))
    lost = exact(lo) - 1 - F.pmod(F.xxhash64(*order), F.lit(bucket))
    cut = df.withColumn("range_no", F.coalesce(stepped(whole, exact(lo), exact(width)), lost.cast("decimal(38,0)")))
    while True:
        crowd = cut.groupBy("range_no").agg(F.count(key).alias("n"), F.min(whole).alias("least"), F.max(whole).alias("most")).filter((F.col("n") > 4 * bucket) & (F.col("most") > F.col("least")))
        if crowd.isEmpty():
            break
        step = F.greatest(exact(1), F.floor((F.col("most") - F.col("least") + 1) / F.col("n") * bucket).cast("decimal(38,0)"))
        finer = crowd.select(F.col("range_no").alias("_r"), F.col("least").alias("_low"), step.alias("_step"))
        cut = cut.join(finer, F.col("range_no") == F.col("_r"), "left").withColumn("range_no", F.coalesce(stepped(whole, F.col("_low"), F.col("_step")), F.col("range_no"))).drop("_r", "_low", "_step")
    falling = [F.desc_nulls_last(c) for c in (key, *order)]
    heads = cut.withColumn("place", F.row_number().over(Window.partitionBy("range_no").orderBy(*falling))).filter("place = 1").drop("place")
    # the range above each: within blocks of ranges, then over one row per block
    block = F.floor((F.col("range_no") - exact(lo)) / exact(width * bucket))
    near = heads.withColumn("block", block).withColumn("above", F.lead("range_no").over(Window.partitionBy("block").orderBy("range_no")))
    blocks = cut.select("range_no", block.alias("b")).groupBy("b").agg(F.min("range_no").alias("low"))
    blocks = blocks.select("b", F.lead("low").over(Window.orderBy("b")).alias("over"), F.min("low").over(Window.partitionBy()).alias("lowest"))
    guests = near.join(blocks, F.col("block") == F.col("b")).withColumn("range_no", F.coalesce("above", "over", "lowest"))
    return cut.withColumn("guest", F.lit(False)).unionByName(guests.select(*cut.columns, F.lit(True).alias("guest")))


def stepped(value: Column, low: Column, step: Column) -> Column:
    """The largest low + k * step that is not above the value, as a whole number of any size."""
    return (value - F.pmod(value - low, step)).cast("decimal(38,0)")


def with_next(ranged: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """Rows of `in_ranges` without the guests, with next_{c}: values of the row that follows."""
    w = Window.partitionBy("range_no").orderBy("guest", *[F.desc_nulls_last(c) for c in (key, *order)])
    seen = ranged.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return seen.filter("NOT guest").drop("guest", "range_no")


_SHINGLES = lambda w: f"CASE WHEN len({w}) = 0 THEN []::VARCHAR[] WHEN len({w}) <= {WORDS} THEN [left(md5(array_to_string({w}, ' ')), {HEX})] ELSE list_transform(range(1, len({w}) - {WORDS - 2}), lambda i: left(md5(array_to_string({w}[i:i + {WORDS - 1}], ' ')), {HEX})) END"
_SPLIT = lambda t: f"list_filter(string_split_regex({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_KEEP = lambda h: f"list_sort(list_distinct(list_filter({h}, lambda x: x < '{BELOW}' OR x = list_min({h}))))"
_NEAR = lambda a, b: f"CASE WHEN len({a}) = 0 THEN CASE WHEN len({b}) = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len({a}) END"

SKETCH_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
  n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
  e AS (SELECT *, left(t, CAST(n - n // 3 AS BIGINT)) || left(nt, CAST(n // 3 AS BIGINT)) AS et FROM n),
  w AS (SELECT *, {_SPLIT('t')} AS w, {_SPLIT('et')} AS ew, {_SPLIT('nt')} AS nw FROM e),
  h AS (SELECT *, {_SHINGLES('w')} AS h, {_SHINGLES('ew')} AS eh, {_SHINGLES('nw')} AS nh FROM w),
  f AS (SELECT *, {_KEEP('h')} AS f, {_KEEP('eh')} AS ef, {_KEEP('nh')} AS nf FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, array_to_string(f, '') AS fingerprint, array_to_string(ef, '') AS edited_fingerprint,
  CAST({_NEAR('f', 'ef')} AS DOUBLE) AS near_edited, CAST({_NEAR('f', 'nf')} AS DOUBLE) AS near_next FROM f"""


@query("op8_document_fingerprints", SKETCH_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = in_ranges(docs, "doc_id", ["text"]).withColumn("sketch", sketch(F.col("text")))
    third = F.expr("n_chars div 3").cast("int")
    edited = with_next(own, "doc_id", ["text"], ["text", "sketch"]).select(
        "doc_id", "text", "sketch", "next_text", "next_sketch", F.char_length("text").cast("bigint").alias("n_chars"))
    both = edited.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next_text", third)))
    near = let(sketch(F.col("edited")), lambda e: F.struct(F.array_join(e, "").alias("edited_fingerprint"), containment(F.col("sketch"), e).alias("near_edited")))
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sketch", "").alias("fingerprint"), near.alias("near"),
                       containment(F.col("sketch"), F.col("next_sketch")).alias("near_next")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "near.*", "near_next")
