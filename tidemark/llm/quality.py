"""Quality rules whose cutoffs come from the data: quantile sketches per language and source give the fences.

A sketch of a measure is the count of documents per bucket, where a bucket keeps the seven leading bits of an integer value (relative
width at most 1/64). Sketches of two sets merge by adding counts, so they are built by partial aggregation, and the sketch of a
language is the sum of those of its sources. A group with too few documents takes the fences of its language; a language with too few
has none, and then only the base rule holds.

Null texts count as empty. Null languages and sources form groups of their own. Rows are judged one by one: repeated rows get the same verdict.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, cut, fields, map_texts, query, table

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))

STATS = fields(n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", n_lines="bigint")

#: Measures in thousandths of their base: (numerator, base).
MEASURES = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
            "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}

#: Distance of a fence from the upper (lower) quartile: spread times a factor, and at least a margin in thousandths.
FACTOR = 6
MARGIN = {"word_length": 1500, "symbols": 100, "repeats": 400, "dup_lines": 500}
MIN_DOCS = 30
LOWER = ("word_length",)


def text_stats(b: bytes) -> tuple[int, ...]:
    words = b.split()
    letters = len(b.translate(None, SPACES + CONTINUATION))
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (len(words), letters, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n, covered = 0, 0   # words before `covered` are counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`doc` and the statistics of its whole text."""
    return map_texts(docs, text, lambda texts: [text_stats(b) for b in texts], STATS, keep).select("doc", "out.*", base_failed().alias("base_failed"))


def base_failed() -> Column:
    w, r = F.col("out.n_words"), F.col("out.n_repeat_words")
    return (w < 50) | (100 * r > 50 * w)


def measure(name: str) -> Column:
    top, base = MEASURES[name]
    return F.expr(f"{top} * 1000 div greatest({base}, 1)")


def bucket(v: Column) -> Column:
    """The value with all but its seven leading bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.when(v <= 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop))


def sketch(stats: DataFrame, lang: Column, source: Column) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per group and measure, of the documents that pass the base rule."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(measure(m)).alias("bucket")) for m in MEASURES])).alias("v")
    return (stats.filter(~F.col("base_failed")).select(lang.alias("lang"), source.alias("source"), values)
            .groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count("*").alias("n")))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches merged by `keys` and their quartiles: one row per key with n and {measure}_q1.. for each measure."""
    from pyspark.sql import Window
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda m, pct: F.min(F.when((F.col("measure") == m) & (F.col("upto") * 100 >= F.col("total") * pct), F.col("bucket")))
    return run.groupBy(*keys).agg(F.max("total").alias("n"), *[at(m, p).alias(f"{m}_q{p}") for m in MEASURES for p in (25, 50, 75)])


def thresholds(sketches: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, {measure}_max, word_length_min), one row per group; null fences where even the language has too few documents."""
    own = quartiles(sketches, ["lang", "source"])
    wide = quartiles(sketches, ["lang"]).select(F.col("lang").alias("l"), F.struct("*").alias("wide"))
    q = lambda c: F.when(F.col("n") >= min_docs, F.col(c)).when(F.col("wide.n") >= min_docs, F.col(f"wide.{c}"))
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("l")), "left")
    fence = lambda m, sign: q(f"{m}_q75" if sign > 0 else f"{m}_q25") + sign * F.greatest(FACTOR * (q(f"{m}_q75") - q(f"{m}_q50" if sign > 0 and m not in LOWER else f"{m}_q25")), F.lit(MARGIN[m]))
    return both.select("lang", "source", *[fence(m, 1).alias(f"{m}_max") for m in MEASURES], *[fence(m, -1).alias(f"{m}_min") for m in LOWER])


def verdict(stats: DataFrame, limits: DataFrame, lang: Column, source: Column) -> DataFrame:
    """`stats` with `kept`: inside every fence of its group and not failed by the base rule."""
    lim = limits.select(F.col("lang").alias("lim_lang"), F.col("source").alias("lim_source"), F.struct("*").alias("lim"))
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(measure(m) <= F.col(f"lim.{m}_max"), F.lit(True))
    for m in LOWER:
        inside &= F.coalesce(measure(m) >= F.col(f"lim.{m}_min"), F.lit(True))
    joined = stats.join(lim, lang.eqNullSafe(F.col("lim_lang")) & source.eqNullSafe(F.col("lim_source")), "left")
    return joined.select(*stats.columns, (~F.col("base_failed") & inside).alias("kept"))


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their columns. The text is read twice, once for the sketches, and never shuffled."""
    l, s = F.col(f"doc.`{lang}`"), F.col(f"doc.`{source}`")
    limits = cut(thresholds(sketch(measured(docs, text, [lang, source]), l, s)))
    return verdict(measured(docs, text), limits, l, s).filter("kept").select("doc.*")


def quality_report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """`doc`, statistics, base_failed and kept of every document. The statistics are written once and read for sketches and verdict."""
    l, s = F.col(f"doc.`{lang}`"), F.col(f"doc.`{source}`")
    stats = cut(measured(docs, text, keep or docs.columns))
    return verdict(stats, thresholds(sketch(stats, l, s)), l, s)


def _sql() -> str:
    bucket = lambda v: f"CASE WHEN {v} <= 0 THEN 0 ELSE ({v} >> greatest(length(bin({v})) - 7, 0)) << greatest(length(bin({v})) - 7, 0) END"
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {b} * 1000 // greatest({d}, 1) AS v FROM st WHERE NOT base_failed" for m, (b, d) in MEASURES.items())
    quart = lambda keys: f"""SELECT {keys}, max(total) AS n, {', '.join(f"min(bucket) FILTER (measure = '{m}' AND upto * 100 >= total * {p}) AS {m}_q{p}" for m in MEASURES for p in (25, 50, 75))}
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY bucket) upto, sum(n) OVER (PARTITION BY {keys}, measure) total
            FROM (SELECT {keys}, measure, bucket, sum(n) n FROM sk GROUP BY ALL)) GROUP BY {keys}"""  # noqa: E731
    pick = lambda c: f"CASE WHEN o.n >= {MIN_DOCS} THEN o.{c} WHEN w.n >= {MIN_DOCS} THEN w.{c} END"
    fence = lambda m, s: f"({pick(f'{m}_q75' if s > 0 else f'{m}_q25')}) {'+' if s > 0 else '-'} greatest({FACTOR} * (({pick(f'{m}_q75')}) - ({pick(f'{m}_q50' if s > 0 and m not in LOWER else f'{m}_q25')})), {MARGIN[m]})"
    m = lambda k: f"{MEASURES[k][0]} * 1000 // greatest({MEASURES[k][1]}, 1)"
    inside = " AND ".join([f"coalesce({m(k)} <= l.{k}_max, true)" for k in MEASURES] + [f"coalesce({m(k)} >= l.{k}_min, true)" for k in LOWER])
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  tri AS (SELECT r, w, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS g FROM d),
  pos AS (SELECT r, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM tri),
  rep AS (SELECT r, i FROM pos QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
  cov AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM rep) GROUP BY 1),
  ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
  s0 AS (SELECT doc_id, lang, source, len(w) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines FROM d JOIN ln USING (r) LEFT JOIN cov USING (r)),
  st AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s0),
  sk AS (SELECT lang, source, measure, {bucket('v')} AS bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
  own AS ({quart('lang, source')}), wide AS ({quart('lang')}),
  lim AS (SELECT o.lang, o.source, {', '.join(f'{fence(k, 1)} AS {k}_max' for k in MEASURES)}, {', '.join(f'{fence(k, -1)} AS {k}_min' for k in LOWER)}
    FROM own o LEFT JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM st LEFT JOIN lim l ON st.lang IS NOT DISTINCT FROM l.lang AND st.source IS NOT DISTINCT FROM l.source"""


@query("op7_quality_rules", _sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_report(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
