"""Shared views of the given tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folders(df: DataFrame, key: str):
    """A writer of a folder per key. All tasks share the folders, however few bytes there are, and put them in their place themselves, so that no one task or driver makes all files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key)


class Registry:
    """Collects (name -> spark callable) and (name -> SQL)."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return wrap


def day(col: str):
    """Dates leave the registered queries as text, so that both engines print the same value."""
    return F.date_format(col, "yyyy-MM-dd").alias(col)


SOURCE_OF = {"view": "自采", "click": "manmanmai", "purchase": "gwdang", "signup": "smzdm", "error": "xianyi_app"}
VENDORS = ("七彩虹", "微星", "华硕", "技嘉", "索泰")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """events as observations: user = entity, type = source, props.k picks the vendor."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.create_map(*[F.lit(x) for kv in SOURCE_OF.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"), F.col("value").alias("low_price"),
        source.alias("source"),
        F.when(F.col("event_id") % 10 == 0, "二手").otherwise("全新").alias("condition"),
        F.when(k % 6 < 5, F.element_at(F.array(*[F.lit(v) for v in VENDORS]), (k % 6 % 5 + 1).cast("int"))).alias("vendor"),
        F.when(F.col("event_id") % 3 == 0, "销量").when(F.col("event_id") % 3 == 1, "价格").alias("anchor"),
        k.alias("k"), "event_id", "ts", "event_type")


OBS = """obs AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, value AS low_price,
  CASE event_type WHEN 'view' THEN '自采' WHEN 'click' THEN 'manmanmai' WHEN 'purchase' THEN 'gwdang'
    WHEN 'signup' THEN 'smzdm' WHEN 'error' THEN 'xianyi_app' END AS source,
  CASE WHEN event_id % 10 = 0 THEN '二手' ELSE '全新' END AS condition,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 6 WHEN 0 THEN '七彩虹' WHEN 1 THEN '微星' WHEN 2 THEN '华硕'
    WHEN 3 THEN '技嘉' WHEN 4 THEN '索泰' END AS vendor,
  CASE event_id % 3 WHEN 0 THEN '销量' WHEN 1 THEN '价格' END AS anchor,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id, ts, event_type FROM events)"""

SELF = "('自采', 'manmanmai', 'gwdang')"


def l0_sql(src: str, keys: str) -> str:
    """CTEs that turn `src(keys, obs_date, price)` into `l0`."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY obs_date DESC) rn,
    count(*) OVER (PARTITION BY {keys}) n FROM {src}),
  raw AS (SELECT {keys}, max(n) n, max(price) FILTER (rn = 1) lp, max(obs_date) FILTER (rn = 1) ld,
    max(price) FILTER (rn = 2) pp, coalesce(max(price) FILTER (rn = 8), max(price) FILTER (rn = n)) p8,
    avg(price) FILTER (rn <= 7) a7, stddev_pop(price) FILTER (rn <= 7) sd7,
    regr_slope(price, -rn) FILTER (rn <= 7) sl, min(price) FILTER (rn <= 30) m30
    FROM ranked WHERE n >= 5 GROUP BY {keys}),
  calc AS (SELECT *, CASE WHEN a7 = 0 THEN 0.0 ELSE sl / a7 * 100 END s,
    CASE WHEN a7 = 0 THEN 0.0 ELSE sd7 / a7 * 100 END v FROM raw),
  l0 AS (SELECT {keys}, n AS n_periods, lp AS last_price, ld AS last_date,
    round(CASE WHEN pp = 0 THEN 0.0 ELSE (lp - pp) / pp * 100 END, 2) AS d1_pct,
    round(s, 3) AS slope_7_pct_per_day, round(v, 2) AS vol_7_pct, round(a7, 2) AS avg_7, round(m30, 2) AS min_30,
    round(CASE WHEN m30 = 0 THEN 0.0 ELSE (lp - m30) / m30 * 100 END, 2) AS pct_from_30d_low,
    round(CASE WHEN p8 = 0 THEN 0.0 ELSE (lp - p8) / p8 * 100 END, 4) AS change_7_pct,
    CASE WHEN s <= -1.0 THEN 'fast_drop' WHEN s < -0.2 THEN 'drop' WHEN abs(s) < 0.2 AND v < 2.0 THEN 'stable'
      WHEN s < 1.0 THEN 'rise' ELSE 'fast_rise' END AS label,
    'OK(' || n || ')' AS sufficiency FROM calc)"""
