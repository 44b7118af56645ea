"""Streams and their batch twins over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings.base import Registry, folders, table
from bindings.log_q import LOG
from tidemark.functions.dates import epoch_micros
from tidemark.operators import folds as B, tasklog as L
from tidemark.session import shared_dir
from tidemark.streaming import jobs as J
from tidemark.streaming.folds import AlertFold, QuotaFold, RateFold

R = Registry()
QUERIES, SQL = R.queries, R.sql
HOUR = 3_600_000_000


def alerts(df):
    """Ten users to a task, so that keys grow with the users; time runs 240 times as fast, so that they meet the windows."""
    return df.select(F.lit("p").alias("plan_id"), F.floor(F.col("user_id") / 10).cast("string").alias("task_id"), F.col("event_type").alias("kind"),
                     F.floor(epoch_micros(F.col("ts")) / 240).alias("ts_us"), F.col("event_id").alias("pos"))


def named(df, *cols):
    return df.select("pos", F.concat_ws("/", "kind", "task_id").alias("kind"), *cols)


NUM = "e AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts_us, pos) rn FROM (SELECT event_id AS pos, event_type || '/' || (user_id // 10) AS kind, epoch_us(ts) // 240 AS ts_us FROM events))"
SPACED = f"""WITH RECURSIVE {NUM}, f AS (SELECT pos, kind, ts_us, rn, true AS admitted, ts_us AS held FROM e WHERE rn = 1 UNION ALL
    SELECT e.pos, e.kind, e.ts_us, e.rn, e.ts_us - f.held >= {HOUR}, CASE WHEN e.ts_us - f.held >= {HOUR} THEN e.ts_us ELSE f.held END
    FROM f JOIN e ON e.kind = f.kind AND e.rn = f.rn + 1)
  SELECT pos, kind, admitted, CASE WHEN admitted THEN 'ok' ELSE 'dedup:1in_window' END AS reason FROM f"""


@R.add("admit_alerts", SPACED)
def admit_alerts(spark, d):
    return B.admit_alerts(alerts(table(spark, d, "events")), fold=AlertFold(HOUR, 20)).transform(named, "admitted", "reason")


@R.add("admit_alerts_capped", f"""WITH RECURSIVE {NUM}, f AS (SELECT pos, kind, ts_us, rn, 'ok' AS reason, [ts_us] AS held FROM e WHERE rn = 1 UNION ALL
    SELECT pos, kind, ts_us, rn, CASE WHEN len(young) > 0 THEN 'dedup:' || len(young) || 'in_window' WHEN len(hour) >= 2 THEN 'hourly_cap' ELSE 'ok' END,
      CASE WHEN len(young) > 0 THEN young WHEN len(hour) >= 2 THEN hour ELSE list_append(hour, ts_us) END
    FROM (SELECT e.pos, e.kind, e.ts_us, e.rn, list_filter(f.held, lambda h: e.ts_us - h < 300000000) AS young, list_filter(f.held, lambda h: e.ts_us - h < {HOUR}) AS hour
      FROM f JOIN e ON e.kind = f.kind AND e.rn = f.rn + 1))
  SELECT pos, kind, reason = 'ok' AS admitted, reason FROM f""")
def admit_alerts_capped(spark, d):
    return B.admit_alerts(alerts(table(spark, d, "events")), fold=AlertFold(300_000_000, 2)).transform(named, "admitted", "reason")


@R.add("rate_limit", f"""WITH RECURSIVE {NUM}, f AS (SELECT pos, kind, ts_us, rn, true AS accepted, [ts_us] AS held FROM e WHERE rn = 1 UNION ALL
    SELECT pos, kind, ts_us, rn, len(held) < 2, CASE WHEN len(held) < 2 THEN list_append(held, ts_us) ELSE held END
    FROM (SELECT e.pos, e.kind, e.ts_us, e.rn, list_filter(f.held, lambda h: h >= e.ts_us - {HOUR}) AS held FROM f JOIN e ON e.kind = f.kind AND e.rn = f.rn + 1))
  SELECT pos, kind, accepted FROM f""")
def rate_limit(spark, d):
    return B.rate_limit(alerts(table(spark, d, "events")), ["task_id", "kind"], RateFold(2)).transform(named, "accepted")


@R.add("daily_quota", """WITH RECURSIVE e AS (SELECT event_id AS pos, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS day, CAST(json_extract_string(props, '$.k') AS INT) % 9 + 1 AS n,
    row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) rn FROM events),
  f AS (SELECT pos, day, rn, n <= 300 AS taken, CASE WHEN n <= 300 THEN n ELSE 0 END AS used FROM e WHERE rn = 1 UNION ALL
    SELECT e.pos, e.day, e.rn, f.used + e.n <= 300, CASE WHEN f.used + e.n <= 300 THEN f.used + e.n ELSE f.used END FROM f JOIN e ON e.day = f.day AND e.rn = f.rn + 1)
  SELECT pos, day, taken, CAST(used AS BIGINT) AS used FROM f""")
def daily_quota(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
                                         (F.get_json_object("props", "$.k").cast("int") % 9 + 1).alias("n"))
    return B.daily_quota(q, fold=QuotaFold(300)).select("pos", "day", "taken", "used")


def calls(df):
    return df.select(F.col("event_type").alias("provider"), epoch_micros(F.col("ts")).alias("ts_us"), F.col("event_id").alias("pos"),
                     (F.col("value") > 40).alias("ok"), (F.col("event_id") % 37 == 0).alias("permanent"))


@R.add("outage_intervals", """WITH e AS (SELECT event_type AS provider, epoch_us(ts) AS ts_us, event_id AS pos, value > 40 AS ok, event_id % 37 = 0 AS perm FROM events),
  r AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY provider ORDER BY ts_us, pos) AS run FROM e)
  SELECT provider, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_failed, bool_or(perm) AS permanent FROM r WHERE NOT ok GROUP BY provider, run HAVING count(*) >= 3 OR bool_or(perm)""")
def outage_intervals(spark, d):
    return L.outage_intervals(calls(table(spark, d, "events")), 3, F.floor(F.col("ts_us") / (24 * HOUR)))


_SLICED: dict = {}


def stream_of(spark, d, name):
    """The table as a stream of four files in order of time, one to a micro-batch, so that state is kept and restored between them."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SLICED:
        path = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
        t = table(spark, d, name)
        a, b, c = t.select(F.percentile_approx(epoch_micros(F.col("ts")), [0.25, 0.5, 0.75])).first()[0]
        at = epoch_micros(F.col("ts"))
        for part in (at <= a, (at > a) & (at <= b), (at > b) & (at <= c), at > c):
            t.filter(part).coalesce(1).write.mode("append").parquet(path)
        _SLICED[key] = path
    return spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", 1).parquet(_SLICED[key])


def run(spark, stream, mode="append"):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    J.run_available(stream, f"{base}/checkpoint", J.table_sink(f"{base}/out"), mode)
    return spark.read.parquet(f"{base}/out")


@R.add("alert_dedup_stream", SPACED.replace("SELECT pos, kind, admitted,", "SELECT pos, kind, 'P2' AS level, admitted,"))
def alert_dedup_stream(spark, d):
    s = J.alert_dedup_stream(alerts(stream_of(spark, d, "events")), AlertFold(HOUR, 20))
    return run(spark, s).transform(named, "level", "admitted", "reason")


@R.add("rate_limit_stream", SQL["rate_limit"])
def rate_limit_stream(spark, d):
    return run(spark, J.rate_limit_stream(alerts(stream_of(spark, d, "events")), ["task_id", "kind"], RateFold(2))).transform(named, "accepted")


@R.add("state_stream", f"WITH {LOG} SELECT task_id, arg_max(to_s, seq) AS replayed FROM app GROUP BY 1")
def state_stream(spark, d):
    out = run(spark, J.state_stream(event_log_stream(spark, d)), "update")
    return out.groupBy("task_id").agg(F.max_by("replayed", "batch").alias("replayed"))


def event_log_stream(spark, d):
    from bindings.log_q import FROM_SQL, TO_SQL
    return stream_of(spark, d, "events").select((F.col("user_id") % 10).alias("plan_id"), F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
                                                F.expr(FROM_SQL).alias("from_s"), F.expr(TO_SQL).alias("to_s"))


@R.add("metric_windows", """SELECT CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS business_day, event_type AS name, count(*) AS n, round(sum(value), 2) AS total, max(value) AS max
  FROM events GROUP BY ALL""")
def metric_windows(spark, d):
    m = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value")
    out = run(spark, J.metric_windows(m), "update")
    # of each window the last batch that touched it
    last = out.groupBy("business_day", "name").agg(F.max_by(F.struct("n", "total", "max"), "batch").alias("r"))
    return last.select(F.date_format("business_day", "yyyy-MM-dd").alias("business_day"), "name", "r.n", F.round("r.total", 2).alias("total"), "r.max")


@R.add("seen_stream", "SELECT CAST(round(value * 10) AS INT) AS price, event_type AS head, count(*) > 0 AS seen FROM events GROUP BY ALL")
def seen_stream(spark, d):
    s = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 10).cast("int").alias("price"), F.col("event_type").alias("desc"))
    out = run(spark, J.seen_stream(s, "ts", "90 days"))
    return out.groupBy("price", F.col("desc").alias("head")).agg((F.count("*") == 1).alias("seen"))


@R.add("quota_stream", SQL["daily_quota"])
def quota_stream(spark, d):
    q = stream_of(spark, d, "events").select(F.col("event_id").alias("pos"), F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
                                             (F.get_json_object("props", "$.k").cast("int") % 9 + 1).alias("n"))
    return run(spark, J.quota_stream(q, ["day"], QuotaFold(300))).select("pos", "day", "taken", "used")


@R.add("lost_heartbeat_stream", f"""WITH h AS (SELECT user_id AS task_id, max(epoch_us(ts) // 1000 + event_id % 50 * 600000) AS lease_ms FROM events GROUP BY 1)
  SELECT task_id, lease_ms, 'heartbeat_lost' AS event FROM h WHERE lease_ms <= (SELECT max(epoch_us(ts)) // 1000 - 10000 FROM events)""")
def lost_heartbeat_stream(spark, d):
    h = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("p").alias("plan_id"), F.col("user_id").alias("task_id"),
                                             (F.floor(epoch_micros(F.col("ts")) / 1000) + F.col("event_id") % 50 * 600000).alias("lease_ms"))
    return run(spark, J.lost_heartbeat_stream(h)).select("task_id", "lease_ms", "event")


@R.add("ingest_stream", """WITH v AS (SELECT *, event_id % 23 AS m FROM events WHERE event_type <> 'error')
  SELECT CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS BIGINT) AS entity_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS obs_date, 'shop' || user_id AS shop_name,
    arg_max(value, event_id) AS low_price FROM v WHERE value > 0 AND m NOT IN (0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 14, 15) GROUP BY 1, 2, 3""")
def ingest_stream(spark, d):
    from bindings.obs_q import raw_observations
    from tidemark import fixed
    from tidemark.sources.readers import read_observations
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    when = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"))
    raw = raw_observations(spark, d).join(when, "event_id")
    # files of a date are named in the order of their ranges, rows inside stand in order
    (raw.repartitionByRange("d", "event_id").sortWithinPartitions("d", "event_id")
     .select("d", "identity_hint", "attrs_hint", "low_price", "raw_price", "price_date", "metric", "shop", "in_stock").write.partitionBy("d").json(f"{base}/in"))
    kinds = F.create_map(*[F.lit(x) for kv in {"view": 1, "click": 2, "purchase": 3, "signup": 4}.items() for x in kv])
    ents = table(spark, d, "events").select("event_type").distinct().select(
        F.try_element_at(kinds, F.col("event_type")).cast("long").alias("entity_id"), F.lit("显卡").alias("category"), F.col("event_type").alias("series"),
        F.lit("8GB").alias("spec"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active")).filter("entity_id is not null")
    stream = read_observations(spark, f"{base}/in", stream=True, lines=True)
    J.run_available(stream, f"{base}/checkpoint", J.ingest_batch(fixed.HARDWARE_CONTRACT, ents, f"{base}/table", f"{base}/quarantine"))
    out = spark.read.parquet(f"{base}/table")
    return out.select("entity_id", F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"), "shop_name", "low_price")


@R.add("inbox_stream", """WITH s AS (SELECT s_suppkey, s_suppkey % 5 AS m FROM supplier)
  SELECT CASE m WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'already_exists' WHEN 3 THEN 'conflict' ELSE 'inserted' END AS outcome,
    CASE m WHEN 0 THEN 'bad_json' WHEN 1 THEN 'path_traversal:artifacts/2024-01-01/../x' END AS reason, count(*) AS n FROM s GROUP BY ALL""")
def inbox_stream(spark, d):
    from tidemark.sources.readers import read_inbox
    base = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    k, m = F.col("s_suppkey"), F.col("s_suppkey") % 5
    s = table(spark, d, "supplier")
    tid = F.concat(F.lit("t"), k.cast("string"))
    path = F.when(m == 1, "artifacts/2024-01-01/../x").otherwise("artifacts/2024-01-01/x")
    body = F.to_json(F.struct(tid.alias("task_id"), F.lit("p").alias("plan_id"), F.lit("do").alias("objective"),
                              F.array(F.struct(F.lit("file_exists").alias("type"), path.alias("path"))).alias("acceptance")))
    folders(s.select(F.when(m == 0, F.concat(body, F.lit("}{"))).otherwise(body).alias("value"), k.alias("f")), "f").text(f"{base}/in")
    s.filter(m.isin(2, 3)).select(F.lit("p").alias("plan_id"), tid.alias("task_id"), F.when(m == 2, F.concat(F.lit("p/"), tid)).otherwise("old").alias("idempotency_key")).write.parquet(f"{base}/tasks/seed")
    J.run_available(read_inbox(spark, f"{base}/in", stream=True), f"{base}/checkpoint", J.inbox_batch(f"{base}/tasks", f"{base}/out"))
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("outcome", "reason").agg(F.count("*").alias("n"))
