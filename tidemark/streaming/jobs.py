"""Structured Streaming jobs over unbounded inputs. Input frames come from readStream; sinks are the caller's
choice except where a merge is needed (foreachBatch with idempotent writes)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import tasklog as L
from tidemark.operators import validate as V
from tidemark.plans.intake import intake
from tidemark.session import cut_lineage, scratch
from tidemark.sources import writers
from tidemark.sources.readers import with_position
from tidemark.streaming.folds import HOUR_US, AlertFold, QuotaFold, RateFold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond executor memory needs the on-disk store; the stateful processors require it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FoldProcessor(StatefulProcessor):
    """Runs a fold per key; the state is one short array that ends: once event time is `lasts_us` past a key's last row, a timer drops it.

    The rows of a key and micro-batch come in batches. Of each only the order columns and the fold's inputs are kept, as numbers, until all are there; decisions are then
    made in order and written beside the batches, which go out as they came in.
    """

    def __init__(self, fold, order: Sequence[str], takes: Sequence[str], columns: Sequence[str], out: Sequence[str], time: str, unit_ms: float, lasts_ms: int):
        self.fold, self.order, self.takes, self.columns, self.out = fold, list(order), list(takes), list(columns), list(out)
        self.time, self.unit_ms, self.lasts_ms = time, unit_ms, lasts_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "v array<bigint>, until_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = [b for b in rows if len(b)]
        held, until = self.state.get() if self.state.exists() else (None, None)
        state = list(held) if held is not None else self.fold.start()
        columns = {c: np.concatenate([b[c].to_numpy() for b in batches]) for c in dict.fromkeys([*self.order, *self.takes])}
        got: list = [None] * len(columns[self.order[0]])
        for i in np.lexsort([columns[c] for c in reversed(self.order)]).tolist():
            state, got[i] = self.fold.step(state, {c: columns[c][i].item() for c in self.takes})
        ends = int(columns[self.time].max() * self.unit_ms) + self.lasts_ms
        if until is None or ends > until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(ends)
            until = ends
        self.state.update(([int(x) for x in state], until))
        at = 0
        for b in batches:
            mine = got[at:at + len(b)]
            at += len(b)
            yield b[self.columns].assign(**{n: [g[i] for g in mine] for i, n in enumerate(self.out)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _fold_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold, out: Sequence[T.StructField], takes: Sequence[str], time: str, unit_us: int, lasts_us: int, lateness: str) -> DataFrame:
    """Rows later than `lateness` behind the newest one are dropped by the watermark, as for every event-time state."""
    use_rocksdb(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *out])
    proc = FoldProcessor(fold, order, takes, df.columns, [f.name for f in out], time, unit_us / 1000, lasts_us // 1000 + 1)
    timed = df.withColumn("_at", F.timestamp_micros((F.col(time) * unit_us).cast("long"))).withWatermark("_at", lateness)
    return timed.groupBy(*keys).transformWithStateInPandas(proc, schema, "append", "EventTime")


def alert_dedup_stream(alerts: DataFrame, fold: AlertFold = AlertFold(), lateness: str = "1 hour") -> DataFrame:
    """alerts: plan_id, task_id, kind, ts_us, pos. Suppressed rows are emitted too, with their reason; the level
    follows from the kind alone. What a key holds ends an hour (or a window) after its last alert."""
    out = [T.StructField("admitted", T.BooleanType()), T.StructField("reason", T.StringType())]
    d = _fold_stream(alerts, ["plan_id", "task_id", "kind"], ["ts_us", "pos"], fold, out, ["ts_us"], "ts_us", 1, max(HOUR_US, fold.window_us), lateness)
    return d.withColumn("level", L.alert_level(F.col("kind")))


def rate_limit_stream(requests: DataFrame, keys: Sequence[str], fold: RateFold = RateFold(), lateness: str = "1 hour") -> DataFrame:
    """What a key holds ends a span after its last request."""
    out = [T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType())]
    return _fold_stream(requests, keys, ["ts_us", "pos"], fold, out, ["ts_us"], "ts_us", 1, fold.span_us, lateness)


def quota_stream(requests: DataFrame, keys: Sequence[str], fold: QuotaFold = QuotaFold(), lateness: str = "1 day") -> DataFrame:
    """requests: keys, day (integer, days since 1970), pos, n. With the day among the keys no day waits for another, and a day's state ends after it."""
    out = [T.StructField("taken", T.BooleanType()), T.StructField("used", T.LongType())]
    return _fold_stream(requests, keys, ["day", "pos"], fold, out, ["day", "n"], "day", 24 * HOUR_US, 24 * HOUR_US, lateness)


class LeaseWatch(StatefulProcessor):
    """Emits a task once event time passes its lease without a renewal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "until_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(r["lease_ms"].max()) for r in rows)
        if self.lease.exists():
            held = int(self.lease.get()[0])
            if newest <= held:
                return iter(())
            self.handle.deleteTimer(held)
        self.lease.update((newest,))
        self.handle.registerTimer(newest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = int(self.lease.get()[0])
        self.lease.clear()
        yield pd.DataFrame({"plan_id": [key[0]], "task_id": [key[1]], "lease_ms": [until], "event": ["heartbeat_lost"]})

    def close(self) -> None:
        pass


def lost_heartbeat_stream(heartbeats: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """heartbeats: ts (event time), plan_id, task_id, lease_ms."""
    use_rocksdb(heartbeats.sparkSession)
    schema = T.StructType([heartbeats.schema["plan_id"], heartbeats.schema["task_id"], T.StructField("lease_ms", T.LongType()),
                           T.StructField("event", T.StringType())])
    return (heartbeats.withWatermark("ts", lateness).groupBy("plan_id", "task_id")
            .transformWithStateInPandas(LeaseWatch(), schema, "append", "EventTime"))


def state_stream(events: DataFrame) -> DataFrame:
    """Current state per task (update mode): a plain aggregation, so partial results combine before the shuffle."""
    return L.current_state(events)


def seen_stream(rows: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """First sight of a listing within the horizon; the state of older keys is dropped by the watermark."""
    key = F.concat_ws("|", F.col("price").cast("string"), F.substring("desc", 1, 30))
    return rows.withColumn("listing_key", key).withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["listing_key"])


def metric_windows(metrics: DataFrame, event_time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Metrics per name and business day (UTC+8 days start at 16:00 UTC)."""
    day = F.window(event_time, "1 day", startTime="16 hours")
    return (metrics.withWatermark(event_time, lateness).groupBy(day.alias("w"), "name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.max("value").alias("max"))
            .select(F.to_date(F.col("w.start") + F.expr("INTERVAL 8 HOURS")).alias("business_day"), "name", "n", "total", "max"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"):
    """Processes everything that is there, batch by batch, and stops; restarts go on where the last run ended."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(each).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch is its own folder, overwritten when the batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def ingest_batch(contract: dict, entities: DataFrame, table_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: validate, resolve, merge; what fails goes to quarantine. Redelivery changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            rows, quarantine = intake(with_position(batch), contract, entities)
            quarantine.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
            writers.upsert_partitions(batch.sparkSession, table_path, rows)
    return run


BUCKETS = 64
FOLD_EVERY = 16
_KEYS = "plan_id string, task_id string, idempotency_key string, src long, part long, bucket int"


class TaskKeys:
    """The keys of all tasks on file, in buckets by idempotency key and once more by plan and task, beside the task table: a micro-batch opens the buckets its own keys fall into, no others.

    Each micro-batch adds one small file per bucket it touches; every `fold_every` batches the parts so far become one, so the files stay few. `src` names the batch a task came in with, so that a
    batch delivered again doesn't meet its own tasks.
    """

    def __init__(self, spark: SparkSession, tasks_path: str, buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        self.spark, self.tasks, self.path, self.buckets, self.fold_every = spark, tasks_path, f"{tasks_path.rstrip('/')}.keys", buckets, fold_every

    def _fs(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _bucketed(self, tasks: DataFrame) -> DataFrame:
        of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(self.buckets)).cast("int")
        return tasks.withColumn("bucket", F.explode(F.array_distinct(F.array(of("idempotency_key"), of("plan_id", "task_id")))))

    def write(self, tasks: DataFrame, part: int) -> None:
        """tasks: plan_id, task_id, idempotency_key, src; written over what the part held before."""
        (self._bucketed(tasks).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/part={part}"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(_KEYS).option("basePath", self.path).parquet(self.path)

    def known(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The tasks that could share a key with the batch: those of its buckets, whose numbers alone reach the driver."""
        fs, there = self._fs(self.path)
        if not fs.exists(there):
            before = F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1)
            on_file = self.spark.read.schema("plan_id string, task_id string, idempotency_key string").parquet(f"{self.tasks}/*")
            self.write(on_file.withColumn("src", F.when(before != "", before.try_cast("long")).otherwise(F.lit(-1).cast("long"))), -1)
        hit = [r.bucket for r in self._bucketed(batch.select("plan_id", "task_id", "idempotency_key")).select("bucket").distinct().collect()]
        return self.read().filter(F.col("bucket").isin(hit) & (F.col("src") != batch_id))

    def add(self, tasks: DataFrame, batch_id: int) -> None:
        self.write(tasks.withColumn("src", F.lit(batch_id).cast("long")), batch_id)
        if batch_id % self.fold_every == self.fold_every - 1:
            parts = [r.part for r in self.read().select("part").distinct().collect()]
            # under a new number, so that nothing is lost if the driver is: until the old parts are gone they only repeat what the fold holds
            self.write(self.read().select("plan_id", "task_id", "idempotency_key", "src").distinct(), min(-1, *parts) - 1)
            for p in parts:
                fs, there = self._fs(f"{self.path}/part={p}")
                fs.delete(there, True)


def inbox_batch(tasks_path: str, out_path: str, buckets: int = BUCKETS, fold_every: int = FOLD_EVERY) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for task files: gate every row, then accepted / already_exists / error by outcome."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            v = V.validate_tasks(batch)
            v = cut_lineage(v.withColumn("reason", F.when(F.col("bad_json"), "bad_json").otherwise(F.col("reason"))))
            keys = TaskKeys(spark, tasks_path, buckets, fold_every)
            good = v.filter("reason is null")
            outcome = L.idempotent_insert(keys.known(good, batch_id), good)
            rows = cut_lineage(outcome.select("pos", "plan_id", "task_id", "idempotency_key", "outcome", F.lit(None).cast("string").alias("reason"))
                               .unionByName(v.filter("reason is not null").select("pos", "plan_id", "task_id", "idempotency_key",
                                                                                 F.lit("error").alias("outcome"), "reason")))
            rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{out_path}/batch={batch_id}")
            new = rows.filter("outcome = 'inserted'").select("plan_id", "task_id", "idempotency_key")
            new.write.mode("overwrite").parquet(f"{tasks_path}/batch={batch_id}")
            keys.add(new, batch_id)
    return run
