"""Batch twins of the order-dependent streams.

One key may hold any share of the rows: keys are cut into time slices, rows are sorted by (key, slice, time) within partitions, and a task decides the
many slices of a batch one after the other. What a slice needs to know is the state it begins with, and there are two ways to it.

Alert spacing and the daily quota reduce every slice to a small table "state before -> state after" and chain these tables per key.

Rate limits and capped alerts guess: every slice is run from an empty state, the states at its end become the beginning of the next one, and slices
that began with something else are run again, the old and the new run side by side until both agree. That is repeated until no beginning changes. A key with
pauses agrees at once; a key that never pauses and never agrees takes one round per slice, and still only that key's rows.

At last each row is decided once, from the known beginning of its slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import time_slice
from tidemark.session import cut_lineage
from tidemark.streaming.folds import HOUR_US, AlertFold, QuotaFold, RateFold

#: Rows of the busiest key in one slice.
SLICE_ROWS = 50_000


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _slice(df: DataFrame, keys: Sequence[str], ts: str, slice_us: int | None) -> Column:
    """Slices of a given width, else of a width that fits the busiest key."""
    return time_slice(df, keys, ts, SLICE_ROWS) if slice_us is None else F.floor(F.col(ts) / slice_us)


def _spans(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool]]]]:
    """Batches of sorted rows with the stretches (from, to, new) of equal keys; `new` is false where a stretch goes on from the batch before."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        changed = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            one, two = b.column(k).slice(0, b.num_rows - 1), b.column(k).slice(1)
            differ = pc.or_(pc.fill_null(pc.not_equal(one, two), False), pc.xor(pc.is_null(one), pc.is_null(two)))
            changed |= differ.to_numpy(zero_copy_only=False)
        at = [0, *(1 + np.flatnonzero(changed)).tolist(), b.num_rows]
        here = tuple(b.column(k)[0].as_py() for k in keys)
        yield b, [(i, j, i > 0 or here != last) for i, j in zip(at, at[1:])]
        last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)


def _sorted(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def _decide(df: DataFrame, group: Sequence[str], order: Sequence[str], fold, out: Sequence[T.StructField], drop: Sequence[str]) -> DataFrame:
    """Runs a fold over the rows of each group in order, from the state in `entry` (none: the start); memory holds a batch and a state."""
    kept = [c for c in df.columns if c not in drop]
    schema = T.StructType([*_fields(df, kept), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        kinds = [to_arrow_type(f.dataType) for f in out]
        state = fold.start()
        for b, spans in _spans(batches, group):
            ts, got = b.column("ts_us").to_pylist(), []
            for i, j, new in spans:
                if new:
                    state = b.column("entry")[i].as_py() or fold.start()
                for t in ts[i:j]:
                    state, o = fold.step(state, {"ts_us": t})
                    got.append(o)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], names=schema.names)

    return _sorted(df, group, order).mapInArrow(run, schema)


def _entries(exits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state each slice begins with: that at the end of the slice before."""
    from pyspark.sql import Window as W
    return exits.withColumn("entry", F.lag("exit").over(W.partitionBy(*keys).orderBy("_slice")))


def speculate(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold) -> DataFrame:
    """(keys, _slice, entry): the state every slice of `df` (with _slice, ts_us) begins with, found by guessing and mending."""
    group = [*keys, "_slice"]
    kf = _fields(df, group)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*kf, T.StructField("exit", longs)])
    rows = cut_lineage(_sorted(df.select(*dict.fromkeys([*group, "ts_us", *order])), group, order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From `entry` to the state at the end; where `was` (an earlier beginning) is given, its run goes along until both agree, and its end `had` holds."""
        out: list = []
        state = was = had = None
        for b, spans in _spans(batches, group):
            ts, done = b.column("ts_us").to_pylist(), []
            for i, j, new in spans:
                if new:
                    state, was, had = (b.column(c)[i].as_py() for c in ("entry", "was", "had"))
                    state = state or fold.start()
                    out.append([*(b.column(k)[i].as_py() for k in group), state])
                if state is None:                       # agreed before: the rest is known
                    continue
                for t in ts[i:j]:
                    state, _ = fold.step(state, {"ts_us": t})
                    if was is not None:
                        was, _ = fold.step(was, {"ts_us": t})
                        if was == state:
                            out[-1][-1], state = had, None
                            break
                if state is not None:
                    out[-1][-1] = state
            done, out = out[:-1], out[-1:]
            if done:
                yield columns(done)
        if out:
            yield columns(out)

    def columns(done: list) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(to_arrow_schema(schema))], names=schema.names)

    none = F.lit(None).cast(longs)
    # one slice to a key needs no second look
    exits = cut_lineage(rows.select("*", none.alias("entry"), none.alias("was"), none.alias("had")).mapInArrow(ends, schema))
    now = cut_lineage(_entries(exits, keys).withColumn("was", F.array().cast(longs)))
    while True:
        wrong = now.filter(F.coalesce("entry", F.array().cast(longs)) != F.col("was")).select(*group, "entry", "was", F.col("exit").alias("had"))
        if wrong.isEmpty():
            return now.select(*group, "entry")
        on = [now_key.eqNullSafe(F.col(f"_{k}")) for k, now_key in ((k, rows[k]) for k in group)]
        again = rows.join(wrong.select(*[F.col(k).alias(f"_{k}") for k in group], "entry", "was", "had"), on).drop(*[f"_{k}" for k in group])
        fresh = cut_lineage(_sorted(again, group, order).mapInArrow(ends, schema)).select(*[F.col(k).alias(f"_{k}") for k in group], F.col("exit").alias("mended"))
        on = [now[k].eqNullSafe(F.col(f"_{k}")) for k in group]
        held = now.join(fresh, on, "left").select(*group, F.coalesce("mended", "exit").alias("exit"), F.coalesce("entry", F.array().cast(longs)).alias("was"))
        now = cut_lineage(_entries(held, keys))


def _by_guess(df: DataFrame, keys: Sequence[str], fold, out: Sequence[T.StructField], slice_us: int | None) -> DataFrame:
    """Decides rows (ts_us, pos) of each key in order."""
    order, group = ["ts_us", "pos"], [*keys, "_slice"]
    d = df.withColumn("_slice", _slice(df, keys, "ts_us", slice_us))
    entries = speculate(d, keys, order, fold)
    on = [d[k].eqNullSafe(F.col(f"_{k}_")) for k in group]
    known = d.join(entries.select(*[F.col(k).alias(f"_{k}_") for k in group], "entry"), on).drop(*[f"_{k}_" for k in group])
    return _decide(known, group, order, fold, out, ["_slice", "entry"])


# --- alerts -------------------------------------------------------------------------------

def _spaced_steps(ts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one slice: earliest admissible time -> last admitted time.

    Piece i holds for times in (upto[i-1], upto[i]]; later times leave the carried state alone.
    """
    n = len(ts)
    nxt = np.searchsorted(ts, ts + window, side="left")
    jump = np.where(nxt < n, nxt, np.arange(n))
    while True:                                  # pointer jumping to the end of every orbit
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    m = int(min(n, np.searchsorted(ts, ts[0] + window, side="left") + 1))
    upto, last = ts[:m], ts[jump[:m]]
    edge = np.append(last[1:] != last[:-1], True)
    return upto[edge], last[edge]


def admit_spaced(alerts: DataFrame, keys: Sequence[str], window_us: int, slice_us: int | None = None) -> DataFrame:
    """Greedy spacing as a parallel scan: adds `admitted`. Rows need ts_us and pos (order among equal times)."""
    keys = list(keys)
    group = [*keys, "_slice"]
    d = alerts.withColumn("_slice", _slice(alerts, keys, "ts_us", slice_us))
    longs = T.ArrayType(T.LongType())
    tables = T.StructType([*_fields(d, group), T.StructField("upto", longs), T.StructField("last", longs)])
    entry = T.StructType([*_fields(d, group), T.StructField("entry", longs)])

    def columns(rows: list, schema: T.StructType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(schema))], names=schema.names)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []                                 # key and times of the slice that may go on
        for b, spans in _spans(batches, group):
            ts, done = b.column("ts_us").to_numpy(), []
            for i, j, new in spans:
                if new:
                    done, held = done + [held] if held else done, [[b.column(k)[i].as_py() for k in group]]
                held.append(ts[i:j])
            if done:
                yield columns([step(x) for x in done], tables)
        if held:
            yield columns([step(held)], tables)

    def step(held: list) -> list:
        upto, last = _spaced_steps(np.concatenate(held[1:]), window_us)
        return [*held[0], upto.tolist(), last.tolist()]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for b, spans in _spans(batches, keys):
            rows = []
            for i, j, new in spans:
                carried = None if new else carried
                for k in range(i, j):
                    rows.append([*(b.column(c)[k].as_py() for c in group), None if carried is None else [carried]])
                    upto, last = b.column("upto")[k].values.to_numpy(), b.column("last")[k].values.to_numpy()
                    at = 0 if carried is None else int(np.searchsorted(upto, carried + window_us, side="left"))
                    if at < len(upto):
                        carried = int(last[at])
            yield columns(rows, entry)

    steps = _sorted(d.select(*group, "ts_us").distinct(), group, ["ts_us"]).mapInArrow(summarise, tables)
    entries = _sorted(steps, keys, ["_slice"]).mapInArrow(chain, entry)
    on = [d[k].eqNullSafe(F.col(f"_{k}_")) for k in group]
    known = d.join(entries.select(*[F.col(k).alias(f"_{k}_") for k in group], "entry"), on).drop(*[f"_{k}_" for k in group])
    return _decide(known, group, ["ts_us", "pos"], _Spaced(window_us), [T.StructField("admitted", T.BooleanType())], ["_slice", "entry"])


class _Spaced:
    """Admits what comes at least a window after the last admitted one."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def start(self) -> list:
        return []

    def step(self, held: list, row: dict) -> tuple[list, tuple]:
        if held and row["ts_us"] - held[0] < self.window_us:
            return held, (False,)
        return [row["ts_us"]], (True,)


def admit_alerts(alerts: DataFrame, keys: Sequence[str] = ("plan_id", "task_id", "kind"), fold: AlertFold = AlertFold(),
                 slice_us: int | None = None) -> DataFrame:
    """Adds admitted and reason to alerts (ts_us, pos).

    While cap x window fills the hour the cap can never bind, and spacing alone decides.
    """
    if fold.cap * fold.window_us >= HOUR_US:
        out = admit_spaced(alerts, keys, fold.window_us, slice_us)
        return out.withColumn("reason", F.when(F.col("admitted"), "ok").otherwise("dedup:1in_window"))
    return _by_guess(alerts, list(keys), fold, [T.StructField("admitted", T.BooleanType()), T.StructField("reason", T.StringType())], slice_us)


def rate_limit(requests: DataFrame, keys: Sequence[str], fold: RateFold = RateFold(), slice_us: int | None = None) -> DataFrame:
    """Adds accepted and reason to requests (ts_us, pos)."""
    return _by_guess(requests, list(keys), fold, [T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType())], slice_us)


# --- daily quota --------------------------------------------------------------------------

def daily_quota(requests: DataFrame, keys: Sequence[str] = (), fold: QuotaFold = QuotaFold(), chunk: Column | None = None) -> DataFrame:
    """Adds taken and used to requests (day, pos, n >= 0), a parallel scan over slices of a day.

    `chunk` must be monotone in pos (default: ranges of 10 000 positions). A slice is reduced to the table
    "used before -> used after" of per_day + 1 entries.
    """
    cap = fold.per_day
    group = [*keys, "day"]
    d = requests.withColumn("_slice", chunk if chunk is not None else F.floor(F.col("pos") / 10_000))
    gf = _fields(d, [*group, "_slice"])

    def run(used, takes):
        for n in takes:
            used = np.where(used + n <= cap, used + n, used)
        return used

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        after = run(np.arange(cap + 1), pdf.sort_values("pos")["n"].to_numpy())
        return pdf.iloc[:1][[*group, "_slice"]].reset_index(drop=True).assign(after=[after.tolist()])

    tables = d.groupBy(*group, "_slice").applyInPandas(summarise, T.StructType([*gf, T.StructField("after", T.ArrayType(T.LongType()))]))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for pdf in batches:
            entry = []
            for after in pdf["after"]:
                entry.append(used)
                used = int(after[used])
            yield pdf[[*group, "_slice"]].assign(entry=entry)

    entries = (tables.repartition(*group).sortWithinPartitions(*group, "_slice").groupBy(*group)
               .applyInPandas(chain, T.StructType([*gf, T.StructField("entry", T.LongType())])))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        used, taken, after = int(pdf["entry"].iloc[0]), [], []
        for n in pdf["n"].to_numpy():
            fits = used + n <= cap
            used = used + int(n) if fits else used
            taken.append(bool(fits))
            after.append(used)
        return pdf.drop(columns=["entry", "_slice"]).assign(taken=taken, used=after)

    schema = T.StructType([*_fields(d, requests.columns), T.StructField("taken", T.BooleanType()), T.StructField("used", T.LongType())])
    return (d.join(entries, [*group, "_slice"]).select(*requests.columns, "_slice", "entry")
            .groupBy(*group, "_slice").applyInPandas(decide, schema))
