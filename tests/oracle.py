"""Runs the registered queries against DuckDB on the same parquet files.

    python -m tests.oracle [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_mod  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_cell(v) for v in row) for row in zip(*cols)) if cols else []


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, str]:
    got = entry_mod.queries()[name](spark, sf_dir).toArrow()
    sql = entry_mod.oracle_sql().get(name)
    if sql is None:
        return "rows-only", got.num_rows, ""
    want = con.execute(sql).to_arrow_table()
    gn, gr = _rows(got)
    wn, wr = _rows(want)
    note = ""
    types = [f"{n}:{got.schema.field(n).type}/{want.schema.field(n).type}" for n in gn
             if n in wn and got.schema.field(n).type != want.schema.field(n).type]
    if gn != wn:
        return "COLUMNS", len(gr), f"{gn} != {wn}"
    if types:
        note = "types " + ",".join(types)
    if gr != wr:
        sg, sw = set(gr), set(wr)
        extra = [r for r in gr if r not in sw][:3]
        miss = [r for r in wr if r not in sg][:3]
        return "DIFF", len(gr), f"{len(gr)} vs {len(wr)} {gn}\n   got {extra}\n   want {miss} {note}"
    return "ok" if not types else "TYPES", len(gr), note


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    from tidemark.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    names = [n for n in entry_mod.queries() if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            status, rows, note = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            status, rows, note = "ERROR", -1, f"{type(e).__name__}: {str(e)[:900]}"
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {n:28s} rows={rows:<7d} {time.time() - t0:5.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
