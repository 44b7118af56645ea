"""State that ends, and files read from their end."""

import random

from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.streaming import jobs as J
from tidemark.streaming.folds import HOUR_US, RateFold

REQ = "kind string, ts_us long, pos long"


def test_state_of_idle_keys_is_dropped(spark, tmp_path):
    """Two micro-batches hours apart, then a third one that lets the timers fire: the first keys hold nothing any more."""
    for n, (keys, at) in enumerate([("abc", 1), ("xy", 4), ("z", 7)]):
        rows = [(k, at * HOUR_US + i * 1_000_000, 100 * n + i) for k in keys for i in range(20)]
        spark.createDataFrame(rows, REQ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    out = J.rate_limit_stream(stream, ["kind"], RateFold(5), "10 seconds")
    J.run_available(out, f"{tmp_path}/check", J.table_sink(f"{tmp_path}/out"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {r.kind: r.n for r in got.filter("accepted").groupBy("kind").agg(F.count("*").alias("n")).collect()} == {k: 5 for k in "abcxyz"} and got.count() == 120
    held = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "held").load()
    assert {r.key.kind if hasattr(r.key, "kind") else r.key[0] for r in held.select("key").collect()} <= {"z", "x", "y"}


def test_tail_reads_little(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "logs").mkdir()
    big = tmp_path / "logs" / "big.log"
    with open(big, "wb") as f:
        for i in range(400_000):
            f.write(b"%d %s\n" % (i, b"x" * rng.randrange(80)))
    (tmp_path / "logs" / "crlf.log").write_bytes("é\r\nlast one \xff".encode("latin-1"))
    (tmp_path / "logs" / "empty.log").write_bytes(b"")
    (tmp_path / "logs" / "few.log").write_bytes(b"a\n\nb\n")
    (tmp_path / "logs" / "long.log").write_bytes(b"y" * 300_000 + b"\nend\n")
    got = {}
    for r in readers.file_tails(spark, f"{tmp_path}/logs", 500).sort("path", F.col("place").desc()).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    want = big.read_bytes().decode().splitlines()[-500:]
    assert [r.line for r in got["big.log"]] == want and got["big.log"][0].bytes_read < 1_000_000 < big.stat().st_size
    assert [r.line for r in got["few.log"]] == ["a", "", "b"] and [r.line for r in got["crlf.log"]] == ["\ufffd", "last one \ufffd"]
    assert "empty.log" not in got and [len(r.line) for r in got["long.log"]] == [300_000, 3]
