"""Session helpers: local builder for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tidemark", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in spark.checkpoint.dir. Only a local session may go without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_HELD = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frames cut inside are needed inside only: their folders are deleted at the end. For jobs that write their results themselves, such as the body of a micro-batch."""
    outer, _HELD.paths = getattr(_HELD, "paths", None), []
    try:
        yield
    finally:
        paths, _HELD.paths = _HELD.paths, outer
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            there.getFileSystem(conf).delete(there, True)


def _hold(path: str) -> str:
    if getattr(_HELD, "paths", None) is not None:
        _HELD.paths.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that a lost executor costs no replay."""
    path = _hold(f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Frames of an iteration kept as one folder per round, so that earlier rounds are never rewritten."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths, self.schema = spark, _hold(f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"), [], None

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
