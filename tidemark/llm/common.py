"""Shared pieces of the operators: table access, the checkpoint folder, and text batches handed to Python."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: ASCII white space: words are what lies between it.
SPACES = b" \t\n\r\x0b\x0c"
WORD_GAP = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL twin if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    return cut_lineage(df)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Rows of whole texts that pass between Spark and Python at once, and that Python turns into objects at once.
ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long: unless the session says otherwise, hand over fewer rows at once than Spark would."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def map_texts(df: DataFrame, text: str, fn: Callable[[list[bytes]], list[tuple]], fields: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Columns `doc` (a struct of the kept columns, all by default) and `out` (a struct of `fields`, one tuple of `fn` per text).

    `fn` gets the UTF-8 bytes of a batch of whole texts; a null text is passed as empty. Column names of `df` cannot clash with anything.
    """
    small_batches(df.sparkSession)
    kept = df.columns if keep is None else keep
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    schema = T.StructType([src.schema["doc"], T.StructField("out", fields)])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                cols = zip(*fn(b.column(1).to_pylist()))
                out = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], fields=[pa.field(n, k) for n, k in zip(names, kinds)])
                yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc", "out"])

    return src.mapInArrow(run, schema)


_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(**kinds: str) -> T.StructType:
    """A struct type from names and simple type names; `array<x>` for arrays."""
    kind = lambda v: T.ArrayType(_KINDS[v[6:-1]]) if v.startswith("array<") else _KINDS[v]
    return T.StructType([T.StructField(k, kind(v)) for k, v in kinds.items()])
