"""File inputs as DataFrames with declared schemas."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.attrs import is_json
from tidemark.functions.text import clean_zero_width
from tidemark.operators.observations import parse_date_price

_DATE_DIR = r"(\d{4}-\d{2}-\d{2})/[^/]*$"
_NODE = r'<node[^>]*text="([^"]*)"[^>]*content-desc="([^"]*)"[^>]*bounds="\[(\d+),(\d+)\]\[(\d+),(\d+)\]"'


def path_date(path: Column) -> Column:
    """Date of the folder (plain or key=value) that holds a file."""
    return F.regexp_extract(path, _DATE_DIR, 1)


def read_observations(spark: SparkSession, path: str, stream: bool = False, lines: bool = False) -> DataFrame:
    """JSON array files (or, with lines=True, one row per line, which large files should use so that they can be
    split), one folder per collection date. Prices stay text, so that bad ones can be told apart.

    `pos` orders rows by file and place in it, however Spark packs the files; a stream gets its last part per batch.
    """
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(schemas.RAW_OBSERVATION).option("multiLine", not lines).json(path)
    rows = raw.select("*", path_date(F.col("_metadata.file_path")).alias("collected_on"),
                      F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("place"))
    return rows if stream else with_position(rows)


def with_position(rows: DataFrame) -> DataFrame:
    """Turns `place` into the full row order `pos` (file, split, running number); batch frames only."""
    return rows.withColumn("pos", F.struct("place.file", "place.at", F.monotonically_increasing_id().alias("i"))).drop("place")


def read_trend_dump(spark: SparkSession, path: str) -> DataFrame:
    """Collection dumps: one row per listing with its parsed points."""
    dump = spark.read.schema(schemas.TREND_DUMP).option("multiLine", True).json(path)
    rows = dump.select("fetched_at", path_date(F.col("_metadata.file_path")).alias("date"), F.inline("listings"))
    return rows.withColumn("points", parse_date_price(F.col("trend.datePrice")))


def read_segment_trends(spark: SparkSession, path: str) -> DataFrame:
    from tidemark.operators.observations import normalize_segment_trend

    return normalize_segment_trend(spark.read.schema(schemas.SEGMENT_TREND).option("multiLine", True).json(path))


def read_event_log(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Append-only JSON lines, as a batch or as a stream of new files."""
    if stream:
        return spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)
    return spark.read.schema(schemas.EVENT).json(path)


def read_inbox(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One task per JSON file: the task's columns, its size, and the file name as position; `bad_json` marks the rest."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema("value string").option("wholetext", True).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("pos"), F.octet_length("value").alias("bytes"),
                      (~is_json(F.col("value"))).alias("bad_json"), F.from_json("value", schemas.INBOX_TASK).alias("t"))
    return rows.select("pos", "bytes", "bad_json", "t.*")


_LISTS = {"sources": ("sources", "results", "items"), "claims": ("claims", "results", "items")}


def parse_wrapped_list(body: Column, kind: str) -> Column:
    """JSON text of each object in a list that may be wrapped in an object; [] for other shapes."""
    keys = _LISTS[kind]
    lists = [F.when(F.startswith(F.trim(body), F.lit("[")), body),
             *[F.when(F.startswith(F.get_json_object(body, f"$.{k}"), F.lit("[")), F.get_json_object(body, f"$.{k}")) for k in keys]]
    items = F.coalesce(F.from_json(F.coalesce(*lists), "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: F.startswith(F.trim(x), F.lit("{")))


def list_issue(body: Column, items: Column) -> Column:
    """Why a source list is empty: no file, not JSON, or another shape; null when it has entries."""
    return (F.when(body.isNull(), "no_sources_json").when(~is_json(body), "sources_json_invalid")
            .when(F.size(items) == 0, "sources_json_bad_shape"))


def read_sources_claims(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(entries, issues) of `*.sources.json` or `*.claims.json`, files or folders of that name; ids may be called `id`, nothing is made up."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), rf"([^/=]+)\.{kind}\.json(?:/[^/]+)?$", 1).alias("task_id"), F.col("value").alias("body"))
    tagged = files.withColumn("items", parse_wrapped_list(F.col("body"), kind))
    schema = schemas.SOURCE_FILE if kind == "sources" else schemas.CLAIM_FILE
    name = "source_id" if kind == "sources" else "claim_id"
    rows = tagged.select("task_id", F.posexplode("items").alias("pos", "_j")).select(
        "task_id", "pos", F.from_json("_j", schema).alias("r")).select("task_id", "pos", "r.*")
    rows = rows.withColumn(name, F.coalesce(name, "id")).drop("id")
    issues = tagged.select("task_id", list_issue(F.col("body"), F.col("items")).alias("issue")).filter("issue is not null")
    return rows, issues


def parse_screen_nodes(dumps: DataFrame, keys=("screen_id",)) -> DataFrame:
    """UI dumps (XML text in `xml`) to visible nodes in document order: text, else description, cleaned."""
    nodes = dumps.select(*keys, F.posexplode(F.regexp_extract_all("xml", F.lit(f"({_NODE})"), 1)).alias("pos", "_n"))

    def part(i):
        return F.regexp_extract("_n", _NODE, i)

    text = clean_zero_width(part(1))
    val = F.when(text != "", text).otherwise(clean_zero_width(part(2)))
    return nodes.select(*keys, "pos", part(4).cast("int").alias("y1"), part(6).cast("int").alias("y2"),
                        part(3).cast("int").alias("x1"), val.alias("val")).filter("val <> ''")


def read_screen_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Files or folders named <keyword>_s<screen>.xml."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)\.xml(?:/[^/]+)?$", 1).alias("screen_id"),
                                                       F.col("value").alias("xml"))
    return parse_screen_nodes(raw)


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognition results with their place on the page; a page is a file, or a folder named *.json."""
    raw = spark.read.schema(schemas.OCR_PAGE).option("multiLine", True).json(path)
    folder = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+\.json)/[^/]+$", 1), F.lit(""))
    w = raw.select(F.coalesce(folder, "_metadata.file_name").alias("page_id"), F.explode("Words").alias("w"))
    return w.select("page_id", F.coalesce("w.BoundingRect.Top", F.lit(0)).alias("y"), F.coalesce("w.BoundingRect.Left", F.lit(0)).alias("x"),
                    F.trim("w.Text").alias("text")).filter("text <> ''")


def all_text_values(body: Column) -> Column:
    """Every `Text` value anywhere in a JSON text, in order and as it stands there.

    Escaped backslashes and quotes are put aside as control characters, which JSON has only escaped, so that a value of any length is one run of characters to the regex.
    """
    plain = F.replace(F.replace(body, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    hits = F.regexp_extract_all(plain, F.lit(r'"Text"\s*:\s*"([^"]*+)"'), 1)
    back = lambda t: F.replace(F.replace(t, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.filter(F.transform(hits, lambda t: F.trim(back(t))), lambda t: t != "")


def file_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines per file. Large files are split over tasks and only counts are shuffled."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_lines"))


_DIGEST = "path string, bytes long, sha256 string, preview array<string>"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads each file once in blocks: hash and first five lines, in memory that does not depend on the size."""
    for pdf in batches:
        rows = []
        for uri, size in zip(pdf["path"], pdf["bytes"]):
            fs, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
            sha, lines, open_line = hashlib.sha256(), [], b""
            with fs.open_input_stream(name) as f:
                while block := f.read(1 << 20):
                    sha.update(block)
                    for part in block.splitlines(keepends=True) if len(lines) < 5 else ():
                        open_line += part[:2000 - len(open_line)]     # 500 characters are 2000 bytes at most
                        if part.endswith((b"\n", b"\r")) and len(lines) < 5:
                            lines.append(open_line)
                            open_line = b""
            if open_line and len(lines) < 5:
                lines.append(open_line)
            text = [ln.decode("utf-8", "ignore").rstrip("\r\n")[:500] for ln in lines]
            rows.append((uri, size, sha.hexdigest(), text))
        yield pd.DataFrame(rows, columns=["path", "bytes", "sha256", "preview"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Size, sha256 and first five lines per file. Spark spreads the files; a task streams one at a time, since
    a hash needs its bytes in order and a file may be larger than any row."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    return files.mapInPandas(_digest, _DIGEST)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return file_digests(spark, path).select("path", "bytes", "sha256")


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256, bytes, data rows (lines less the header, counted over file splits) and a preview of five lines per file."""
    out = file_digests(spark, path).join(file_row_counts(spark, path), "path", "left")
    return out.select("path", "sha256", "bytes", F.greatest(F.coalesce("n_lines", F.lit(0)) - 1, F.lit(0)).alias("rows"), "preview")


TAIL_BLOCK = 1 << 16


def _last_lines(f, size: int, n: int) -> tuple[list[bytes], int]:
    """The last n lines of an open file and the bytes read for them: blocks from the end until there are enough line ends."""
    blocks, ends, at = [], 0, size
    while at > 0 and ends <= n:
        step = min(TAIL_BLOCK, at)
        at -= step
        f.seek(at)
        blocks.append(f.read(step))
        ends += blocks[-1].count(b"\n")
    lines = b"".join(reversed(blocks)).split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return (lines[-n:] if n else []), size - at


def file_tails(spark: SparkSession, path: str, n: int = 120) -> DataFrame:
    """(path, place, line, bytes_read): the last n lines of every file, place 1 being the last; n is held to 10..500. A task reads a file from its end and only as far as it must.

    Bytes that are no UTF-8 become the replacement character, line ends of either kind are dropped, an empty file has no rows.
    """
    n = max(10, min(500, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, size in zip(pdf["path"], pdf["bytes"]):
                fs, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with fs.open_input_file(name) as f:
                    lines, read = _last_lines(f, int(size), n)
                yield pd.DataFrame({"path": uri, "place": range(len(lines), 0, -1), "line": [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], "bytes_read": read})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    return files.mapInPandas(run, "path string, place long, line string, bytes_read long")


def report_catalog(spark: SparkSession, path: str, days: int, labels: Mapping[str, str]) -> DataFrame:
    """Files of the newest dates with label and size; only file metadata is read, and only the files of those dates are gathered."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    f = f.withColumn("date", path_date(F.col("path"))).withColumn("name", F.element_at(F.split("path", "/"), -1)).filter("date <> ''")
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    newest = f.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
    per_day = f.join(newest, "date", "left_semi").groupBy("date").agg(F.array_sort(F.collect_list(F.struct(
        "name", F.coalesce(F.try_element_at(label, F.col("name")), F.col("name")).alias("label"), "size"))).alias("files"))
    return per_day.orderBy(F.col("date").desc())


def read_market_csv(spark: SparkSession, path: str, market_col: str = "市场", day_prefix: str = "交易日") -> DataFrame:
    """Market and trade day of a CSV whose day column only has to start with the prefix."""
    raw = spark.read.option("header", True).csv(path)
    day = next((c for c in raw.columns if c.startswith(day_prefix)), None)
    if day is None or market_col not in raw.columns:
        raise ValueError(f"columns {raw.columns[:6]} lack {market_col} or {day_prefix}*")
    rows = raw.select(F.trim(F.col(f"`{market_col}`")).alias("market"), F.trim(F.col(f"`{day}`")).alias("day"))
    return rows.filter("market <> '' AND day <> ''")
