"""WARC archives of captured pages, and their index by an external merge.

Writing: one WARC 1.1 record per page, as files of the text sink whose line separator is the blank line that ends a record, so that any store Spark
can write to will do. Of records with equal payloads of MIN_SHARED bytes or more, the one with the largest id holds the payload; the others are revisit records
that refer to it. Reading: records are cut by their Content-Length; payloads are checked against their digest.

Index: each archive file gives a run of entries sorted by (URL key, time, id). Runs are dealt out by ranges of that key, about RANGE_ROWS entries at most, and in each range a
loser tree merges the slices of all runs, which leaves capture histories in one global order. A URL with many captures spreads over ranges.

A null html is an empty payload, a null url an empty one. Rows without an id count as the smallest; equal rows are each written, as responses if
their id is the largest of their payload. An empty table gives an empty archive and index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fields, new_folder, query, table

MIN_SHARED = 1000
PER_FILE = 1000         # records of one archive file, which one task reads as a whole
FILE_BYTES = 1 << 26    # payload bytes that a file of PER_FILE small pages may come to; files of larger pages hold fewer of them
RANGE_ROWS = 200_000    # index entries that one task merges
URN = "urn:capture:"
END = "\r\n\r\n"
ENTRY = fields(run="string", seq="int", url_key="string", captured="string", page_id="bigint", payload_bytes="bigint", payload_digest="string",
               record_type="string", refers_to="bigint", at="bigint", size="bigint")


def record(url: Column, captured: Column, page_id: Column, html: Column, digest: Column, refers_to: Column) -> Column:
    """The text of a record without its closing blank line; a revisit where refers_to is set."""
    revisit = refers_to.isNotNull()
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(page_id),
        F.lit("\r\nWARC-Date: "), captured, F.lit("\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(refers_to))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, per_file: int = PER_FILE) -> None:
    """Write the pages as WARC files below `path`. `captured` is the WARC date of a row, by default derived from its id."""
    when = captured if captured is not None else F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col(f"`{page_id}`"), F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"), when.alias("captured"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # the few digests that occur twice are written out first, so that their size is known and the pages need not be shuffled for them
    shared = cut(rows.filter(F.octet_length("html") >= MIN_SHARED).groupBy(F.col("digest").alias("shared")).agg(F.max("id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    both = rows.join(shared, F.col("digest") == F.col("shared"), "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))
    both = both.select(record(F.col("url"), F.col("captured"), F.col("id"), F.col("html"), F.col("digest"), refers).alias("value"), size_class(F.octet_length("html"), per_file).alias("class"))
    # pages by powers of two of their size, most tables have one class: a file is bounded by bytes as well as by records
    classes = sorted(r[0] for r in rows.select(size_class(F.octet_length("html"), per_file)).distinct().collect()) or [0]
    for c in classes:
        some = both.filter(F.col("class") == c) if len(classes) > 1 else both
        some.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, per_file >> c)).text(path)


def size_class(n_bytes: Column, per_file: int) -> Column:
    """How often the number of records in a file has to be halved for pages of this size."""
    small = max(1, FILE_BYTES // per_file)
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n_bytes, F.lit(1)) / small))).cast("int")


def url_key(url: str) -> str:
    """Sort-friendly form: host labels in reverse, then the path; scheme, fragment and a leading www. dropped."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).partition("#")[0]
    host = re.match(r"[^/?]*", rest)[0]
    return ",".join(reversed(re.sub(r"^www\.", "", host.lower()).split("."))) + ")" + rest[len(host):]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record of a file."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        lines = data[at:top].decode("utf-8").split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        end = top + 4 + int(head["content-length"])
        yield head, data[top + 4:end], at, end - at
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        at = end + 4


def _id(urn: str | None) -> int | None:
    name = urn[len(URN) + 1:-1] if urn else "none"
    return None if name == "none" else int(name)


def entry(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = head["warc-type"], head["warc-payload-digest"][5:]
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    return (url_key(head["warc-target-uri"]), head["warc-date"], _id(head["warc-record-id"]), size, digest, kind, _id(head.get("warc-refers-to")))


def order(e: tuple) -> tuple:
    return e[0], e[1], -1 if e[2] is None else 0, e[2] or 0


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archive files; each file is a run, sorted by (URL key, time, id) and numbered by `seq`."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                found = sorted(((entry(h, block), at, n) for h, block, at, n in parse(data.as_py())), key=lambda x: order(x[0]))
                rows = [(name.as_py().rsplit("/", 1)[-1], i, *e, at, n) for i, (e, at, n) in enumerate(found)]
                yield pa.RecordBatch.from_pylist([dict(zip(ENTRY.names, r)) for r in rows], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(ENTRY)
    return files.mapInArrow(run, ENTRY)


class LoserTree:
    """k sorted runs in, one sorted sequence of (run, place) out: inner nodes keep the loser of each match, so an advance replays one path."""

    DONE = (1,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.place, k = runs, [0] * len(runs), len(runs)
        self.heads = [(0, *r[0]) if r else self.DONE for r in runs]
        self.lost: list[int | None] = [None] * max(k, 1)
        for leaf in range(k):
            self.climb(leaf, True)

    def climb(self, who: int, fill: bool = False) -> None:
        node = (who + len(self.runs)) // 2
        while node:
            other = self.lost[node]
            if fill and other is None:
                self.lost[node] = who
                return
            if self.heads[other] < self.heads[who]:
                self.lost[node], who = who, other
            node //= 2
        self.lost[0] = who

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self.runs and self.heads[top := self.lost[0]] is not self.DONE:
            at = self.place[top]
            yield top, at
            self.place[top] = at + 1
            self.heads[top] = (0, *self.runs[top][at + 1]) if at + 1 < len(self.runs[top]) else self.DONE
            self.climb(top)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' entries with `place`, their position in the global order of (URL key, time, id). Give it a written table: ranges are found by sampling."""
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    ranges = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first()).sortWithinPartitions("run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=schema)
        keys = [order(e) for e in zip(*(t[c].to_pylist() for c in ("url_key", "captured", "page_id")))]
        starts: dict[str, int] = {}
        for i, r in enumerate(t["run"].to_pylist()):
            starts.setdefault(r, i)
        at = [*starts.values()]
        tree = LoserTree([keys[a:b] for a, b in zip(at, [*at[1:], len(keys)])])
        merged = t.take(pa.array([at[r] + i for r, i in tree], pa.int64()))
        part = TaskContext.get().partitionId()
        merged = merged.append_column("part", pa.array([part] * len(keys), pa.int32())).append_column("rank", pa.array(range(len(keys)), pa.int64()))
        yield from merged.combine_chunks().to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(runs.schema)
    merged = cut(ranges.mapInArrow(merge, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in runs.schema)}, part int, rank bigint"))
    before = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return merged.join(before, "part").select(*runs.columns, (F.col("before") + F.col("rank")).alias("place"))


_SQL = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS dg FROM pages),
  k AS (SELECT *, CASE WHEN n >= {MIN_SHARED} THEN max(page_id) OVER (PARTITION BY dg) END AS top, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS rest FROM p),
  u AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM k),
  v AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[.]', ''), '.')), ',') || ')' || substr(rest, length(host) + 1) AS url_key FROM u)
SELECT page_id, n AS payload_bytes, dg AS payload_digest, CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS place FROM v"""


@query("op4_warc_index", _SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return merge_runs(cut(capture_runs(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place")
