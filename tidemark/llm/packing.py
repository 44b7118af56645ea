"""Vector best-fit packing of documents into sequences.

Each sequence (bin) has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Pieces are taken in
falling order of length; of the open bins that can hold a piece in every dimension, the one with the best score takes it: the smallest
weighted norm of what would be left (`norm`), or the largest weighted product of demand and room (`dot`). No fitting bin: a new one.

A document longer than a sequence is cut into full pieces, the remainder in front; full pieces are sequences by themselves. The other
pieces are dealt by hash into groups of about GROUP pieces, whatever their source, and each group is packed by one task: memory follows the
group, the number of groups follows the data, and at most the last bins of a group stay open.

A null text is empty and still takes its end id. Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fields, map_texts, query, table
from tidemark.llm.tokens import coder

TOKENS = 1024
GROUP = 8_000
REMEMBERED = 500_000      # word parts: by default, as pieces share a worker's memory with what ran before
PIECES = fields(starts="array<bigint>", lengths="array<bigint>", crcs="array<bigint>")


def cut_points(n: int, size: int) -> list[int]:
    """Starts of the pieces of a document of n ids: full pieces behind, the remainder in front."""
    first = n % size or size
    return [0, *range(first, n, size)]


def pieces(docs: DataFrame, text: str = "text", size: int = TOKENS, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, keep: list[str] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: `doc`, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(texts: list[bytes]) -> list[tuple]:
        c = coder(tokenizer, remembered)
        rows = []
        for t in texts:
            ids = c.encode(t.decode("utf-8", "replace")) + end
            at = cut_points(len(ids) // 4, size)
            to = [*at[1:], len(ids) // 4]
            rows.append((at, [b - a for a, b in zip(at, to)], [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(at, to)]))
        return rows

    rows = map_texts(docs, text, encode, PIECES, keep)
    return rows.select("doc", F.posexplode(F.arrays_zip("out.starts", "out.lengths", "out.crcs")).alias("piece", "p")).select(
        "doc", "piece", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"))


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.2), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, given in falling order of length. Bins with no room for the smallest piece are closed."""
    cap = np.array(capacity, float)
    w = np.array(weights)
    left = np.empty((3, 1024))
    name = np.empty(1024, np.int64)
    n = made = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = lengths[-1] if len(lengths) else 0
    for i, x in enumerate(lengths.tolist()):
        need = np.array([x, 1.0, float(x) * x])
        best = -1
        if n:
            room = left[:, :n]
            fits = np.flatnonzero((room[0] >= x) & (room[1] >= 1) & (room[2] >= need[2]))
            if len(fits):
                share = room[:, fits] / cap[:, None]
                d = (need / cap)[:, None]
                best = fits[int(np.argmax((w[:, None] * share * d).sum(0)) if score == "dot" else np.argmin((w[:, None] * (share - d) ** 2).sum(0)))]
        if best < 0:
            if n == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([name, np.empty_like(name)])
            best, n = n, n + 1
            left[:, best] = cap
            name[best] = made
            made += 1
        bins[i] = name[best]
        offsets[i] = int(cap[0] - left[0, best])
        left[:, best] -= need
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < float(least) * least:
            n -= 1
            left[:, best], name[best] = left[:, n], name[n]
    return bins, offsets


def pack(cut_docs: DataFrame, size: int = TOKENS, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm", group: int = GROUP) -> DataFrame:
    """`pieces` rows with sequence_id and offset. Without further limits, documents and cost are bounded by the tokens alone."""
    capacity = (size, max_docs or size, max_cost or size * size)
    n = cut_docs.filter(F.col("length") < size).count()
    groups = max(1, -(-n // group))
    deal = F.pmod(F.xxhash64("doc", "piece"), F.lit(groups)).cast("int")
    alone = F.col("length") >= size
    # full pieces fill a sequence each: numbered below zero by place in their partition's range
    full = cut_docs.filter(alone).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut_docs.filter(~alone).select("*", deal.alias("deal"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("order", "ascending")])
        b, o = best_fit(t["length"].to_numpy(), capacity, score=score)
        return t.drop_columns(["deal", "order"]).append_column("sequence_id", pa.array(b + (key[0].as_py() << 32))).append_column("offset", pa.array(o))

    dealt = rest.withColumn("order", F.xxhash64("doc", "piece"))
    schema = T.StructType([*cut_docs.schema, *fields(sequence_id="bigint", offset="bigint")])
    return full.unionByName(dealt.groupBy("deal").applyInArrow(run, schema))


def pack_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, remembered: int = REMEMBERED, **limits) -> DataFrame:
    """Documents to packed pieces; the pieces are written once, as packing counts them first. A worker remembers the ids of `remembered` word parts."""
    return pack(cut(pieces(docs, text, keep=keep, remembered=remembered)), **limits)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack_documents(table(spark, sf_dir, "documents"), keep=["doc_id"], remembered=800_000)
    return rows.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
