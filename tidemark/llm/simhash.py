"""SimHash near-duplicates by anchor-point covering.

A fingerprint is the majority vote of the bits of its shingles' hashes. Two fingerprints link if they differ in at most THRESHOLD = 3 bits. Of their two
32-bit halves one differs in at most one bit, so each half is looked at with threshold 1: the anchors are the code words of the (31, 26)
Hamming code over 31 of its bits, a perfect code of covering radius 1. A fingerprint lives at the one anchor within radius 1 and visits every anchor within
radius + threshold = 2 (16 at most). If two fingerprints differ in at most one bit of a half, either visits the other's home, so every link is found
at an anchor where one lives.

Only distinct fingerprints take part, so copies cost nothing; anchors that a single fingerprint visits are dropped before comparing. An anchor with more
than BLOCK visitors is split into blocks, and each pair of blocks is compared by a task of its own. A task hands on no pairs but the edges of a spanning
forest of what it saw linked; components come from these by label propagation over written tables.

The pipeline's stage (drop_near_copies) has its own rule: two documents are near copies if the Jaccard similarity of their sets of five-word shingles is at
least 0.8. Such pairs differ in about 15 % of the bits of any simhash, too many for anchors, so its fingerprints are 24 bands of four minima of the shingles'
hashes. Two sets of similarity s share a band with probability 1 - (1 - s^4)^24, which leaves out 3 of a million pairs at 0.8. Sets that meet in a band are compared
exactly before they link: each with the first one of the band, then those of the band that are not connected yet with each other, in blocks of COPY_BLOCK: a task per pair of
blocks looks at the minima first (sets of similarity 0.8 agree in fewer than 0.55 of 96 minima once in a billion times), at the sets where these are alike, and
hands on the edges of a spanning forest.

A null text is empty, with fingerprint zero, and links like any other. Repeated rows and ids share a component. The component of rows without any id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fields, map_texts, query, table

WORDS = 3
THRESHOLD = 3
BLOCK = 2048

#: Near copies of the pipeline's stage: words of a shingle, least similarity as a fraction, bands and hash functions of a band.
COPY_WORDS = 5
SIMILARITY = (4, 5)
BANDS = 24
BAND_ROWS = 4
COPY_BLOCK = 512
ALIKE = 0.55
MIX, SHIFT = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
MIX |= np.uint64(1)

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)

#: Column i of the parity check matrix is the number i, so the syndrome of a word is the xor of the places (1 to 31) of its ones. By syndrome: what to flip to
#: reach each anchor within distance 2, the home first.
PLACES = np.arange(1, 32, dtype=np.uint64)
FLIPS = np.array([[0] * 16] + [[1 << (s - 1), *((1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a < a ^ s)] for s in range(1, 32)], np.uint64)


def simhash(text: bytes, words: int = WORDS) -> int:
    """64-bit fingerprint of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest
    w = text.translate(FOLD).split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*[w[i:] for i in range(words)]))
    h = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`doc` and fp, the fingerprint as a signed 64-bit integer."""
    def run(texts: list[bytes]) -> list[tuple]:
        return [(x - (1 << 64) if x >> 63 else x,) for x in map(simhash, texts)]
    return map_texts(docs, text, run, fields(fp="bigint"), keep).select("doc", "out.fp")


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (n, 16) anchors that each 32-bit half visits, its home first, and how many of them count: 1 if it is a code word itself, else 16."""
    word = half & np.uint64(0x7FFFFFFF)
    ones = (word[:, None] >> (PLACES - np.uint64(1))) & np.uint64(1)
    syndrome = np.bitwise_xor.reduce(ones * PLACES, axis=1)
    return word[:, None] ^ FLIPS[syndrome.astype(np.int64)], np.where(syndrome > 0, 16, 1)


def visits(distinct: DataFrame) -> DataFrame:
    """(anchor, home, fp): the anchors of both halves that each fingerprint visits; `anchor` carries the number of the half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            for half in (0, 1):
                found, n = anchors((bits >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                use = np.arange(16) < n[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(found[use].astype(np.int64) + (half << 32)), pa.array((use & (np.arange(16) == 0))[use]), pa.array(np.repeat(fp, n))], names=["anchor", "home", "fp"])
    return distinct.select("fp").mapInArrow(run, "anchor bigint, home boolean, fp bigint")


def forest(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints within `threshold` bits of each other."""
    edges, rest = [], fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                edges += [(int(x), int(y)) for y in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return edges


def links(distinct: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints which a chain of links connects."""
    all_visits = visits(distinct)
    busy = cut(all_visits.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("lived_in")).filter("n > 1 AND lived_in").select("anchor", F.expr(f"(n + {block - 1}) div {block}").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), F.col("own"))))
    met = all_visits.join(busy, "anchor").withColumn("own", own).select("anchor", "fp", "own", other.alias("other"))
    dealt = met.select("anchor", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            at = borders(t)
            left = t.slice(at[-1])
            yield compare(t, at)
        if left is not None:
            yield compare(left, [*borders(left), len(left)])

    def borders(t: pa.Table) -> list[int]:
        keys = [t[c].to_numpy() for c in ("anchor", "p", "q")]
        return [0, *(1 + np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))).tolist()]

    def compare(t: pa.Table, at: list[int]) -> pa.RecordBatch:
        fp = t["fp"].to_numpy()
        edges = [e for i, j in zip(at, at[1:]) if j - i > 1 for e in forest(fp[i:j], threshold)]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches, by turns of large and small stars until nothing moves."""
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, low): the least `low` among all fingerprints of the component. `classes` has distinct fp with their own low, and is read several times."""
    roots = components(links(classes, threshold))
    own = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return own.join(own.groupBy("root").agg(F.min("low").alias("least")), "root").select("fp", F.col("least").alias("low"))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's COPY_WORDS-word shingles."""
    from xxhash import xxh64_intdigest
    w = text.translate(FOLD).split()
    shingles = map(b" ".join, zip(*[w[i:] for i in range(COPY_WORDS)])) if len(w) > COPY_WORDS else [b" ".join(w)] if w else []
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a shingle set."""
    low = np.full(len(MIX), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 10):
        low = np.minimum(low, (h[i:i + (1 << 10), None] * MIX + SHIFT).min(0))
    return low


def bands(h: np.ndarray) -> list[int]:
    """BANDS keys of a shingle set, each from the minima of BAND_ROWS hash functions."""
    from xxhash import xxh64_intdigest
    if not len(h):
        return []
    return [xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(minima(h).reshape(BANDS, BAND_ROWS))]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of at least SIMILARITY."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose shingle sets are near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sides = [[x.values.to_numpy() for x in t.column(k)] for k in (2, 3)]
            yield t.select(["a", "b"]).filter(pa.array([near(x, y) for x, y in zip(*sides)], pa.bool_()))
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return cut(sides.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def copy_links(classes: DataFrame, texts: DataFrame, block: int = COPY_BLOCK) -> DataFrame:
    """(a, b): edges that connect the near nodes. `classes` has distinct shingle sets as node, n (its size) and keys (its bands), `texts` has node and text for all of them."""
    homes = classes.select("node", "n", F.explode("keys").alias("key"))
    met = cut(homes.join(homes.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("hub")).filter("c > 1"), "key").select("key", "node", "n", "hub"))
    sized = lambda x, y: (SIMILARITY[1] * F.least(x, y) >= SIMILARITY[0] * F.greatest(x, y))
    wanted = texts.join(met.select("node").distinct(), "node", "left_semi")
    sets = cut(map_texts(wanted, "text", lambda ts: [(shingle_set(t).view(np.int64),) for t in ts], fields(hashes="array<bigint>"), ["node"]).select("doc.node", "out.hashes"))
    # each member of a band against the band's first, then those of a band that are not connected by then
    first = checked(met.filter(F.col("node") > F.col("hub.node")).filter(sized(F.col("n"), F.col("hub.n"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), sets)
    roots = components(first).withColumnRenamed("root", "known")
    apart = met.join(roots, "node", "left").select("key", "node", "n", F.coalesce("known", "node").alias("root"), F.col("hub.node").alias("hub"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("c")).filter("p < q AND c > 2").select("key")
    left = cut(apart.join(mixed, "key", "left_semi").filter("node > hub"))
    return first.unionByName(cut(met_in_blocks(left, sets, block)))


def met_in_blocks(left: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(a, b): edges that connect the near nodes of each band which `left` (key, node, root) does not know as connected."""
    sizes = left.groupBy("key").agg(F.expr(f"(count(*) + {block - 1}) div {block}").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), F.col("own"))))
    dealt = left.join(sizes, "key").withColumn("own", own).select("key", "node", "root", "own", other.alias("other")).select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "root")

    def run(t: pa.Table) -> pa.Table:
        edges = connect(t["node"].to_numpy(), t["root"].to_numpy(), lists(t["hashes"]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})
    return dealt.join(sets, "node").groupBy("key", "p", "q").applyInArrow(run, "a bigint, b bigint")


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for chunk in column.chunks for x in chunk]


def connect(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges between near sets that connect what `roots` leaves apart, no more than it takes."""
    group = np.unique(roots, return_inverse=True)[1]
    low = np.array([minima(x.view(np.uint64)) for x in sets])
    size = np.array([len(x) for x in sets])
    edges = []
    for i in range(len(nodes) - 1):
        away = i + 1 + np.flatnonzero(group[i + 1:] != group[i])
        away = away[SIMILARITY[1] * np.minimum(size[away], size[i]) >= SIMILARITY[0] * np.maximum(size[away], size[i])]
        for j in away[(low[away] == low[i]).mean(1) >= ALIKE].tolist():
            if group[j] != group[i] and near(sets[i], sets[j]):
                edges.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
    return edges


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near copies: the one with the smallest id, rows without id last; any one of equal rows."""
    from xxhash import xxh3_128_hexdigest

    def run(texts: list[bytes]) -> list[tuple]:
        return [(xxh3_128_hexdigest(h.tobytes()), len(h), bands(h)) for h in map(shingle_set, texts)]
    rows = cut(map_texts(docs, text, run, fields(same="string", n="bigint", keys="array<bigint>")).withColumn("row", F.monotonically_increasing_id()))
    key = F.col(f"doc.`{doc_id}`")
    low = F.struct(key.isNull().alias("lost"), key.alias("id"), F.col("row"))
    classes = cut(rows.groupBy("out.same").agg(F.min(F.struct(*[low[c].alias(c) for c in ("lost", "id", "row")], F.col("out.n").alias("n"), F.col("out.keys").alias("keys"))).alias("low")).select(F.col("low.row").alias("node"), F.col("low.n").alias("n"), F.col("low.keys").alias("keys"), F.struct("low.lost", "low.id", "low.row").alias("low")))
    roots = components(copy_links(classes, rows.select(F.col("row").alias("node"), F.col(f"doc.`{text}`").alias("text"))))
    stay = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("low").alias("low")).select(F.col("low.row").alias("row"))
    return rows.join(stay, "row", "left_semi").select("doc.*")


@query("op9_simhash_anchors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = cut(fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    classes = cut(fps.groupBy("fp").agg(F.min("doc.doc_id").alias("low")))
    return fps.join(groups(classes), "fp").select("doc.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))
