"""Line deduplication by pairwise alignment of overlapping documents.

1. Every line with a word is hashed, and the documents that hold it are counted. A rare line (at most RARE holders) pairs each holder with every earlier one: three
   partners at most. A line with more holders pairs each holder with the first one only. Line pairs whose own lines together have fewer than MIN_WORDS words are dropped.
2. So is every shortest run of adjacent shared lines that reaches MIN_WORDS words, forwards or backwards from a line: each holder is paired with the run's first holder. These
   runs cover every line of any block that long, so a document that has a block always meets the first document that has each of its parts, however frequent its lines are.
3. The two line sequences are aligned by patience diff: lines that occur once in both, longest increasing chain of their places, then the same between the
   links of the chain, and equal lines next to aligned ones are taken in. A range without such a line is aligned at its heaviest common run of MIN_WORDS words or more.
4. Runs of aligned lines that follow each other in both documents are blocks; those of MIN_WORDS words or more are deleted from the later document.

Documents are ordered by id, rows without id last, equal ids by text. Lines are compared by a 64-bit hash of their bytes without ASCII white space at the ends. A line that
is repeated within a document counts once in 1 and is no anchor in 3. A null text has no lines. A document all of whose lines are deleted stays, with an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fields, map_texts, query, table

RARE = 4
MIN_WORDS = 12
LINES = fields(hashes="array<bigint>", words="array<int>")


def line_keys(text: bytes) -> tuple[list[int], list[int]]:
    """Hash and word count of each line; a line without words has hash 0 and no words."""
    from xxhash import xxh64_intdigest
    lines = [x.strip() for x in text.split(b"\n")]
    return [xxh64_intdigest(x) - (1 << 63) if x else 0 for x in lines], [len(x.split()) for x in lines]


def chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence rising in both coordinates, of pairs that rise in the first (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(places):
        at = bisect_left(tops, y)
        tops[at:at + 1] = [y]
        piles[at:at + 1] = [i]
        back.append(piles[at - 1] if at else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(places[i])
        i = back[i]
    return out[::-1]


def heaviest_run(a: list[int], b: list[int], words: list[int]) -> tuple[int, int, int, int]:
    """(words, start in a, start in b, lines) of the common run of adjacent lines with the most words; `words` are those of b. By a suffix automaton of a."""
    step: list[dict[int, int]] = [{}]
    size, link, at = [0], [-1], [0]      # at: an end in a
    last = 0
    for i, x in enumerate(a, 1):
        new = len(step)
        step.append({})
        size.append(i)
        link.append(0)
        at.append(i)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                at.append(at[q])
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    best, state, n = (0, 0, 0, 0), 0, 0
    for k, x in enumerate(b, 1):
        while state and x not in step[state]:
            state = link[state]
            n = size[state]
        if x in step[state]:
            state, n = step[state][x], n + 1
        if total[k] - total[k - n] > best[0]:
            best = total[k] - total[k - n], at[state] - n, k - n, n
    return best


def patience(a: list[int], b: list[int], words: list[int] | None = None, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Aligned places of two line sequences, rising in both. `words` are those of b's lines, one each by default."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    words = words or [1] * len(b)
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        at = {x: y for y, x in enumerate(b[k:m], k) if cb[x] == 1}
        anchors = chain([(y, at[x]) for y, x in enumerate(a[i:j], i) if ca[x] == 1 and x in at])
        if not anchors and sum(w for x, w in zip(b[k:m], words[k:m]) if x in ca) >= min_words:
            # a run below min_words that touches no aligned line is no block, whatever is aligned beside it
            weight, p, q, n = heaviest_run(a[i:j], b[k:m], words[k:m])
            anchors = [(i + p + x, k + q + x) for x in range(n)] if weight >= min_words else []
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)]):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def common_lines(early: list[int], late: list[int], words: list[int], min_words: int) -> list[int]:
    """Places in `late` of the lines of all aligned blocks of at least `min_words` words."""
    # lines without words are left out of the alignment; a block runs on across them
    a = [x for x in early if x]
    place = [i for i, x in enumerate(late) if x]
    pairs = patience(a, [late[i] for i in place], [words[i] for i in place], min_words)
    found: list[int] = []
    block: list[int] = []
    for n, (x, y) in enumerate(pairs):
        block.append(place[y])
        if n + 1 == len(pairs) or pairs[n + 1] != (x + 1, y + 1):
            if sum(words[i] for i in block) >= min_words:
                found += block
            block = []
    return found


def run_keys(hashes: list[int], words: list[int], shared: set[int], min_words: int) -> list[int]:
    """Hashes of the shortest runs of adjacent shared lines that reach `min_words` words, forwards or backwards from a line; lines without words do not count."""
    from xxhash import xxh64_intdigest
    keys: set[int] = set()
    run: list[tuple[int, int]] = []
    for h, w in [*((h, w) for h, w in zip(hashes, words) if w), (0, 0)]:
        if h in shared:
            run.append((h, w))
            continue
        if sum(w for _, w in run) >= min_words:
            image = np.array([h for h, _ in run], np.int64)
            total = np.cumsum([0, *(w for _, w in run)])
            ahead = np.searchsorted(total, total[:-1] + min_words)                # end of the shortest run from each line
            back = np.searchsorted(total, total[1:] - min_words, "right") - 1     # start of the shortest run up to each line
            spans = {(i, e) for i, e in enumerate(ahead.tolist()) if e <= len(run)} | {(i, e) for e, i in enumerate(back.tolist(), 1) if i >= 0}
            keys.update(xxh64_intdigest(image[i:e].tobytes()) - (1 << 63) for i, e in spans)
        run = []
    return list(keys)


def overlaps(lines: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(late, early): places in the order of documents of the pairs to align. `lines` has place, hashes and words, one row per document."""
    held = lines.select("place", F.explode(F.arrays_zip("hashes", "words")).alias("l")).filter("l.words > 0").select("place", F.col("l.hashes").alias("line"), F.col("l.words").alias("words")).distinct()
    shared = held.groupBy("line").agg(F.count("*").alias("holders"), F.min("place").alias("first")).filter("holders > 1")
    known = cut(held.join(shared, "line"))
    hub = known.filter(F.col("place") > F.col("first")).select(F.col("place").alias("late"), F.col("first").alias("early"), "words", "line")
    few = known.filter(F.col("holders").between(3, rare)).groupBy("line").agg(F.max("words").alias("words"), F.sort_array(F.collect_list("place")).alias("p"))
    others = few.select("line", "words", "p", F.posexplode(F.slice("p", 2, rare)).alias("i", "early")).select("line", "words", "early", F.explode(F.slice(F.col("p"), F.col("i") + 3, F.lit(rare))).alias("late"))
    by_line = hub.unionByName(others.select("late", "early", "words", "line")).groupBy("late", "early").agg(F.sum("words").alias("n")).filter(F.col("n") >= min_words).select("late", "early")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found = [run_keys(h, w, set(s), min_words) for h, w, s in zip(*(t.column(k).to_pylist() for k in (1, 2, 3)))]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.column(0).to_numpy(), sizes), pa.int64()), pa.array([k for x in found for k in x], pa.int64())], names=["place", "run"])

    runs = lines.join(known.groupBy("place").agg(F.collect_list("line").alias("shared")), "place").select("place", "hashes", "words", "shared").mapInArrow(keys, "place bigint, run bigint")
    held_runs = cut(runs)
    first = held_runs.groupBy("run").agg(F.min("place").alias("early"), F.count("*").alias("holders")).filter("holders > 1").select("run", "early")
    by_run = held_runs.join(first, "run").filter("place > early").select(F.col("place").alias("late"), "early")
    return by_line.unionByName(by_run).distinct()


def deletions(lines: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, gone, partners): the line numbers to delete from each document that has any, and the number of documents they align with."""
    pairs = overlaps(lines, rare, min_words)
    sides = pairs.join(lines.select(F.col("place").alias("early"), F.col("hashes").alias("a")), "early").join(lines.select(F.col("place").alias("late"), F.col("hashes").alias("b"), "words"), "late")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = [(p, common_lines(x, y, w, min_words)) for p, x, y, w in zip(*(t.column(i).to_pylist() for i in (0, 2, 3, 4)))]
            table = pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["place", "early", "gone"])
            yield table.filter(pa.array([bool(r[1]) for r in rows], pa.bool_()))

    found = sides.select("late", "early", "a", "b", "words").mapInArrow(align, "place bigint, early bigint, gone array<int>")
    return found.groupBy("place").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.count("*").alias("partners"))


def in_order(docs: DataFrame, doc_id: str) -> DataFrame:
    """`docs` sorted by id over partitions, with `place`: numbers that rise with that order."""
    cols = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("id")]
    return docs.select(cols).repartitionByRange(F.col("id").asc_nulls_last(), F.xxhash64("doc")).sortWithinPartitions(F.col("id").asc_nulls_last(), F.xxhash64("doc")).select("doc", F.monotonically_increasing_id().alias("place"))


def align_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE, min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """`doc` with n_lines, n_deleted, n_partners and kept_text, the text without the deleted lines (null for a null text)."""
    rows = cut(in_order(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*(keep or docs.columns), doc_id, text])]), doc_id))
    lines = cut(map_texts(rows.select("place", F.col(f"doc.`{text}`").alias("text")), "text", lambda ts: [line_keys(t) for t in ts], LINES, ["place"]).select("doc.place", "out.*"))
    gone = deletions(lines, rare, min_words)
    both = rows.join(gone, "place", "left")
    parts = F.split(F.col(f"doc.`{text}`"), "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i))
    return both.select("doc", F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_deleted"),
                       F.coalesce("partners", F.lit(0)).cast("bigint").alias("n_partners"), F.when(F.col("gone").isNull(), F.col(f"doc.`{text}`")).otherwise(F.array_join(left, "\n")).alias("kept_text"))


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with shorter texts, and their length brought up to date if they have that column."""
    rows = align_lines(docs, doc_id, text)
    value = {text: F.col("kept_text")} | ({n_chars: F.when(F.col("n_deleted") > 0, F.char_length("kept_text")).otherwise(F.col(f"doc.`{n_chars}`")).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return rows.select(*[value.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


@query("op5_line_alignment")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc.doc_id", "n_lines", "n_deleted", "n_partners", F.char_length(F.coalesce("kept_text", F.lit(""))).cast("bigint").alias("kept_chars"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
