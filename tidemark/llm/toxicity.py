"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Grades 0 < 1 < ... < K share one weight vector; ordered thresholds t_1 <= ... <= t_K cut its score: P(grade >= k) = sigmoid(score - t_k). The expected severity of a text is the sum
of these probabilities. Features are the words of the whole text, in lower case without punctuation at their ends, and their beginnings of PREFIXES letters, hashed to FEATURES
places: one place says that it occurs, the next that it makes up a hundredth of the words or more, so that length alone says nothing. Weights carry an L1 penalty, which leaves most
at zero: words that only the sample ties to a grade don't add up over long texts.

The model is fitted to at most SAMPLE labelled rows, half of them of grade 1 or more, those with the smallest hashes of their ids. Scoring covers every row.

A null text is empty and gets the severity of the thresholds alone. Rows without a label, and labels without a text, take no part in the fit. Without two grades to tell apart
nothing is fitted, and every severity is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fields, map_texts, query, table

FEATURES = 1 << 22
PREFIXES = (4, 6)
OFTEN = 100             # one in so many words is often
SAMPLE = 3000           # labelled rows that a model is fitted to
STEPS = 300
PENALTY = 2e-4          # L1, per weight and mean loss
REMEMBERED = 1_000_000
EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_"


def places(word: bytes) -> tuple[int, ...]:
    """The places of a word and its beginnings; the place after each stands for its being frequent."""
    w = word.decode("utf-8", "replace").lower().strip(EDGES)
    names = [w, *(f"^{w[:k]}" for k in PREFIXES if len(w) >= k)] if w else []
    return tuple(zlib.crc32(x.encode()) * 2 & (FEATURES - 1) for x in names)


def occurring(text: bytes, look: Callable[[bytes], tuple[int, ...]]) -> list[int]:
    """Places of a whole text, given those of a word."""
    words = text.split()
    count: dict[int, int] = {}
    for w, n in Counter(words).items():
        for p in look(w):
            count[p] = count.get(p, 0) + n
    return sorted([*count, *(p + 1 for p, n in count.items() if n * OFTEN >= len(words))])


def features(text: bytes) -> list[int]:
    return occurring(text, places)


@dataclass
class Model:
    """Weights of the places that have one, and thresholds in ascending order."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def severity(self, score: float) -> float:
        """Expected grade."""
        return float((1 / (1 + np.exp(self.thresholds - score))).sum()) if len(self.thresholds) else 0.0


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, penalty: float = PENALTY, share: np.ndarray | None = None) -> Model:
    """Maximum likelihood by accelerated proximal gradient steps. `share` weighs the rows (sampled rows stand for more or fewer)."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or len(set(grades.tolist())) < 2:
        return Model({}, np.zeros(0))
    used, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    c = np.ones(len(rows)) if share is None else share
    c = c / c.sum()
    above = (grades[:, None] >= np.arange(1, top + 1)).astype(float)
    base = np.clip((c[:, None] * above).sum(0), 1e-6, 1 - 1e-6)
    t = -np.log(base / (1 - base))
    w, mw, vw = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    mt, vt = np.zeros(top), np.zeros(top)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=w[col], minlength=len(rows))
        at = 1 / (1 + np.exp(np.clip(t - score[:, None], -30, 30)))
        p = np.concatenate([1 - at[:, :1], at[:, :-1] - at[:, 1:], at[:, -1:]], 1)
        mine = np.maximum(p[np.arange(len(rows)), grades], 1e-9)
        slope = at * (1 - at)
        lo = np.where(grades > 0, slope[np.arange(len(rows)), np.maximum(grades - 1, 0)], 0)
        hi = np.where(grades < top, slope[np.arange(len(rows)), np.minimum(grades, top - 1)], 0)
        g_score = -c * (lo - hi) / mine
        gt = np.zeros(top)
        np.add.at(gt, np.maximum(grades - 1, 0), c * lo / mine)
        np.add.at(gt, np.minimum(grades, top - 1), -c * hi / mine)
        gw = np.bincount(col, weights=g_score[row], minlength=len(used))
        rate = 0.05
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mt, vt = 0.9 * mt + 0.1 * gt, 0.999 * vt + 0.001 * gt * gt
        size = rate / (np.sqrt(vw / (1 - 0.999 ** step)) + 1e-4)
        w = w - size * mw / (1 - 0.9 ** step)
        w = np.sign(w) * np.maximum(np.abs(w) - size * penalty, 0)
        t = np.maximum.accumulate(t - rate * mt / (1 - 0.9 ** step) / (np.sqrt(vt / (1 - 0.999 ** step)) + 1e-8))
    return Model({int(i): float(x) for i, x in zip(used, w) if x}, t)


def train(docs: DataFrame, labels: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit to a bounded sample of labelled rows: half with a grade above 0, half with 0, weighed back to their shares."""
    graded = labels.select(F.col(doc_id).alias("labelled"), grade.cast("int").alias("grade")).filter("labelled IS NOT NULL AND grade IS NOT NULL")
    counts = {bool(r.up): r.n for r in graded.groupBy((F.col("grade") > 0).alias("up")).agg(F.count("*").alias("n")).collect()}
    parts = [graded.filter(F.col("grade") > 0 if up else F.col("grade") <= 0).orderBy(F.xxhash64("labelled"), "labelled").limit(sample // 2) for up in (True, False)]
    # bounded by `sample` rows of two numbers
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(parts[0].unionByName(parts[1])), F.col("id") == F.col("labelled"))
    rows = map_texts(texts, "text", lambda ts: [(features(t),) for t in ts], fields(places="array<int>"), ["grade"]).select("doc.grade", "out.places").toArrow()
    grades = rows["grade"].to_numpy().astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    found = [np.asarray(x, np.int64) for x in rows["places"].to_pylist()]
    up = grades > 0
    share = np.where(up, counts.get(True, 0) / max(1, up.sum()), counts.get(False, 0) / max(1, (~up).sum()))
    return fit(found, np.maximum(grades, 0), share=share)


_WORDS: dict[int, dict[bytes, tuple[int, ...]]] = {}


class _Weighty(dict):
    """Raw word -> those of its places that have a weight."""

    def __init__(self, model: Model):
        super().__init__()
        self.known = {p & ~1 for p in model.weights}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = tuple(p for p in places(word) if p in self.known)
        return out


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`doc`, score, severity (expected grade) and grade (the most probable one)."""
    weights, cuts = model.weights, model.thresholds

    def run(texts: list[bytes]) -> list[tuple]:
        key = hash((tuple(sorted(weights.items())), tuple(cuts)))
        if key not in _WORDS:
            _WORDS.clear()
            _WORDS[key] = _Weighty(model)
        look = _WORDS[key].__getitem__
        out = []
        for t in texts:
            s = sum(weights.get(p, 0.0) for p in occurring(t, look))
            above = 1 / (1 + np.exp(np.clip(cuts - s, -500, 500)))
            p = np.concatenate([[1.0], above, [0.0]])
            out.append((float(s), float(above.sum()), int(np.argmax(p[:-1] - p[1:]))))
        return out
    return map_texts(docs, text, run, fields(score="double", severity="double", grade="int"), keep).select("doc", "out.*")


@query("op1_toxicity_severity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    rows = score_documents(docs, train(docs, labels, grade), keep=["doc_id"])
    return rows.select("doc.doc_id", F.round("severity", 6).alias("severity"), "grade", (F.col("severity") >= 0.5).alias("toxic"))
