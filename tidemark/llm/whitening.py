"""Embedding whitening: principal components of the distinct vectors by FEAST contour integration.

The covariance of the fit list is gathered by Spark: each task adds up its own rows, and one entry per pair of dimensions and task is shuffled. What reaches
the driver is the square matrix of the dimensions, whatever the number of rows. Its leading eigenpairs are found interval by interval: cuts in gaps of
the spectrum come from inertia counts (signs of the pivots of a symmetric factorisation of the shifted matrix), each interval's invariant subspace from a
quadrature over a circle of complex shifted solves, refined by Rayleigh-Ritz until residuals are at rounding level. An interval is done only when it yields as
many eigenpairs as the inertia counts at its ends promise, so none is missed.

Rows whose vector is null or holds null or non-finite entries are left out. The fit list holds each distinct whole-number vector x once, so repeated rows weigh
nothing; each row still gets its own results, null ids and repeated ids too. Vectors of another length than the commonest one (the longer one of
equals) have no place in the matrix and are left out. Components of no variance (at rounding level) do not exist: one single distinct vector, or an empty table, gives
no rows. Equal eigenvalues get any orthonormal vectors of their space. 64 * c is held within +-9e18. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, query, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = 9e18

NODES = 12          # quadrature points on the upper half of a circle
MOST = 6            # eigenvalues wanted in one interval at most, unless they lie too close together
TURNS = 60
PIVOT = (1 + 17 ** 0.5) / 8


# --- eigenpairs of a symmetric matrix ------------------------------------------------------

def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: by Sylvester's law the number of positive pivots of the shifted matrix, with pivots of one or two rows."""
    a, found = v - shift * np.eye(len(v)), 0
    while len(a):
        column = np.abs(a[1:, 0])
        size, rows = (0.0, [0]) if not len(column) else (column.max(), [0])
        if size and abs(a[0, 0]) < PIVOT * size:
            r = 1 + int(column.argmax())
            other = np.abs(np.delete(a[:, r], r)).max()
            if abs(a[0, 0]) * other < PIVOT * size * size:
                rows = [r] if abs(a[r, r]) >= PIVOT * other else [0, r]
        rest = np.delete(np.arange(len(a)), rows)
        if len(rows) == 2:
            found += 1                                  # such a block has one eigenvalue of either sign
        elif a[rows[0], rows[0]] == 0:                  # a row of zeros
            a = a[np.ix_(rest, rest)]
            continue
        else:
            found += bool(a[rows[0], rows[0]] > 0)
        side = a[np.ix_(rest, rows)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(rows, rows)], side.T)
        a = (a + a.T) / 2
    return found


def project(v: np.ndarray, lo: float, hi: float, y: np.ndarray) -> np.ndarray:
    """The quadrature of (zI - v)^-1 y over the circle through lo and hi: y with its parts outside of the interval damped."""
    t, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * (np.pi / 2) * (1 - t))
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    out = np.zeros_like(y)
    for w, e in zip(weights, turn):
        out += (w / 2) * (radius * e * np.linalg.solve((centre + radius * e) * np.eye(len(v)) - v, y.astype(complex))).real
    return out


def ritz(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best eigenpairs of v within the span of q, the largest first."""
    basis = np.linalg.qr(q)[0]
    e, u = np.linalg.eigh(basis.T @ v @ basis)
    return e[::-1], (basis @ u)[:, ::-1]


def eigenpairs_within(v: np.ndarray, lo: float, hi: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` eigenpairs between lo and hi; raises if they cannot all be found."""
    size, exact = np.abs(v).sum(1).max(), 64 * np.finfo(float).eps
    y = np.random.default_rng(42).standard_normal((len(v), min(len(v), wanted + max(wanted, 8))))
    for _ in range(TURNS):
        e, y = ritz(v, project(v, lo, hi, y))
        good = (e > lo) & (e <= hi) & (np.linalg.norm(v @ y - y * e, axis=0) <= exact * size)
        if good.sum() == wanted:
            return e[good], y[:, good]
    raise ArithmeticError(f"{int(good.sum())} of {wanted} eigenpairs found between {lo} and {hi}")


def gap(v: np.ndarray, lo: float, hi: float, width: float) -> tuple[float, int] | None:
    """A place between lo and hi with no eigenvalue within `width` of it, and the count above it; the middle if possible."""
    for share in (0.5, 0.41, 0.59, 0.33, 0.67, 0.23, 0.77):
        at = lo + share * (hi - lo)
        n = count_above(v, at)
        if count_above(v, at - width) == n == count_above(v, at + width):
            return at, n
    return None


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above rounding level, falling, and their unit vectors as columns."""
    size = np.abs(v).sum(1).max() if len(v) else 0.0
    if not size > 0 or not np.isfinite(size):
        return np.zeros(0), np.zeros((len(v), 0))
    v = v / size                                        # the spectrum lies within [0, 1]
    width = 1e-11
    floor = 8 * len(v) * np.finfo(float).eps
    k = min(k, count_above(v, floor))
    todo, found, above = [(floor, 1.0 + 1e-6, count_above(v, floor), 0)], [], 0
    while todo and above < k:
        lo, hi, n_lo, n_hi = todo.pop()                 # the highest interval is the last one
        if n_lo == n_hi:
            continue
        middle = gap(v, lo, hi, width) if n_lo - n_hi > MOST and hi - lo > 64 * width else None
        if middle:
            todo += [(lo, middle[0], n_lo, middle[1]), (middle[0], hi, middle[1], n_hi)]
            continue
        found.append(eigenpairs_within(v, lo, hi, n_lo - n_hi)[1])
        above = n_lo
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    e, u = ritz(v, np.hstack(found))                    # once more together, so that vectors of neighbouring intervals are orthogonal
    return e[:k] * size, u[:, :k]


# --- sums over rows ------------------------------------------------------------------------

def whole_numbers(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 of every entry; null for a vector with null or non-finite entries."""
    scaled = F.transform(vector.cast("array<double>"), lambda c: c * SCALE)
    bad = F.exists(vector.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(scaled, lambda c: F.floor(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(SHIFT).cast("bigint"))
    return F.when(vector.isNotNull() & ~bad, x)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def length_sums(fit: DataFrame) -> list:
    """(length, dim, n, total): count and exact sum per length of vector and dimension; one row per task and dimension is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = np.diff(b.column(0).offsets.to_numpy())
            for d in np.unique(lengths):
                x = matrix(b.column(0).filter(pa.array(lengths == d)))
                wide = d > 0 and max(abs(int(x.max())), abs(int(x.min()))) >= 2 ** 62 // len(x)
                part = (x.astype(object) if wide else x).sum(0).astype(object)
                n[int(d)] = n.get(int(d), 0) + len(x)
                total[int(d)] = total.get(int(d), 0) + part
        out = [(d, i, n[d], str(t)) for d in n for i, t in enumerate(total[d])]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["length", "dim", "n", "total"])
    parts = fit.select("x").mapInArrow(run, "length int, dim int, n bigint, total string")
    return parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def moments(fit: DataFrame, length: int, rows: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over the fit list of the outer products of (1, r) with itself, where r is what `rows` makes of x, `size` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            if b.num_rows:
                r = rows(matrix(b.column(0)))
                r = np.hstack([np.ones((len(r), 1)), r])
                total += r.T @ r
        i, j = np.triu_indices(size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])
    out = np.zeros((size + 1, size + 1))
    for r in fit.filter(F.size("x") == length).select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.total
    return out


def covariance(m: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor n from `moments` of rows that were centred already (their means are at rounding level)."""
    return m[1:, 1:] / n - np.outer(m[0, 1:] / n, m[0, 1:] / n)


class Whitening:
    """What `fit` learns: n, the sums S, the components (columns), their eigenvalues, shares of the trace, and the identity error."""

    def __init__(self, sums: list[int], n: int):
        self.sums, self.n, self.length = sums, n, len(sums)
        self.middle = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])
        self.components, self.values, self.explained, self.identity_error = np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        sums = np.array(self.sums, object)
        far = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(abs(s) for s in self.sums) if x.size else 0
        if far * far * self.length < 2 ** 62:
            return ((x * self.n - sums.astype(np.int64)) ** 2).sum(1).tolist()
        near = np.abs(self.centred(x)).max() * self.n * (1 + 1e-9) + 1
        if near * near * self.length < 2 ** 62:         # products wrap around, their small differences don't
            with np.errstate(over="ignore"):
                d = (x.astype(np.uint64) * np.uint64(self.n) - np.array([s % 2 ** 64 for s in self.sums], np.uint64)).astype(np.int64)
            return (d ** 2).sum(1).tolist()
        return [s if s < 2 ** 63 else None for s in ((x.astype(object) * self.n - sums) ** 2).sum(1).tolist()]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors in column `x`; None if there are none."""
    distinct = cut(vectors.filter("x IS NOT NULL AND size(x) > 0").select("x").distinct())
    sums = length_sums(distinct)
    if not sums:
        return None
    n, length = max((r.n, r.length) for r in sums)
    out = Whitening([int(r.total) for r in sorted((r for r in sums if r.length == length), key=lambda r: r.dim)], n)
    v = covariance(moments(distinct, length, out.centred, length), n)
    out.values, out.components = leading_eigenpairs(v, components)
    out.explained = out.values / np.trace(v) if len(out.values) else out.values
    k = len(out.values)
    if k:
        out.identity_error = float(np.abs(covariance(moments(distinct, length, out.whitened, k), n) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, model: Whitening | None, row_id: str) -> DataFrame:
    """One row per vector in column `x` of the model's length and component: `row_id`, component, n, deviation, whitened, explained, identity_error."""
    schema = f"`{row_id}` {vectors.schema[row_id].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    k = 0 if model is None else len(model.values)
    keep = vectors.filter(F.col("x").isNotNull() & (F.size("x") == model.length) if k else F.lit(False)).select(row_id, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            again = pa.array(np.repeat(np.arange(len(x)), k))
            each = lambda a: pa.array(np.tile(a, len(x)))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(again), each(np.arange(1, k + 1, dtype=np.int32)), each(np.full(k, model.n, np.int64)), pa.array(model.deviation(x), pa.int64()).take(again),
                pa.array(model.whitened(x).ravel()), each(model.explained), each(np.full(k, model.identity_error))], names=[row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return keep.mapInArrow(run, schema)


@query("op11_feast_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    return whiten(vectors, fit(vectors), "vec_id")
