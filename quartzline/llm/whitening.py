"""Embedding whitening by spectral divide and conquer on polar decompositions (QDWH)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import materialize

_EPS = np.finfo(np.float64).eps
_SCALE, _SHIFT = 64, 1_000_000
_FAN_IN = 32


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley iterations on QR.

    Weights follow a lower bound of the least singular value, so that six or so iterations do for
    any matrix that is not singular to working precision.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    r = np.linalg.qr(x, mode="r")
    r[np.diag_indices(n)] += np.where(np.abs(np.diag(r)) < _EPS, _EPS, 0)
    low = min(max(0.9 / np.linalg.norm(np.linalg.solve(r, np.eye(n))), _EPS), 1.0)
    for _ in range(30):
        g = np.cbrt(4 * max(1 - low**2, 0.0) / low**4)
        h = np.sqrt(1 + g) + 0.5 * np.sqrt(max(8 - 4 * g + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + g)), 0.0))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
        after = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(low * (h + b * low**2) / (1 + c * low**2), 1.0)
        change, x = np.linalg.norm(after - x), after
        if change < np.cbrt(5 * _EPS) and abs(1 - low) < 10 * _EPS:
            break
    return 1.5 * x - 0.5 * x @ x @ x


def _halves(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """An orthogonal basis whose first columns span the eigenvectors above `shift`; how many; what couples both parts."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(np.clip(round(np.trace(projector)), 0, n))
    if k in (0, n):
        return np.eye(n), k, 0.0
    mixed = rng.standard_normal((n, n))
    basis = np.linalg.qr(np.hstack([projector @ mixed[:, :k], mixed[:, k:] - projector @ mixed[:, k:]]))[0]
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))


def _divide(a: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns in which a symmetric matrix is diagonal."""
    n = len(a)
    if n == 1:
        return np.eye(1)
    a = (a + a.T) / 2
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    shift, best = float(np.median(np.diag(a))), None
    while high - low > 4 * n * _EPS * scale:
        basis, k, coupling = _halves(a, shift, rng)
        if 0 < k < n:
            if best is None or coupling < best[2]:
                best = basis, k, coupling
            if coupling <= 50 * n * _EPS * scale:
                break
            low, shift = shift, shift + (high - shift) * 0.03  # the shift hit an eigenvalue
            continue
        low, high = (shift, high) if k == n else (low, shift)
        shift = (low + high) / 2
    if best is None:  # all eigenvalues are one to working precision
        return np.eye(n)
    basis, k, _ = best
    one, two = basis[:, :k], basis[:, k:]
    return np.hstack([one @ _divide(one.T @ a @ one, scale, rng), two @ _divide(two.T @ a @ two, scale, rng)])


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and their unit eigenvectors, as columns.

    Polar decompositions of the shifted matrix give projectors on the invariant subspaces above and
    below the shift; both are split again until they have one dimension. One first-order correction
    then takes out what rounding left outside the diagonal.
    """
    a = (a + a.T) / 2
    scale = float(np.linalg.norm(a))
    if not len(a) or scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    vectors = _divide(a, scale, np.random.default_rng(0))
    left = vectors.T @ a @ vectors
    values = np.diag(left).copy()
    gap = values[None, :] - values[:, None]
    apart = np.abs(left) < 1e-6 * np.abs(gap)
    vectors = vectors @ (np.eye(len(a)) + np.where(apart, left / np.where(apart, gap, 1), 0) * (1 - np.eye(len(a))))
    vectors = vectors @ (1.5 * np.eye(len(a)) - 0.5 * vectors.T @ vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """What every task is given: n, the exact sums S, and a weight for each dimension and component.

    Its size is bounded by the dimensions: S, and dimensions x components doubles.
    """

    n: int
    sums: tuple[int, ...]
    weights: np.ndarray
    explained: tuple[float, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; whole numbers first, which is exact."""
        near = np.array([round(s / self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, near, strict=True)])
        return (x - near) - rest


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers floor(64 c) + 1000000, of the rows whose vector is whole and finite.

    Dropped are null vectors, those with null, NaN or infinite entries, and those without entries.
    An entry beyond 2**55 fails the query, as x would not be exact.
    """
    c = F.col("embedding").cast("array<double>")
    whole = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    x = F.transform("c", lambda v: F.when(F.abs(v) < float(2**55), F.floor(v * _SCALE).cast("bigint") + _SHIFT).otherwise(F.raise_error(F.lit("an entry beyond 2**55")).cast("bigint")))
    return whole.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(column) == 0 or len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of several lengths")
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """n and S, in exact arithmetic: a task adds up its own rows, decimals add up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                exact = x if float(np.abs(x).max()) * len(x) < 2.0**62 else x.astype(object)
                part = [int(s) for s in exact.sum(0)]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows = sorted(rows, key=lambda r: r.i)
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors of several lengths")
    return (int(rows[0].n) if rows else 0), tuple(int(r.s) for r in rows)


def _products(fit: DataFrame, given: Whitening, weights: np.ndarray | None = None) -> np.ndarray:
    """The sum over the fit list of the products of centred vectors, whitened first if there are weights.

    Each task adds up its rows to one matrix; groups of _FAN_IN matrices are added up by tasks, again
    and again, so that the driver sees one.
    """
    size = len(given.sums) if weights is None else weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                y = given.centred(_matrix(batch.column(0).slice(at, 8192)))
                y = y if weights is None else y @ weights
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((size, size)), None
        for batch in batches:
            for p, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += np.frombuffer(m.as_buffer(), np.float64).reshape(size, size)
                part = p if part is None else min(p, part)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part // _FAN_IN], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    schema = "part int, m binary"
    found = fit.select("x").mapInArrow(run, schema)
    parts = fit.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // _FAN_IN)
        # one task for each group of matrices, added up in a fixed order
        found = found.repartitionByRange(parts, "part").sortWithinPartitions("part").mapInArrow(add, schema)
    return sum((np.frombuffer(r.m, np.float64).reshape(size, size) for r in found.orderBy("part").collect()), np.zeros((size, size)))


def fit_whitening(fit: DataFrame, components: int) -> Whitening | None:
    """Fits on distinct vectors (column x): the leading components, as many as the vectors have.

    A direction without variance, to working precision, is no component. None for no vectors.
    """
    n, sums = _sums(fit)
    if n == 0:
        return None
    given = Whitening(n, sums, np.zeros((len(sums), 0)), ())
    covariance = _products(fit, given) / n
    values, vectors = eigenvectors(covariance)
    keep = np.flatnonzero(values > len(values) * _EPS * max(values[0], 0))[:components] if values[0] > 0 else np.zeros(0, int)
    return Whitening(n, sums, vectors[:, keep] / np.sqrt(values[keep]), tuple((values[keep] / np.trace(covariance)).tolist()))


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """Whitens every whole vector by the covariance of the distinct ones; a row for each vector and component.

    Returns vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation
    (decimal(38,0): the exact sum over dimensions of (n x - S) squared), whitened, explained (the
    component's share of the variance) and identity_error (the largest entry of the whitened
    vectors' covariance less the identity, from a pass over them).

    Rows without a whole, finite vector are dropped, as are all if no direction has variance (no
    vectors, or all equal). Repeated rows and null vec_ids stay; other columns are left out.
    Vectors of several lengths fail the query.

    Distinct vectors are found by one shuffle, in which each task sends a vector once; sums and products are
    added up in tasks and then in a tree, and only matrices of dimensions x dimensions meet on the driver.
    """
    found = vectors(embeddings)
    fit = materialize(found.select("x").distinct())
    model = fit_whitening(fit, components)
    schema = "vec_id bigint, deviation decimal(38,0), w array<double>"
    if model is None or not model.explained:
        rows, error, explained = found.where("false").select("vec_id", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("w")), 0.0, [0.0]
        n = 0
    else:
        n, explained = model.n, list(model.explained)
        error = float(np.abs(_products(fit, model, model.weights) / n - np.eye(len(explained))).max())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.array(model.sums, object)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _matrix(part.column(1))
                    small = float(np.abs(x).max()) * n < 2.0**62 and max(map(abs, model.sums)) < 2**62
                    d = x * n - sums.astype(np.int64) if small else x.astype(object) * n - sums
                    if not small or float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
                        d = d.astype(object)
                    squares = [int(s) for s in (d * d).sum(1)]
                    w = (model.centred(x) @ model.weights).ravel()
                    offsets = np.arange(len(x) + 1, dtype=np.int32) * len(explained)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(squares, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w))], ["vec_id", "deviation", "w"])

        rows = found.mapInArrow(run, schema)
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("i") + 1)
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
