"""QDWH divide and conquer against numpy, and the whitening query's columns against exact arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quartzline.llm import queries, whitening

SPECTRA = {
    "even": np.linspace(1, 100, 40),
    "wide": 10.0 ** np.linspace(-10, 3, 40),
    "equal": np.ones(40),
    "two clusters": np.r_[np.ones(15), np.zeros(25)],
    "one out": np.r_[5, np.ones(39)],
    "close pair": np.r_[1 + 1e-9, 1, np.linspace(0.1, 0.5, 38)],
    "negative": np.linspace(-3, 3, 40),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors(name):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = (q * SPECTRA[name]) @ q.T
    values, vectors = whitening.eigenvectors(a)
    scale = np.abs(SPECTRA[name]).max()
    assert np.abs(values - np.sort(SPECTRA[name])[::-1]).max() < 1e-13 * scale * 40
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-10
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale


@pytest.mark.parametrize("a", [np.zeros((0, 0)), np.zeros((3, 3)), np.array([[2.0]]), np.diag([1.0, 3.0, 2.0])])
def test_small_matrices(a):
    values, vectors = whitening.eigenvectors(a)
    assert np.allclose(vectors * values @ vectors.T, a)
    assert (np.diff(values) <= 0).all()


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    values = np.r_[1e-7, -1e-3, rng.standard_normal(18)]
    assert np.abs(whitening.polar_factor((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-8


def brute(rows, components=16):
    """vec_id and the columns for each whole vector, by exact sums and numpy's eigenvectors."""
    whole = [(i, tuple(math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in whole})
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for i, x in whole:
        d = [n * a - b for a, b in zip(x, s, strict=True)]
        w = (np.array(d) / n) @ u / np.sqrt(e)
        out += [(i, k + 1, n, sum(a * a for a in d), w[k], e[k] / np.trace(v)) for k in range(len(e))]
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:2] + r[2:4] for r in got] == [r[:2] + r[2:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7  # either sign
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(5).tolist() for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(70, vectors[0])] * 40 + [(None, vectors[1])]
    rows += [(80, None), (81, []), (82, [1.0, None, 2.0, 3.0, 4.0]), (83, [float("nan")] * 5), (84, [0.0, 0.0, float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a", 0.5) for i, v in rows], "vec_id long, embedding array<float>, x string, whitened double").repartition(7)
    compare(whitening.whiten(df).collect(), brute(rows))
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id = 70")).collect() == []  # no variance


def test_direction_without_variance(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v := rng.integers(-9, 9)), float(w := rng.integers(-9, 9)), float(v + w)]) for i in range(50)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1, 2}
    assert all(r.identity_error < 1e-9 for r in got)


def test_large_entries_stay_exact(spark):
    vectors = [[1e12 * (i % 7), float(i), -3e14 * (i % 2)] for i in range(20)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    xs = [[math.floor(c * 64) + 1_000_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*xs, strict=True)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()}
    assert got == {i: sum((20 * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("vectors", [[[1.0, 2.0], [1.0]], [[1e300], [1.0]]])
def test_what_fails(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="several lengths|beyond 2"):
        whitening.whiten(df).collect()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(queries.op12_qdwh_whitening(spark, "/root/testdata/sf0.001").collect(), brute(rows))
