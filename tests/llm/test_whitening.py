import numpy as np
import pytest
from pyspark.sql import functions as F

from litrank.llm import whitening as wh


def wholes(vectors):
    return np.floor(256 * np.asarray(vectors, np.float64))


def check(rows, vectors, ids, components=4):
    """Rows against the dense eigendecomposition of the covariance of the distinct x-vectors."""
    x = wholes(vectors)
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    want = (x - mean) @ u / np.sqrt(e)
    got = np.zeros_like(want)
    for r in rows:
        got[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert r.n == n and abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-9
        assert r.identity_error < 1e-10
    sums = [int(s) for s in fit.sum(axis=0)]
    for r in rows:
        exact = sum((n * int(a) - s) ** 2 for a, s in zip(x[ids.index(r.vec_id)], sums))
        assert r.deviation == exact and r.deviation_digits == str(exact)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((400, 24)) * np.linspace(2, 0.5, 24)).astype(np.float32)
    vectors[50:200] = vectors[0]                               # one vector on a third of all rows
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [1.0] * 23 + [None]), (902, [float("nan")] * 24), (903, [float("inf")] + [0.0] * 23)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>") \
        .withColumns({"x": F.lit("x"), "n": F.lit(0), "label": F.lit(None).cast("int")})
    got = wh.whiten(df, wh.fit(df)).collect()
    assert len(got) == 4 * len(rows)
    check(got, vectors, [r[0] for r in rows])


def test_negative_zero_short_vectors_and_few_dimensions(spark):
    given = [(0, [0.5, -0.0]), (1, [0.5]), (2, []), (3, [-1.25, 2.0]), (4, [3.0, 1.0]), (None, [0.5, 0.0])]
    df = spark.createDataFrame(given, "vec_id bigint, embedding array<float>")
    got = wh.whiten(df, wh.fit(df)).collect()
    vectors = [(v + [0.0, 0.0])[:2] for _, v in given]
    assert len(got) == 2 * len(given) and got[0].n == 4
    check(got, vectors, [i for i, _ in given], 2)


def test_nothing_to_whiten(spark):
    kind = "vec_id bigint, embedding array<float>"
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    none = spark.createDataFrame([(1, None)], kind)
    for df in (same, none, none.where("false")):
        assert wh.whiten(df, wh.fit(df)).collect() == []


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e9]), (2, [-1e9]), (3, [0.0])], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.deviation, r.deviation_digits) for r in wh.whiten(df, wh.fit(df)).collect()}
    assert got == {1: (None, str((3 * 256 * 10 ** 9) ** 2)), 2: (None, str((3 * 256 * 10 ** 9) ** 2)), 3: (0, "0")}


@pytest.mark.parametrize("size", [1, 2, 3, 9, 150])
@pytest.mark.parametrize("kind", ["spread", "close", "repeated", "low rank"])
def test_eigenpairs(size, kind):
    rng = np.random.default_rng(size)
    values = {"spread": np.geomspace(100, 1, size), "close": 1 + 1e-3 * rng.random(size),
              "repeated": np.repeat([3.0, 2.0, 1.0], size)[::3][:size],
              "low rank": np.where(np.arange(size) < 2, 5.0 - np.arange(size), 0.0)}[kind]
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    a = (q * values) @ q.T
    asked = []
    found, vectors = wh.jacobi_davidson(lambda c: asked.append(c.shape[1]) or a @ c, size, 4, most_basis=30)
    k = min(4, size)
    assert np.abs(found - np.sort(values)[::-1][:k]).max() < 1e-12 * values.max()
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and max(asked) <= 8
