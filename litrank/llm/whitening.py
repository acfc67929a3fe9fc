"""Whitening of embeddings along their leading principal components, found by Jacobi-Davidson.

Entries become whole numbers, ``x = floor(256 * c)``. The fit list has each distinct x-vector
once, in a stored table. Its covariance V is never formed: the driver only asks for products of
V with a few columns, and each is one job over the fit list, in which every task centres its
vectors, multiplies them with the columns and back, and sums; the partial sums are added by a
grouped aggregation, so that the driver gets one row for each dimension.

The iteration (Sleijpen and van der Vorst 1996, with a block of Ritz pairs at a time):

* Rayleigh-Ritz on the trial space gives the leading pairs and their residuals.
* Leading pairs whose residuals are at the rounding level of double precision are locked: they
  leave the trial space, and everything after stays orthogonal to them.
* For the others the correction equation, projected away from the locked and current vectors,
  is solved roughly by MINRES; the columns of the block take their steps together, so that a
  step costs one product. The corrections extend the trial space.
* A trial space of ``most_basis`` vectors restarts from its leading Ritz vectors, for which
  the products are known. If the trial space has become the whole space, Rayleigh-Ritz is exact.

On the driver lie only matrices of dimension by trial space, whatever the number of vectors.

Defined results
    * Rows whose vector is null, or has a null or non-finite entry, are left out.
    * Vectors shorter than the longest count as padded with zeros (an empty one is all zeros).
    * A component whose variance is zero up to rounding cannot be whitened and is left out; a
      table whose vectors are all equal, or an empty one, gives no rows.
    * x is held between the smallest and largest long. ``deviation`` is null where it is beyond
      a long; ``deviation_digits`` always has all its digits.
    * Repeated rows are returned each, with the same values. A null ``vec_id`` stays null. Other
      columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrank.llm.stages import ship_code, stored

EPS = float(np.finfo(np.float64).eps)
GUARD = 4            # Ritz pairs followed beside the wanted ones
INNER_STEPS = 8      # MINRES steps of one correction at most
INNER_TOLERANCE = 0.05
MOST_ROUNDS = 500

WHITENED = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
            "identity_error double, deviation_digits string")
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
                     ("deviation_digits", pa.string())])


@dataclass
class Whitening:
    n: int
    sums: list[int]              # of the fit list's x, for each dimension
    vectors: np.ndarray          # dimension x component, unit columns
    values: np.ndarray           # eigenvalues, falling
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` that have a finite vector, with it as ``x``."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.where(F.col(column).isNotNull() & finite) \
        .withColumn("x", F.transform(c, lambda e: F.floor(e * F.lit(256.0)).cast("bigint")))


def padded(rows: DataFrame, size: int) -> DataFrame:
    short = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size("x")))
    return rows.withColumn("x", F.when(F.size("x") < size, short).otherwise(F.col("x")))


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), size)


def _sums(batches, size: int):
    total, n = [0] * size, 0
    for batch in batches:
        x = _matrix(batch.column(0), size)
        n += len(x)
        if len(x):
            safe = max(abs(int(x.max())), abs(int(x.min()))) < 2 ** 62 // len(x)
            part = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
    if n:
        digits = [str(t) for t in total] + [str(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-size, 1), pa.int32()), pa.array(digits)], ["j", "s"])


def _partial(batches, size: int, mean: np.ndarray, width: int, step):
    total = None
    for batch in batches:
        x = _matrix(batch.column(0), size) - mean
        part = step(x)
        total = part if total is None else total + part
    if total is not None:
        cols = [pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(cols, ["j", *(f"c{i}" for i in range(width))])


class FitList:
    """The distinct x-vectors as a stored table, and sums over it."""

    def __init__(self, vectors: DataFrame):
        size = vectors.agg(F.max(F.size("x"))).first()[0]
        self.size = size or 0
        self.rows = stored(padded(vectors, self.size).select("x").distinct(), "fit-list")
        self.n, self.sums = 0, [0] * self.size
        if self.size:
            d = self.size
            got = self.rows.mapInArrow(lambda b: _sums(b, d), "j int, s string") \
                .groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
            at = {r.j: int(r.s) for r in got}
            self.n = at.get(0, 0)
            self.sums = [at.get(j - d, 0) for j in range(d)]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.size)

    def summed(self, step, height: int, width: int) -> np.ndarray:
        """The sum over all centred blocks of vectors of ``step(block)``, a height x width matrix."""
        size, mean = self.size, self.mean
        schema = ", ".join(["j int", *(f"c{i} double" for i in range(width))])
        parts = self.rows.mapInArrow(lambda b: _partial(b, size, mean, width, step), schema)
        out = np.zeros((height, width))
        for r in parts.groupBy("j").agg(*(F.sum(f"c{i}") for i in range(width))).collect():
            out[r[0]] = r[1:]
        return out

    def product(self, columns: np.ndarray) -> np.ndarray:
        return self.summed(lambda x: x.T @ (x @ columns), self.size, columns.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda x: (x * x).sum(axis=0)[:, None], self.size, 1).sum() / self.n)

    def identity_error(self, vectors: np.ndarray, values: np.ndarray) -> float:
        k = len(values)
        scaled = vectors / np.sqrt(values)

        def moments(x):
            z = x @ scaled
            return np.vstack([z.T @ z, z.sum(axis=0)])

        got = self.summed(moments, k + 1, k) / self.n
        return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def minres(product, shift: np.ndarray, away: np.ndarray, right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Rough solutions t of ``P (V - shift) P t = right`` with P projecting away from the columns
    of ``away``: MINRES (Paige and Saunders 1975) on all columns of ``right`` together."""

    def project(y):
        y = y - away @ (away.T @ y)
        return y - away @ (away.T @ y)

    eps = np.finfo(np.float64).tiny
    norm = lambda y: np.sqrt((y * y).sum(axis=0))
    r1 = r2 = project(right)
    first = beta = norm(r1)
    b = right.shape[1]
    old_beta, dbar, epsln, cs, sn = np.ones(b), np.zeros(b), np.zeros(b), -np.ones(b), np.zeros(b)
    phibar = beta.copy()
    x, w, w2 = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    for it in range(steps):
        on = (beta > eps) & (phibar > tolerance * first)
        if not on.any():
            break
        safe = np.where(beta > eps, beta, 1.0)
        v = r2 / safe
        y = project(product(v) - v * shift)
        if it:
            y = y - r1 * (beta / old_beta)
        alfa = (v * y).sum(axis=0)
        y = y - r2 * (alfa / safe)
        r1, r2 = r2, y
        old_beta, beta = safe, norm(y)
        old_eps = epsln
        delta, gbar = cs * dbar + sn * alfa, sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), EPS * np.maximum(np.abs(shift), eps))
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - w1 * old_eps - w2 * delta) / gamma
        x = np.where(on, x + w * phi, x)
    return project(x)


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Unit columns spanning what ``new`` adds to the span of the bases."""
    out = np.zeros((len(new), 0))
    for t in new.T:
        size = np.linalg.norm(t)
        if not size > 0:
            continue
        t = t / size
        for _ in range(3):                       # against rounding
            for basis in (*bases, out):
                t = t - basis @ (basis.T @ t)
        left = np.linalg.norm(t)
        if left > 1e-10:
            out = np.column_stack([out, t / left])
    return out


def jacobi_davidson(product, size: int, wanted: int, most_basis: int | None = None):
    """The ``wanted`` leading eigenpairs of a symmetric non-negative operator of which only
    products with blocks of columns are known: eigenvalues, falling, and unit vectors."""
    wanted = min(wanted, size)
    block = min(size, wanted + GUARD)
    most_basis = min(size, max(most_basis or 64, 3 * block))
    rng = np.random.default_rng(20_000)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = orthonormal(rng.standard_normal((size, block)))
    image = product(basis)
    for _ in range(MOST_ROUNDS):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s      # Ritz vectors, their images
        residual = image - basis * theta
        error = np.sqrt((residual ** 2).sum(axis=0))
        whole = locked.shape[1] + basis.shape[1] >= size
        scale = max(abs(theta[0]), values.max(initial=0.0))
        good = (error <= 16 * EPS * np.sqrt(size) * scale) | whole
        lead = len(good) if good.all() else int(np.argmin(good))
        if lead:
            values = np.concatenate([values, theta[:lead]])
            locked = np.column_stack([locked, basis[:, :lead]])
            basis, image, theta = basis[:, lead:], image[:, lead:], theta[lead:]
            residual, error = residual[:, lead:], error[lead:]
        top = np.sort(values)[::-1][:wanted]
        # A pair found late may belong before the locked ones: go on until the rest is below.
        if len(top) == wanted and (not len(theta) or theta[0] + error[0] <= top[-1]):
            order = np.argsort(-values, kind="stable")[:wanted]
            return values[order], locked[:, order]
        if basis.shape[1] + block > most_basis:
            keep = max(min(2 * block, basis.shape[1]), 1)
            basis, image, theta = basis[:, :keep], image[:, :keep], theta[:keep]
        now = min(block, basis.shape[1], size - locked.shape[1])
        if now:
            away = np.column_stack([locked, basis[:, :now]])
            fix = minres(product, theta[:now], away, -residual[:, :now], INNER_STEPS, INNER_TOLERANCE)
        else:
            fix = np.zeros((size, 0))
        new = orthonormal(fix, locked, basis)
        if not new.shape[1]:                     # nothing new: widen the trial space by chance
            new = orthonormal(rng.standard_normal((size, block)), locked, basis)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise RuntimeError("Jacobi-Davidson did not settle")


def fit(rows: DataFrame, column: str = "embedding", components: int = 4) -> Whitening:
    """The whitening of the distinct x-vectors of ``rows``."""
    ship_code(rows.sparkSession)
    vectors = FitList(whole_vectors(rows, column).select("x"))
    none = Whitening(vectors.n, vectors.sums, np.zeros((vectors.size, 0)), np.zeros(0), 0.0, 0.0)
    if not vectors.n or not vectors.size:
        return none
    trace = vectors.trace()
    if not trace > 0:
        return none
    values, found = jacobi_davidson(vectors.product, vectors.size, components)
    real = values > 16 * EPS * vectors.size * values[0]
    values, found = values[real], found[:, real]
    return Whitening(vectors.n, vectors.sums, found, values, trace, vectors.identity_error(found, values))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n * x - sums) ** 2 of each vector."""
    if not len(x):
        return []
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    kind = np.int64 if most * most * len(sums) < 2 ** 63 else object
    d = x.astype(kind) * n - np.array(sums, kind)
    return (d * d).sum(axis=1).tolist()


def _transform(batches, model: Whitening):
    size, k = len(model.sums), len(model.values)
    scaled, mean = model.vectors / np.sqrt(model.values), model.mean
    explained = model.values / model.trace
    for batch in batches:
        x = _matrix(batch.column(1), size)
        z = (x - mean) @ scaled
        deviation = _deviations(x, model.n, model.sums)
        at = np.repeat(np.arange(len(x)), k)
        fits = pa.array([v if v < 2 ** 63 else None for v in deviation], pa.int64())
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
            pa.array(np.full(len(at), model.n)), fits.take(take), pa.array(z.ravel()),
            pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), model.identity_error)),
            pa.array(map(str, deviation), pa.string()).take(take)], schema=_SCHEMA)


def whiten(rows: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """One row for each vector and component of the model."""
    spark = rows.sparkSession
    ship_code(spark)
    if not len(model.values):
        return spark.createDataFrame([], WHITENED)
    size = len(model.sums)
    x = whole_vectors(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column)), column)
    fits = padded(x.where(F.size("x") <= size), size).select("vec_id", "x")
    return fits.mapInArrow(lambda b: _transform(b, model), WHITENED)
