"""Whitening of embeddings with eigenvectors from cyclic Jacobi rotations.

Vectors are put on an integer grid, ``x = floor(scale * c) + shift``. The fit list is each distinct x vector once; it
is written to the shared folder and passed over three times: exact counts and sums of each dimension, the scatter of
``x - mean`` as partial matrices of Arrow batches whose entries Spark adds up, and at the end the scatter of the
whitened vectors. Only the d (d + 1) / 2 added entries of one matrix come to the driver; it rotates the covariance until
every off-diagonal entry is negligible against its own two diagonal entries, which is what keeps small eigenvalues
accurate, sorts, and sends d x k numbers back. Nothing else is broadcast.

The mean is kept as a whole number and a fraction below 1, so that centring loses nothing under a large shift.

Rows: a vector that is null, or holds null or non-finite entries, or one whose grid value is 2^52 or more (doubles no
longer tell such whole numbers apart after centring), takes no part. Vectors of one table have one length; should they
differ, the most frequent length counts (the longer of equal ones) and other rows take no part, nor do empty vectors. Null and
repeated ids and repeated vectors are carried, each row of them returned; other columns are not looked at. An empty
table gives no rows. Components whose eigenvalue is numerically zero (at most d x 2^-52 of the largest) can't be brought to
variance 1: ``whitened`` is null there, ``explained`` 0 or next to it, and they are left out of ``identity_error``. A ``deviation`` beyond 2^63 - 1 is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import write_table

LIMIT = 2.0**52
#: Rows that are multiplied at a time.
BLOCK = 4096
#: Sweeps after which rotations end whatever is left; ten or so are enough for any symmetric matrix.
MOST_SWEEPS = 60


def jacobi_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the largest entry of each positive.

    A sweep meets every pair (p, q) once, in the cyclic order of a tournament: the pairs of a round share no index, so
    their rotations are applied together. A pair counts as settled when ``|a_pq| <= eps * sqrt(a_pp * a_qq)``.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    v, eps = np.eye(d), np.finfo(np.float64).eps
    seats = np.arange(d + d % 2)  # an odd number of indices gets an idle seat
    half = len(seats) // 2
    for _ in range(MOST_SWEEPS if d > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.minimum(seats[:half], seats[::-1][:half]), np.maximum(seats[:half], seats[::-1][:half])
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            off = q < d
            p, q = p[off], q[off]
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            big = np.abs(apq) > eps * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq))
            if not big.any():
                continue
            turned = True
            p, q, apq, app, aqq = p[big], q[big], apq[big], app[big], aqq[big]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            # The diagonal by its own small change, and the pair's entry exactly zero.
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
            cols_p, cols_q = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], v[:, order]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: ``n`` distinct vectors, their sums, eigenvalues (falling), vectors, and its own check."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and fractions below 1."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.float64), np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    def matrix(self, components: int) -> np.ndarray:
        """Columns that take centred vectors to whitened ones, for the components with a variance."""
        usable = self.usable(components)
        return self.vectors[:, :usable] / np.sqrt(self.values[:usable])

    def usable(self, components: int) -> int:
        floor = len(self.values) * np.finfo(np.float64).eps * max(self.values[0], 0.0) if len(self.values) else 0.0
        return int((self.values[:components] > floor).sum())


def on_grid(rows: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x`` (array of long) for the rows whose vectors take part, whatever their length."""
    c = F.col(vec_col).cast("array<double>")
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v * scale) < LIMIT, F.lit(False))) & (F.size(c) > 0)
    kept = rows.where(F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * scale) + F.lit(shift).cast("long")).alias("x"))


def _matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _scatter(fit: DataFrame, whole: np.ndarray, fraction: np.ndarray, matrix: np.ndarray | None = None) -> np.ndarray:
    """The sum over ``fit`` of yy' where y is x less the mean, times ``matrix`` if there is one."""
    d, k = len(whole), len(whole) if matrix is None else matrix.shape[1]
    upper = np.triu_indices(k)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in it:
            x = _matrix_of(batch.column(0), d)
            for at in range(0, len(x), BLOCK):
                y = (x[at : at + BLOCK] - whole) - fraction
                y = y if matrix is None else y @ matrix
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], names=["place", "value"])

    added = fit.select("x").mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((k, k))
    for row in added:  # one for each entry of the matrix, whatever the number of vectors
        i, j = upper[0][row.place], upper[1][row.place]
        out[i, j] = out[j, i] = row.value
    return out


def fit_whitening(grid: DataFrame, components: int = 16) -> Whitening | None:
    """Mean, eigenvalues and eigenvectors of the distinct x vectors of ``grid``; None where there are none."""
    lengths = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0].d
    fit = write_table(grid.where(F.size("x") == d).select("x").distinct(), "whitening-fit")
    # Decimals, so that no sum of longs overflows; added up before the shuffle, so d rows a task are moved.
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    n, totals = sums[0].n, tuple(int(r.s) for r in sums)
    start = Whitening(n, totals, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    whole, fraction = start.centre
    covariance = _scatter(fit, whole, fraction) / n
    values, vectors = jacobi_eigen(covariance)
    model = Whitening(n, totals, values, vectors, float(np.trace(covariance)), 0.0)
    white = _scatter(fit, whole, fraction, model.matrix(components)) / n if model.usable(components) else np.zeros((0, 0))
    error = float(np.abs(white - np.eye(len(white))).max(initial=0.0))
    return Whitening(n, totals, values, vectors, model.trace, error)


def whiten(grid: DataFrame, model: Whitening, components: int = 16) -> DataFrame:
    """``vec_id, deviation, whitened`` (an array of at most ``components``) for every row of the fit's length."""
    whole, fraction = model.centre
    matrix, n, d = model.matrix(components), model.n, len(model.sums)
    sums, most = np.array(model.sums, object), 2**63 - 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _matrix_of(batch.column(1), d)
            y = (x - whole) - fraction
            small = (float(np.abs(y).max(initial=0.0)) + 1) * n < 2.0**31 / np.sqrt(d) and max(abs(s) for s in sums) < 2**62 and float(np.abs(x).max(initial=0)) * n < 2.0**62
            if small:  # all of it within 64 bits
                off = x * np.int64(n) - sums.astype(np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
                deviation = [v if v <= most else None for v in exact]
            white = y @ matrix
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), flat], names=["vec_id", "deviation", "whitened"])

    return grid.where(F.size("x") == d).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened_components(grid: DataFrame, components: int = 16) -> DataFrame:
    """A row for each vector and component: ``vec_id, component`` (from 1)``, n, deviation, whitened, explained, identity_error``."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(grid, components)
    if model is None:
        return grid.sparkSession.createDataFrame([], schema)
    shares = [max(0.0, float(v)) / model.trace if model.trace else 0.0 for v in model.values[:components]]
    component = F.explode(F.sequence(F.lit(1), F.lit(len(shares)))).alias("component")
    rows = whiten(grid, model, components).select("vec_id", "deviation", "whitened", component)
    at = F.col("component")
    return rows.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("whitened", at - 1).alias("whitened"),
                       F.element_at(F.array(*map(F.lit, shares)), at).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
