"""Whitening of embeddings with principal components from a randomised range finder (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.staging import stage

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 52)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(64 * c) + 1000000 of every entry, as longs, for vectors without null or non-finite entries.

    Empty vectors and those with an entry whose 64-fold reaches 2^52 are left out as well.
    """
    scaled = F.transform(F.col(vector_col), lambda c: c.cast("double") * SCALE)
    fits: Column = F.forall(scaled, lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < LARGEST))
    x = F.transform(scaled, lambda s: F.floor(s) + SHIFT)
    return table.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fits).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The equally long lists of a column as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


@dataclass
class Centre:
    """The exact mean of the fit list as quotient and remainder of its sums by n."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is subtracted as longs, so no digits are lost to the shift."""
        return (x - self.quotient).astype(np.float64) - self.remainder / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; None where it is no long."""
        off = x - self.quotient
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * off - self.remainder) ** 2).sum(1).tolist()
        sums = [sum((self.n * o - r) ** 2 for o, r in zip(row, self.remainder.tolist(), strict=True)) for row in off.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def centre_of(fit: DataFrame, dim: int) -> Centre | None:
    """n and the sums per dimension, as decimals so that no table is too large for them."""
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not sums:
        return None
    n = sums[0]["n"]
    split = {r["i"]: divmod(int(r["s"]), n) for r in sums}
    return Centre(n, np.array([split[i][0] for i in range(dim)], np.int64), np.array([split[i][1] for i in range(dim)], np.int64))


def summed(fit: DataFrame, shape: tuple[int, int], block) -> np.ndarray:  # noqa: ANN001
    """The sum over all batches of the matrix that ``block`` makes of a batch's rows; a task sends one matrix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += block(matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    cells = fit.select("x").mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape)
    for r in cells:
        out.flat[r["at"]] = r["v"]
    return out


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray  # a column for each
    trace: float
    size: int  # dimensions of the subspace in which they were found


def find_components(fit: DataFrame, centre: Centre, dim: int, wanted: int = 16, oversampling: int = 8, passes: int = 4, tolerance: float = 1e-10, seed: int = 11) -> Components:
    """Leading eigenpairs of the covariance of ``fit`` (divisor n) by Rayleigh-Ritz in a randomised range.

    A random block of ``wanted + oversampling`` directions is multiplied by the covariance again and
    again, each time in one pass over all centred rows, and made orthonormal. The Ritz pairs of the
    block are taken when each residual is at most ``tolerance`` times the gap to the next value,
    which bounds the error of its direction. Where that isn't so after ``passes`` passes, the block is
    filled up to all dimensions, where Ritz pairs are eigenpairs. A gap under the tolerance
    itself can't be told from a tie; any basis of such a space will do.
    """

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        def block(x: np.ndarray) -> np.ndarray:
            c = centre.rows(x)
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), (c * c).sum())])

        both = summed(fit, (dim + 1, q.shape[1]), block) / centre.n
        return both[:-1], float(both[-1, 0])

    def ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        small = q.T @ w
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        return values, q @ y, np.linalg.norm(w @ y - (q @ y) * values, axis=0)

    def good(values: np.ndarray, residuals: np.ndarray) -> bool:
        k = min(wanted, dim)
        gaps = np.abs(np.diff(values[: k + 1], append=0.0 if len(values) <= k else values[k]))
        before = np.concatenate([[np.inf], gaps])[: len(gaps)]
        return bool((residuals[:k] <= tolerance * np.minimum(gaps, before)[:k]).all())

    rng = np.random.default_rng(seed)
    size = min(dim, wanted + oversampling)
    q = np.linalg.qr(rng.standard_normal((dim, size)))[0]
    w, trace = times(q)
    values, vectors, residuals = ritz(q, w)
    for _ in range(passes):
        if size == dim or trace == 0 or good(values, residuals):
            break
        q = np.linalg.qr(w)[0]
        w, trace = times(q)
        values, vectors, residuals = ritz(q, w)
    if size < dim and trace > 0 and not good(values, residuals):
        size = dim
        q = np.linalg.qr(np.hstack([vectors, rng.standard_normal((dim, dim - vectors.shape[1]))]))[0]
        w, trace = times(q)
        values, vectors, residuals = ritz(q, w)
    # what rounding leaves of a zero eigenvalue is no component
    real = values[:wanted] > dim * np.finfo(float).eps * trace
    vectors = vectors[:, :wanted][:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if vectors.size else vectors
    return Components(values[:wanted][real], vectors, trace, size)


def whiten(table: DataFrame, wanted: int = 16, oversampling: int = 8, passes: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: its whitened value, and how far the vector lies from the mean.

    The model is fitted on each distinct integer vector once, whatever the number of its copies. What
    passes through the driver are matrices of the vectors' dimension, never rows. ``identity_error``
    is measured, not assumed: one more pass forms the covariance of the whitened fit list.

    Rows whose vector is null, empty, or holds a null, a non-finite entry or one beyond 2^46 take no
    part. The dimension is that of most rows (the larger one on a tie); rows of another take no part
    either. Repeated rows and null ids stay, each with its own result. Directions without variance
    are no components, so a table of one distinct vector, or an empty one, gives no rows. A
    ``deviation`` beyond a long is null. Ties between eigenvalues leave any orthonormal basis; a
    component's largest entry is positive.
    """
    rows = stage(integer_rows(table, id_col, vector_col), "whitening-rows")
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    spark = table.sparkSession
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dim = sizes["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    centre = centre_of(fit, dim)
    found = find_components(fit, centre, dim, wanted, oversampling, passes)
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], RESULT)
    to_white = found.vectors / np.sqrt(found.values)

    def square(x: np.ndarray) -> np.ndarray:
        z = centre.rows(x) @ to_white
        return np.vstack([z.T @ z, z.sum(0)[None]])

    moments = summed(fit, (k + 1, k), square) / centre.n
    covariance = moments[:-1] - np.outer(moments[-1], moments[-1])
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = found.values / found.trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = matrix(part.column(1))
                m = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                far = pa.array(centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)), far, pa.array((centre.rows(x) @ to_white).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(task, RESULT)
