"""Whitening of embeddings by cyclic Jacobi rotations of their covariance.

Entries become integers, floor(256 c), so sums and squares are exact. The fit list holds each distinct integer vector once, so
that copies don't weigh more: it is a table of packed vectors, made by one shuffle of what is distinct. Tasks go through it
twice: for its size and sums, and, once the means are known, for the centred scatter; each task hands on one partial matrix, and
the partial matrices are summed entry by entry. The driver gets dimensions squared numbers (a checked size), turns pairs of
axes until no off-diagonal entry is left that is more than rounding, which keeps small eigenvalues accurate, sorts, and sends
the whitening matrix to all tasks. A third pass measures how white the fit list has become.

A row whose vector is null, empty, or holds a null or non-finite entry is left out; so is one with an entry of 2**54 or more,
whose integer would not be exact. Vectors of different dimensions are an error. Rows of one id, or of none, are rows of their
own; other columns are ignored, whatever their names. An empty table gives no rows. Components without variance (one vector, or
fewer vectors than components) have a null whitened value, and explain nothing; identity_error is over the others, null if
there is none. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read
from .kernels import lean

SCALE, MOST = 256, 2.0**62
#: Dimensions that a driver turns, and sweeps after which rotations stop at the latest (they end by themselves after six to ten).
MOST_DIMENSIONS, SWEEPS = 4096, 60
#: Eigenvalues below this share of the largest are rounding, not variance.
LEAST_SHARE = 1e-14
#: Vectors that a task turns at once.
ROWS = 4096


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the column that count, their integers)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    scaled = np.floor(flat * SCALE)
    wrong = np.concatenate(([0], np.cumsum(~(np.abs(scaled) < MOST))))
    ends = np.cumsum(lengths)
    good = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    sizes = np.unique(lengths[good])
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} dimensions in one column")
    return np.flatnonzero(good), scaled[np.repeat(good, lengths)].astype(np.int64).reshape(int(good.sum()), sizes[0] if len(sizes) else 0)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, two for an entry where the row's integers allow it; the first byte says how many."""
    narrow = np.abs(x).max(axis=1, initial=0) < 1 << 15
    return [b"\x02" + r.astype("<i2").tobytes() if s else b"\x08" + r.tobytes() for r, s in zip(x.astype("<i8", copy=False), narrow, strict=True)]


def _unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dimensions), np.int64)
    narrow = np.array([r[0] == 2 for r in rows], bool)
    for mask, code, size in ((narrow, "<i2", 2), (~narrow, "<i8", 8)):
        some = b"".join(r[1:] for r, m in zip(rows, mask, strict=True) if m)
        out[mask] = np.frombuffer(some, code).reshape(-1, dimensions) if some else 0
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where that is enough, else in Python's integers."""
    largest = max(int(np.abs(x).max(initial=0)), max((abs(s) for s in sums), default=0) // n + 1)
    if n * largest < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; None beyond 64 bits."""
    largest = int(np.abs(centred).max(initial=0))
    if centred.dtype == object or largest**2 * centred.shape[1] >= 1 << 63:
        return [s if s < 1 << 63 else None for s in (sum(v * v for v in map(int, row)) for row in centred)]
    return (centred * centred).sum(axis=1).tolist()


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    Cyclic by rows: each sweep turns every pair of axes so that their off-diagonal entry becomes 0, until all of them are
    negligible beside their diagonal entries. The largest entry of an eigenvector is positive."""
    a = np.array(matrix, np.float64)
    a = (a + a.T) / 2
    n = len(a)
    vectors = np.eye(n)
    tiny = np.finfo(float).tiny
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if abs(x) <= 1e-17 * np.sqrt(abs(a[p, p] * a[q, q])) or abs(x) < tiny:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = 1.0 / (theta + np.copysign(np.hypot(1.0, theta), theta))
                c = 1.0 / np.hypot(1.0, t)
                s = t * c
                for m in (a, vectors):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
                rows = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = rows
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], vectors[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values, vectors * signs


@dataclass
class Whitening:
    """n vectors in the fit list, their sums, eigenvalues and unit components (as columns) by falling eigenvalue, and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def matrix(self, k: int) -> np.ndarray:
        """Columns that project on the first k components, over the root of their variance; nan without variance."""
        values = self.values[:k]
        real = values > LEAST_SHARE * max(self.values[0], 0.0)
        return self.components[:, :k] / np.sqrt(np.where(real, values, np.nan))


def fit_list(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors(embedding) -> x: each distinct integer vector once, packed; a table."""

    @lean
    def each(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                _, x = _usable(batch.column(0).slice(a, ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(_packed(x), pa.binary())], names=["x"])

    return materialise(vectors.select(F.col(embedding)).mapInArrow(each, "x binary").distinct(), "fit-list")


def _summed(fitted: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """(vectors, their sums), exactly."""

    @lean
    def each(batches):
        n, sums = 0, [0] * dimensions
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = _unpacked(batch.column(0).slice(a, ROWS), dimensions)
                safe = int(np.abs(x).max(initial=0)) * ROWS < 1 << 62
                n, sums = n + len(x), [s + int(v) for s, v in zip(sums, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimensions), pa.int32()), pa.array(map(str, [n, *sums]), pa.string())], names=["i", "s"])

    rows = fitted.mapInArrow(each, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    got = {r.i: int(r.s) for r in rows}
    return got[-1], [got[i] for i in range(dimensions)]


def _scatter(fitted: DataFrame, dimensions: int, matrix) -> np.ndarray:
    """Sum of y y^T over the fit list, for the y that matrix(x) gives: a partial matrix for each task, summed by entry."""

    @lean
    def each(batches):
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                y = matrix(_unpacked(batch.column(0).slice(a, ROWS), dimensions))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    rows = fitted.mapInArrow(each, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r.j for r in rows), default=-1) + 1
    out = np.zeros((size, size))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit(fitted: DataFrame) -> Whitening | None:
    """The whitening of a ``fit_list``; None if it is empty."""
    sizes = fitted.select(((F.octet_length("x") - 1) / F.when(F.substring("x", 1, 1) == F.lit(b"\x02"), 2).otherwise(8)).cast("int").alias("d")).agg(F.min("d"), F.max("d")).first()
    if sizes[0] is None:
        return None
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} dimensions in one column")
    dimensions = sizes[0]
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} dimensions; {MOST_DIMENSIONS} at most")
    n, sums = _summed(fitted, dimensions)
    covariance = _scatter(fitted, dimensions, lambda x: (_centred(x, n, sums) / n).astype(np.float64)) / n
    values, components = jacobi(covariance)
    return Whitening(n, sums, values, components, float(np.trace(covariance)))


def identity_error(fitted: DataFrame, w: Whitening, k: int) -> float | None:
    """Largest absolute entry of the covariance of the fit list's first k whitened components, less the identity."""
    turn = w.matrix(k)
    turn = turn[:, ~np.isnan(turn).any(axis=0)]
    if not turn.shape[1]:
        return None
    n, sums = w.n, w.sums
    return float(np.abs(_scatter(fitted, w.dimensions, lambda x: (_centred(x, n, sums) / n).astype(np.float64) @ turn) / n - np.eye(turn.shape[1])).max())


def whitened(vectors: DataFrame, w: Whitening, k: int | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vectors(key, embedding) -> key, deviation (long, exact: the sum over dimensions of (n x - S)**2) and whitened (array of the first k components, all by default) of each row that counts."""
    turn = vectors.sparkSession.sparkContext.broadcast(w.matrix(min(k or w.dimensions, w.dimensions)))
    n, sums = w.n, w.sums

    @lean
    def each(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                rows, x = _usable(part.column(1))
                if not len(rows):
                    continue
                if x.shape[1] != len(sums):
                    raise ValueError(f"vectors of {x.shape[1]} dimensions; those fitted have {len(sums)}")
                centred = _centred(x, n, sums)
                out = (centred / n).astype(np.float64) @ turn.value
                flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(_deviations(centred), pa.int64()), lists], names=[key, "deviation", "whitened"])

    rows = vectors.select(F.col(key), F.col(embedding))
    return rows.mapInArrow(each, f"`{key}` {rows.schema[0].dataType.simpleString()}, deviation long, whitened array<double>")


def query(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    fitted = fit_list(vectors)
    w = fit(fitted)
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = min(k, w.dimensions)
    shares = [max(float(v), 0.0) / w.trace if w.trace > 0 else None for v in w.values[:k]]
    rows = whitened(vectors, w, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(fitted, w, k)).cast("double").alias("identity_error"))
