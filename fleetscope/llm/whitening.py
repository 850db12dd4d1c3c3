"""Whitening of embeddings by polarisation: every covariance is a difference of variances, summed exactly.

Entries become whole numbers ``x = floor(SCALE * c)``, and the model is fitted on the distinct vectors of these. Three passes
over them: counts and sums; then, of the values centred at the whole part of their mean, the sum of squares of each dimension
and of each sum of two dimensions. Since ``2ab = (a + b)^2 - a^2 - b^2``, those give all covariances; the fractional part of the
mean is taken off in whole numbers too, so nothing is rounded before the one division by ``n^3``. The eigenvectors of that
matrix (``eigh`` on the driver; it has a row for each dimension, whatever the table's size) whiten the vectors; the third pass
measures the covariance of what comes out.

Sums leave a task as limbs of ``LIMB`` bits, one row for a dimension or pair, and are added up by Spark as longs. Values too
large for 64-bit squares go through whole numbers of any length, so results don't depend on size.

Defined results: vectors that are null, or hold nulls, NaN or infinities, are dropped. Shorter vectors are filled up with zeros to
the longest. ``floor`` saturates at the range of a long. Rows with equal or null vec_id are answered one by one. Components end
where eigenvalues are zero within rounding, so a table of equal vectors, of empty vectors or of none gives no rows. A deviation
beyond the range of a long is null. Equal eigenvalues leave the choice of their components open. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.common import stored

SCALE = 256
TOP = 4
LIMB, LIMBS = 40, 6
ROWS = 1024  # of a block of vectors
LONG_MAX = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``_id, x``: usable rows as whole numbers."""
    v = F.col(vector_column)
    unusable = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.filter(v.isNotNull() & ~unusable).select(F.col(id_column).alias("_id"), x.alias("x"))


def padded(size: int) -> Column:
    return F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))).alias("x")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """``values`` as 64-bit numbers if results up to ``bound`` fit, else as whole numbers of any length."""
    return values if bound <= LONG_MAX else values.astype(object)


def _limbs(sums: np.ndarray) -> pa.RecordBatch:
    rest, columns = [int(v) for v in sums], [pa.array(np.arange(len(sums)), pa.int64())]
    for _ in range(LIMBS - 1):
        columns.append(pa.array([v & ((1 << LIMB) - 1) for v in rest], pa.int64()))
        rest = [v >> LIMB for v in rest]
    return pa.RecordBatch.from_arrays([*columns, pa.array(rest, pa.int64())], ["place", *(f"l{i}" for i in range(LIMBS))])


def exact_sums(rows: DataFrame, length: int, of_block: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums of ``of_block`` (of ``length`` whole numbers) over all blocks of vectors, as whole numbers of any length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), ROWS):
                total = total + of_block(x[at : at + ROWS]).astype(object)
        yield _limbs(total)

    schema = "place long, " + ", ".join(f"l{i} long" for i in range(LIMBS))
    summed = rows.mapInArrow(add, schema).groupBy("place").agg(*(F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)))
    out = np.zeros(length, object)
    for row in summed.collect():  # a row for each dimension or pair of dimensions
        out[row["place"]] = sum(row[f"l{i}"] << (LIMB * i) for i in range(LIMBS))
    return out


def _sums(size: int) -> Callable:
    def sums(x: np.ndarray) -> np.ndarray:
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        return np.concatenate([[len(x)], _exact(x, largest * len(x)).sum(axis=0)])

    return sums


def _squares(centre: np.ndarray, size: int) -> Callable:
    def squares(x: np.ndarray) -> np.ndarray:
        y = centred(x, centre)
        largest = max(abs(int(v)) for v in (y.max(), y.min())) if y.size else 0
        y = _exact(y, 4 * largest * largest * len(y))
        alone = (y * y).sum(axis=0)
        pairs = [((y[:, i : i + 1] + y[:, i + 1 :]) ** 2).sum(axis=0) for i in range(size - 1)]
        return np.concatenate([alone, *pairs])

    return squares


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    largest = max(abs(int(v)) for v in (x.max(), x.min(), centre.max(), centre.min())) if x.size else 0
    return _exact(x, 2 * largest) - (centre if 2 * largest > LONG_MAX else centre.astype(np.int64))


class Whitening:
    """What a fit leaves: ``n`` distinct vectors with ``sums``, and up to ``top`` unit ``components`` by falling ``values``."""

    def __init__(self, n: int, sums: np.ndarray, squares: np.ndarray, top: int) -> None:
        self.n, self.size = n, len(sums)
        self.centre = np.array([int(s) // n for s in sums], object)
        self.rest = np.array([int(s) - n * int(m) for s, m in zip(sums, self.centre, strict=True)], object)
        # sums of squares of n*x - S, for dimensions and for sums of two
        pairs = [(i, j) for i in range(self.size) for j in range(i + 1, self.size)]
        off = [*self.rest, *(self.rest[i] + self.rest[j] for i, j in pairs)]
        full = [n * n * int(q) - n * int(r) * int(r) for q, r in zip(squares, off, strict=True)]
        self.covariance = np.zeros((self.size, self.size))
        for i in range(self.size):
            self.covariance[i, i] = full[i] / n**3
        for (i, j), both in zip(pairs, full[self.size :], strict=True):
            self.covariance[i, j] = self.covariance[j, i] = (both - full[i] - full[j]) / (2 * n**3)
        self.trace = sum(full[: self.size]) / n**3
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        real = values > self.size * np.finfo(float).eps * max(values[0], 0)
        self.values, self.components = values[real][:top], vectors[:, real][:, :top]

    def project(self, x: np.ndarray) -> np.ndarray:
        y = centred(x, self.centre).astype(float) - np.array([int(r) / self.n for r in self.rest])
        return y @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n*x - S)^2``, through ``n^2*y^2 - 2*n*y*r + r^2``."""
        y = centred(x, self.centre)
        largest = max(abs(int(v)) for v in (y.max(), y.min())) if y.size else 0
        squares = _exact(y, largest * largest * self.size)
        squares = (squares * squares).sum(axis=1)
        most = max(self.rest)
        mixed = (y.astype(object) @ self.rest) if largest * most * self.size > LONG_MAX else y.astype(np.int64) @ self.rest.astype(np.int64)
        n, last = self.n, sum(int(r) * int(r) for r in self.rest)
        exact = (n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True))
        return [v if v <= LONG_MAX else None for v in exact]


def fit_whitening(vectors: DataFrame, size: int, top: int = TOP) -> tuple[Whitening | None, DataFrame]:
    """The whitening fitted on the distinct ``x``, and these, stored."""
    fit = stored(vectors.select("x").distinct(), "fit-list")
    sums = exact_sums(fit, size + 1, _sums(size), size)
    n, sums = int(sums[0]), sums[1:]
    if not n:
        return None, fit
    centre = np.array([int(s) // n for s in sums], object)
    squares = exact_sums(fit, size + size * (size - 1) // 2, _squares(centre, size), size)
    return Whitening(n, sums, squares, top), fit


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened fit vectors minus the identity."""
    k = len(whitening.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = whitening.project(_matrix(batch.column(0), whitening.size))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, c])) for c in range(k)], [f"w{c}" for c in range(k)])

    whitened = fit.mapInArrow(project, ", ".join(f"w{c} double" for c in range(k)))
    found = whitened.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", top: int = TOP) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row and component."""
    rows = whole_vectors(vectors, id_column, vector_column)
    kind = rows.schema["_id"].dataType
    result = T.StructType(
        [T.StructField(id_column, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
         T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())]
    )
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select("_id", padded(size))
    whitening, fit = fit_whitening(rows, size, top) if size else (None, None)
    if whitening is None or not len(whitening.values):
        empty = vectors.sparkSession.createDataFrame([], result)
        return empty.withColumn("identity_error", F.lit(None).cast("double"))
    k = len(whitening.values)
    explained = whitening.values / whitening.trace

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, each = _matrix(part.column(1), size), np.repeat(np.arange(part.num_rows), k)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(each), whitening.n)), pa.array(whitening.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(whitening.project(x).ravel()), pa.array(np.tile(explained, len(x))),
                ]
                yield pa.RecordBatch.from_arrays(columns, result.names)

    return rows.mapInArrow(answer, result).withColumn("identity_error", F.lit(identity_error(fit, whitening)))
