"""Whitening of embeddings: the covariance from Spark MLlib's RowMatrix over exactly centred rows.

1. Every component c becomes the whole number x = floor(64 c) + 1000000. The *fit list* is each distinct x vector
   once, so that copies do not weigh; it is written once.
2. n and the sums S of each dimension are exact whole numbers. A centred row is (n x - S) / n, whose numerator is
   exact and which is rounded once.
3. ``RowMatrix.computeGramianMatrix`` over the centred rows, divided by n, is the covariance V: one d x d matrix,
   summed in a tree. Its eigenvectors are found on the driver.
4. Every row is centred likewise and projected in ``mapInPandas`` with the broadcast components (d x ``components``).
5. The covariance of the whitened fit list, by the same Gramian, is held against the identity.

What is collected or broadcast depends on the number of dimensions alone.

Rows with a null vector or with null or non-finite entries take no part; rows with null or repeated ids are rows of
their own. Vectors of different lengths meet as if the shorter one ended in zeros. Whole numbers that no long holds
become the largest or the smallest long, as does a deviation. Where a component has no variance (an eigenvalue below
the rounding of the largest), whitened is 0, and the component is left out of the identity error; a table without
variance has explained 0. An empty table, or one of empty vectors, has no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker, written

SCALE, SHIFT = 64, 1_000_000
LONG = np.iinfo(np.int64)
#: Eigenvalues below this part of the largest are rounding.
NOISE = 1e-12


def shifted(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each component as longs; null for vectors that take no part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def whole(c: Column) -> Column:
        y = SCALE * c.cast("double")
        edge = float(1 << 62)  # beyond, longs are saturated; a double there is whole and the shift is far below its rounding
        inner = F.floor(F.greatest(F.least(y, F.lit(edge)), F.lit(-edge))).cast("long") + SHIFT
        return F.when(y >= float(1 << 63), F.lit(int(LONG.max))).when(y <= -float(1 << 63), F.lit(int(LONG.min))).when(F.abs(y) > edge, F.floor(y).cast("long")).otherwise(inner)

    return F.when(vector.isNotNull() & ~bad, F.transform(vector, whole))


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of longs, shorter ones ended by what a component of zero becomes."""
    grid = np.full((len(vectors), width), SHIFT, np.int64)
    for row, v in zip(grid, vectors, strict=True):
        row[: len(v)] = v
    return grid


@dataclass
class Fit:
    """The fit list's size and sums, exact."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S of each entry: longs where they hold it, Python's integers elsewhere."""
        peak = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
        if self.n * peak + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once or twice from exact numbers."""
        top = self.numerators(x)
        if top.dtype == object:
            return np.array([[v / self.n for v in row] for row in top], np.float64).reshape(x.shape)
        return top / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n x - S)^2 of each row, exact as long as a long holds it."""
        top = self.numerators(x)
        peak = int(np.abs(top).max(initial=0))
        if top.dtype != object and peak * peak * max(1, x.shape[1]) < 1 << 63:
            return (top * top).sum(1)
        return np.array([min(int(LONG.max), sum(int(v) ** 2 for v in row)) for row in top], np.int64).reshape(len(x))


def measured(fit_list: DataFrame, width: int) -> Fit:
    """n and the sums, from one partial sum for each batch and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grid = arranged(batch.column(0), width)
            peak = max(int(grid.max()), -int(grid.min()), 1)
            sums = grid.sum(0).tolist() if peak * len(grid) < 1 << 62 else [sum(c) for c in grid.T.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(s) for s in sums]), pa.array([len(grid)] * width, pa.int64())], names=["at", "s", "n"])

    parts = fit_list.select("x").mapInArrow(worker("whitening", run), "at int, s string, n long")
    found = parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("at").collect()  # a row a dimension
    return Fit(found[0].n if found else 0, [int(r.s) for r in found])


def arranged(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of longs as a matrix, shorter lists ended by what a component of zero becomes."""
    sizes = np.diff(column.offsets.to_numpy())
    grid = np.full((len(column), width), SHIFT, np.int64)
    grid[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return grid


def gramian(fit_list: DataFrame, width: int, fit: Fit, turn: np.ndarray | None = None) -> np.ndarray:
    """The Gramian of the centred fit list by RowMatrix, after ``turn`` (a matrix) if given, divided by n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = fit.centred(arranged(batch.column(0), width))
                rows = rows if turn is None else rows @ turn
                offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["row"])

    rows = fit_list.select("x").mapInArrow(worker("whitening", run), "row array<double>").select(array_to_vector("row").alias("row"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), 0, width if turn is None else turn.shape[1]).computeGramianMatrix()
    return found.toArray() / fit.n


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), shifted(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], SCHEMA)
    # shorter vectors are filled up before they are told apart
    full = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    fit_list = written(rows.select(full.alias("x")).distinct(), "fit-list")
    fit = measured(fit_list, width)
    covariance = gramian(fit_list, width, fit)
    trace = float(np.trace(covariance))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > max(float(values[0]), 0.0) * NOISE
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    turn = axes * scale
    explained = np.where(real, values / trace if trace > 0 else 0.0, 0.0)
    if real.any():
        error = float(np.abs(gramian(fit_list, width, fit, turn[:, real]) - np.eye(int(real.sum()))).max())
    else:
        error = 0.0
    sent = spark.sparkContext.broadcast((fit, turn, explained, error))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, turn, explained, error = sent.value
        k = turn.shape[1]
        for frame in frames:
            if not len(frame):
                continue
            x = padded(frame["x"].tolist(), turn.shape[0])
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": np.int64(fit.n),
                "deviation": fit.deviations(x).repeat(k), "whitened": (fit.centred(x) @ turn).ravel(), "explained": np.tile(explained, len(x)), "identity_error": error,
            })

    return rows.mapInPandas(project, SCHEMA)
