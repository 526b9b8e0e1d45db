"""Principal components of wide tables without a matrix of their width squared: a random range, refined by block Krylov steps and tall-skinny QR."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize

#: Directions of a block, and Krylov blocks, the first one drawn.
WIDTH, BLOCKS = 10, 6
#: Triangular factors that one task merges.
FAN_IN = 16
#: Components of a vector that are handled at once where one is a row each.
SLICE = 4096


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def _summed(points: DataFrame, d: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of part(rows), a d x columns matrix, over all rows: a partition sends its own sum in slices, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, columns)), False
        for batch in batches:
            if batch.num_rows:
                total += part(_rows(batch, d))
                some = True
        for low in range(0, d if some else 0, SLICE):
            cut = total[low : low + SLICE]
            j, c = np.divmod(np.arange(cut.size), columns)
            yield pa.RecordBatch.from_arrays([pa.array(low + j), pa.array(c, pa.int32()), pa.array(cut.ravel())], names=["j", "c", "val"])

    cells = points.select("v").mapInArrow(run, "j long, c int, val double").groupBy("j", "c").agg(F.sum("val").alias("val")).toArrow()
    found = np.zeros((d, columns))
    found[cells.column("j").to_numpy(), cells.column("c").to_numpy()] = cells.column("val").to_numpy()
    return found


def tall_skinny_r(rows: DataFrame, columns: int, fan_in: int = FAN_IN) -> np.ndarray:
    """The triangular factor of a table of rows (v, an array of so many columns): each partition factors its rows, and factors are merged as a tree until one is left.

    A task holds a batch of rows and a factor, or as many factors as it merges.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, columns))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.concatenate((r, _rows(batch, columns))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def merge(group: pa.Table) -> pa.Table:
        stacked = np.concatenate([np.array(x).reshape(-1, columns) for x in group.column("r").to_pylist()])
        return pa.table({"r": pa.array([np.linalg.qr(stacked, mode="r").ravel()], pa.list_(pa.float64()))})

    factors = materialize(rows.select("v").mapInArrow(local, "r array<double>").withColumn("part", F.monotonically_increasing_id()))
    left = factors.count()
    while left > 1:
        groups = -(-left // fan_in)
        factors = materialize(factors.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g")).applyInArrow(merge, "r array<double>").withColumn("part", F.monotonically_increasing_id()))
        left = factors.count()
    found = factors.first()
    return np.array(found.r).reshape(-1, columns) if found else np.zeros((0, columns))


def principal(points: DataFrame, k: int = 2, width: int = WIDTH, blocks: int = BLOCKS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, v) -> means, the k largest eigenvalues of the covariance, and their vectors (the largest entry of each positive).

    A drawn block of directions is multiplied by the centred rows and back, again and again, each time orthogonal to what is there; the rows in terms of all these directions are a tall,
    narrow table, whose factor gives the values and vectors. The driver and each task hold d x width x blocks numbers, never d x d; rows are read once a block
    and once at the end. Values are exact where width x blocks reaches d; else they converge with the blocks, faster the more the values differ.
    """
    d = points.select(F.max(F.size("v"))).first()[0]
    n = points.count()
    if not n or not d:
        return np.zeros(0), np.zeros(0), np.zeros((0, 0))
    mean = _summed(points, d, 1, lambda v: v.sum(axis=0)[:, None])[:, 0] / n
    width = min(width, d)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    block = basis
    while basis.shape[1] < min(d, width * blocks):
        new = _summed(points, d, block.shape[1], lambda v, z=block: (v - mean).T @ ((v - mean) @ z))
        for _ in range(2):  # twice, as once leaves rounding
            new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        block = q[:, np.abs(np.diag(r)) > 1e-10 * max(1e-300, np.abs(r).max())][:, : d - basis.shape[1]]
        if not block.shape[1]:
            break  # the directions hold all that the rows do
        basis = np.linalg.qr(np.concatenate((basis, block), axis=1))[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (_rows(batch, d) - mean) @ basis
            yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.float64()))], names=["v"])

    r = tall_skinny_r(points.select("v").mapInArrow(project, "v array<double>"), basis.shape[1])
    _, s, vt = np.linalg.svd(r)
    vectors = vt[:k] @ basis.T
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    return mean, s[:k] ** 2 / max(n - 1, 1), vectors


def projected(points: DataFrame, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(id, v) -> id, v: coordinates of the centred rows along vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (_rows(batch, len(mean)) - mean) @ vectors.T
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "v"])

    return points.select("id", "v").mapInArrow(run, "id long, v array<double>")
