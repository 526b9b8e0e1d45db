"""Matrices as rows (i, j, val), and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Components of a vector, at most, where a matrix of their square is held; sketching.principal() has no such bound.
MOST_COMPONENTS = 1024


def to_cells(points: DataFrame) -> DataFrame:
    """(id, v) -> (i, j, val)."""
    return points.select(F.col("id").alias("i"), F.posexplode("v").alias("j", "val")).select("i", F.col("j").cast("long").alias("j"), "val")


#: Rows and columns of a tile of a matrix.
TILE = 512


def matmul(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """The product, where a row of one and a column of the other have places in common; absent cells are 0.

    Tiles of one matrix meet those of the other that they are multiplied with, and products of tiles sum up: each cell is sent once for every tile across, not once for every
    cell that it meets.
    """
    size = lambda m, c: F.coalesce(F.floor(F.max(c) / tile) + 1, F.lit(1)).cast("long")
    rows, columns = a.agg(size(a, "i")).first()[0], b.agg(size(b, "j")).first()[0]
    cut = lambda c: F.floor(F.col(c) / tile).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = a.select(cut("i").alias("ti"), cut("j").alias("tk"), every(columns).alias("tj"), F.col("i").cast("long").alias("p"), F.col("j").cast("long").alias("q"), "val")
    right = b.select(every(rows).alias("ti"), cut("i").alias("tk"), cut("j").alias("tj"), F.col("i").cast("long").alias("p"), F.col("j").cast("long").alias("q"), "val")

    def product(x: pa.Table, y: pa.Table) -> pa.Table:
        i = j = np.zeros(0, dtype=np.int64)
        val = np.zeros(0)
        if x.num_rows and y.num_rows:
            low_i, low_j = x.column("ti")[0].as_py() * tile, x.column("tj")[0].as_py() * tile
            sides = []
            for t in (x, y):
                dense, there = np.zeros((tile, tile)), np.zeros((tile, tile), dtype=np.float32)
                at = t.column("p").to_numpy() % tile, t.column("q").to_numpy() % tile
                np.add.at(dense, at, t.column("val").to_numpy())
                there[at] = 1
                sides.append((dense, there))
            i, j = np.nonzero(sides[0][1] @ sides[1][1])
            val = (sides[0][0] @ sides[1][0])[i, j]
            i, j = i + low_i, j + low_j
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "val": pa.array(val, pa.float64())})

    by = ("ti", "tk", "tj")
    fresh = right.select([F.col(c).alias(c) for c in right.columns])  # both may come of one table
    return left.groupBy(*by).cogroup(fresh.groupBy(*by)).applyInArrow(product, "i long, j long, val double").groupBy("i", "j").agg(F.sum("val").alias("val"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("val", "w"), ["i", "j"]).select("i", "j", (F.col("val") - F.col("w")).alias("val"))


def divide(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("val", F.col("val") / by)


def column_moments(points: DataFrame) -> DataFrame:
    """(id, v) -> j, mean, sd (sample, 1 where 0) of each component."""
    m = to_cells(points).groupBy("j").agg(F.avg("val").alias("mean"), F.stddev_samp("val").alias("sd"))
    return m.withColumn("sd", F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd")))


def covariance(points: DataFrame) -> DataFrame:
    """(id, v) -> (i, j, val): sample covariance of the components.

    Each partition sums the products of its rows; Spark adds the sums, dimension squared numbers a partition. Rows are shifted by the overall means first.
    """
    means = to_cells(points).groupBy("j").agg(F.avg("val").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("j").collect()
    mean, n = np.array([r.m for r in means]), means[0].n if means else 0
    d = len(mean)
    if d > MOST_COMPONENTS:
        raise ValueError(f"vectors of {d} components; each task and the driver hold the square of that, so {MOST_COMPONENTS} are the most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - mean
            total += v.T @ v
        i, j = np.divmod(np.arange(d * d), max(d, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "val"])

    sums = points.select("v").mapInArrow(run, "i long, j long, val double").groupBy("i", "j").agg(F.sum("val").alias("val"))
    return sums.withColumn("val", F.col("val") / max(n - 1, 1))


def start_vector(d: int) -> np.ndarray:
    """A fixed positive start for power iteration, from a linear congruential rule."""
    return np.array([((i + 1) * 1103515245 + 12345) % 2147483648 for i in range(d)]) / 2147483648.0


def eigen_top(cov: np.ndarray, k: int = 2, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Power iteration with deflation on a small symmetric matrix: values and vectors, each with its largest entry positive."""
    c, values, vectors = cov.copy(), [], []
    for _ in range(k):
        v = start_vector(len(c))
        for _ in range(rounds):
            v = c @ v
            v /= max(np.linalg.norm(v), 1e-300)
        value = float(v @ c @ v)
        c = c - value * np.outer(v, v)
        values.append(value)
        vectors.append(v * np.sign(v[np.argmax(np.abs(v))] or 1.0))
    return np.array(values), np.array(vectors)


def components(points: DataFrame, k: int = 2, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, eigenvalues and eigenvectors of the covariance. The driver holds a matrix of the dimension squared, whatever the rows."""
    cells = covariance(points).toPandas()
    d = int(cells.i.max()) + 1
    cov = np.zeros((d, d))
    cov[cells.i, cells.j] = cells.val
    values, vectors = eigen_top((cov + cov.T) / 2, k, rounds)
    means = to_cells(points).groupBy("j").agg(F.avg("val").alias("m")).orderBy("j").collect()
    return np.array([r.m for r in means]), values, vectors


def pca(points: DataFrame, k: int = 2, rounds: int = 100) -> DataFrame:
    """(id, v) -> id and the first k principal coordinates, as an array."""
    mean, _, vectors = components(points, k, rounds)
    centred = F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    coords = [F.aggregate(F.zip_with(centred, F.array(*map(F.lit, v.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for v in vectors]
    return points.select("id", F.array(*coords).alias("v"))
