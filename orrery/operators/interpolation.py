"""Repulsion by interpolation on a grid: charges spread to nodes, convolved with the kernel, gathered back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectral import fft_grids

INTERVALS, NODES = 8, 4


def bounds(points: DataFrame) -> tuple[float, float]:
    """One range for both axes."""
    m = points.agg(F.least(F.min("x"), F.min("y")), F.greatest(F.max("x"), F.max("y"))).first()
    return m[0], m[1]


def relative_to_grid(c: str, low: float, high: float) -> Column:
    return (F.col(c) - low) / (high - low)


def interval(rel: Column, intervals: int) -> Column:
    return F.least(F.greatest(F.floor(rel * intervals), F.lit(0)), F.lit(intervals - 1)).cast("int")


def lower_bounds(spark, low: float, high: float, intervals: int = INTERVALS) -> DataFrame:
    """ix, iy and the lower corner of each interval."""
    w = (high - low) / intervals
    i = F.col("id")
    return spark.range(intervals * intervals).select((i % intervals).cast("int").alias("ix"), F.floor(i / intervals).cast("int").alias("iy")).select("ix", "iy", (low + F.col("ix") * w).alias("x"), (low + F.col("iy") * w).alias("y"))


def node_positions(nodes: int = NODES) -> list[float]:
    """Places of the nodes within an interval, 0 to 1."""
    return [(k + 0.5) / nodes for k in range(nodes)]


def denominators(nodes: int = NODES) -> list[float]:
    x = node_positions(nodes)
    return [float(np.prod([a - b for b in x if b != a])) for a in x]


def lagrange(rel: Column, nodes: int = NODES) -> list[Column]:
    """Weight of each node for a place within its interval."""
    x, den = node_positions(nodes), denominators(nodes)
    found = []
    for k in range(nodes):
        product = F.lit(1.0)
        for j in range(nodes):
            if j != k:
                product = product * (rel - x[j])
        found.append(product / den[k])
    return found


def placed(points: DataFrame, low: float, high: float, intervals: int = INTERVALS) -> DataFrame:
    """(id, x, y) with gx, gy (place on the grid), ix, iy (interval) and rx, ry (place within it)."""
    p = points.withColumns({"gx": relative_to_grid("x", low, high), "gy": relative_to_grid("y", low, high)})
    p = p.withColumns({"ix": interval(F.col("gx"), intervals), "iy": interval(F.col("gy"), intervals)})
    return p.withColumns({"rx": F.col("gx") * intervals - F.col("ix"), "ry": F.col("gy") * intervals - F.col("iy")})


def node_weights(points: DataFrame, low: float, high: float, intervals: int = INTERVALS, nodes: int = NODES) -> DataFrame:
    """id, x, y, nx, ny (node numbers), weight: the nodes around each point."""
    p = placed(points, low, high, intervals)
    p = p.withColumns({"wx": F.array(*lagrange(F.col("rx"), nodes)), "wy": F.array(*lagrange(F.col("ry"), nodes))})
    p = p.select("id", "x", "y", "ix", "iy", "wy", F.posexplode("wx").alias("px", "a"))
    p = p.select("id", "x", "y", "ix", "iy", "px", "a", F.posexplode("wy").alias("py", "b"))
    return p.select("id", "x", "y", (F.col("ix") * nodes + F.col("px")).alias("nx"), (F.col("iy") * nodes + F.col("py")).alias("ny"), (F.col("a") * F.col("b")).alias("weight"))


def spread(points: DataFrame, low: float, high: float, intervals: int = INTERVALS, nodes: int = NODES) -> DataFrame:
    """nx, ny, w0 to w3: charges 1, x, y and x^2 + y^2 on the nodes. Grouped on the map side, as there are few nodes."""
    w = node_weights(points, low, high, intervals, nodes)
    charge = (F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return w.groupBy("nx", "ny").agg(*(F.sum(F.col("weight") * c).alias(f"w{k}") for k, c in enumerate(charge)))


def kernel(m: int, h: float) -> np.ndarray:
    """Squared Cauchy kernel between nodes, wrapped around to 2 m x 2 m for a circular convolution."""
    off = np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)) * h
    return 1 / (1 + off[:, None] ** 2 + off[None, :] ** 2) ** 2


def convolved(charges: DataFrame, m: int, h: float) -> DataFrame:
    """spread() -> nx, ny, v0 to v3 of all m x m nodes: charges convolved with the kernel, however large the grid is.

    The grid is rows throughout. Two charges are one complex grid, so that there are two of these and the kernel's, whose transform is real, on 2 m x 2 m nodes; all are
    transformed line by line, multiplied by an equi-join, and transformed back.
    """
    side = 2 * m
    every = charges.sparkSession.range(side * side).select((F.col("id") % side).cast("int").alias("y"), F.floor(F.col("id") / side).cast("int").alias("x"))
    off = lambda c: F.least(F.col(c), side - F.col(c)) * h
    k = 1 / F.pow(1 + off("x") * off("x") + off("y") * off("y"), F.lit(2.0))
    held = every.join(charges.withColumnsRenamed({"nx": "x", "ny": "y"}), ["x", "y"], "left").select("x", "y", *(F.coalesce(f"w{c}", F.lit(0.0)).alias(f"w{c}") for c in range(4)))
    grids = F.explode(F.array(*(F.struct(F.lit(g).alias("grid"), F.col(f"w{2 * g}").alias("re"), F.col(f"w{2 * g + 1}").alias("im")) for g in (0, 1)))).alias("g")
    there = fft_grids(held.select("x", "y", grids).select("g.grid", "y", "x", "g.re", "g.im"), side, side)
    by = fft_grids(every.select(F.lit(0).alias("grid"), "y", "x", k.alias("re"), F.lit(0.0).alias("im")), side, side).select("x", "y", F.col("re").alias("k"))
    back = fft_grids(there.join(by, ["x", "y"]).select("grid", "y", "x", (F.col("re") * F.col("k")).alias("re"), (F.col("im") * F.col("k")).alias("im")), side, side, inverse=True)
    pick = lambda g, c: F.max(F.when(F.col("grid") == g, F.col(c)))
    found = back.where((F.col("x") < m) & (F.col("y") < m)).groupBy(F.col("x").alias("nx"), F.col("y").alias("ny"))
    return found.agg(*(pick(g, c).alias(f"v{2 * g + (c == 'im')}") for g in (0, 1) for c in ("re", "im")))


def gathered(points: DataFrame, grid: DataFrame, low: float, high: float, intervals: int = INTERVALS, nodes: int = NODES) -> DataFrame:
    """(id, x, y) and nx, ny, v0 to v3 -> id, x, y, p0 to p3: what the nodes around each point hold, weighted."""
    near = node_weights(points, low, high, intervals, nodes).join(grid, ["nx", "ny"])
    return near.groupBy("id", "x", "y").agg(*(F.sum(F.col("weight") * F.col(f"v{k}")).alias(f"p{k}") for k in range(4)))


def potentials_by_lines(points: DataFrame, intervals: int = INTERVALS, nodes: int = NODES) -> DataFrame:
    """As potentials(), for grids that no task can hold; intervals x nodes is a power of two."""
    low, high = bounds(points)
    m = intervals * nodes
    grid = convolved(spread(points, low, high, intervals, nodes), m, (high - low) / m)
    return gathered(points, grid, low, high, intervals, nodes)


def potentials(points: DataFrame, intervals: int = INTERVALS, nodes: int = NODES) -> DataFrame:
    """(id, x, y) -> id, x, y, p0 to p3: the kernel's sums over all points, by convolution on the grid.

    Only the grid (its size is a parameter) meets in one task, where an FFT convolves it; points never do. potentials_by_lines() is for larger ones.
    """
    low, high = bounds(points)
    m = intervals * nodes
    full = np.fft.rfft2(kernel(m, (high - low) / m))

    def convolve(grid: pa.Table) -> pa.Table:
        w = np.zeros((4, 2 * m, 2 * m))
        nx, ny = grid.column("nx").to_numpy(), grid.column("ny").to_numpy()
        for k in range(4):
            w[k, nx, ny] = grid.column(f"w{k}").to_numpy()
        v = np.fft.irfft2(np.fft.rfft2(w) * full, s=(2 * m, 2 * m))[:, :m, :m]
        gx, gy = np.divmod(np.arange(m * m), m)
        return pa.table({"nx": pa.array(gx, pa.int32()), "ny": pa.array(gy, pa.int32()), **{f"v{k}": v[k].ravel() for k in range(4)}})

    grid = spread(points, low, high, intervals, nodes).withColumn("grid", F.lit(0)).groupBy("grid").applyInArrow(convolve, "nx int, ny int, v0 double, v1 double, v2 double, v3 double")
    return gathered(points, F.broadcast(grid), low, high, intervals, nodes)  # 16 intervals^2 rows, a parameter


def q_sum(p: Column | None = None) -> Column:
    """A point's share of the normaliser, its own term taken off."""
    x, y = F.col("x"), F.col("y")
    return (1 + x * x + y * y) * F.col("p0") - 2 * (x * F.col("p1") + y * F.col("p2")) + F.col("p3") - 1


def negative_interpolated(points: DataFrame, intervals: int = 32, nodes: int = NODES) -> DataFrame:
    """(id, x, y) -> i, gx, gy: the repulsive gradient."""
    p = potentials(points, intervals, nodes)
    z = p.agg(F.sum(q_sum()).alias("z"))
    force = lambda c, k: (4 * (F.col(c) * F.col("p0") - F.col(f"p{k}")) / F.col("z"))
    return p.crossJoin(F.broadcast(z)).select(F.col("id").alias("i"), force("x", 1).alias("gx"), force("y", 2).alias("gy"))
