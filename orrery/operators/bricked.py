"""Rays cast brick by brick: bricks that can't matter are left out before anything is sampled, and the others interpolate from what they hold themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import materialize
from . import transfer, volumes
from .rays import blended, transfer_bin
from .volumes import AXES

BRICK = ["bx", "by", "bz"]
#: Runs of samples that one task takes through a brick.
RUNS_A_TASK = 65_536


def zone_map(voxels: DataFrame, size: int, dims: tuple[int, int, int]) -> DataFrame:
    """bx, by, bz, low, high: between what lies each value interpolated in a brick. A voxel on a brick's low face bounds the brick before it too; beside the volume's
    border, where samples may be outside, 0 is a value as well."""
    found = voxels
    for a, b in zip(AXES, BRICK, strict=True):
        own = F.floor(F.col(a) / size).cast("int")
        found = found.withColumn(b, F.explode(F.when((F.col(a) % size == 0) & (F.col(a) > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    ranges = found.groupBy(*BRICK).agg(F.min("val").alias("low"), F.max("val").alias("high"))
    edge = F.lit(False)
    for b, n in zip(BRICK, dims, strict=True):
        edge = edge | (F.col(b) == 0) | ((F.col(b) + 1) * size >= n - 1)
    return ranges.select(*BRICK, F.when(edge, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"), F.when(edge, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"))


def runs(clipped: DataFrame, step: float, size: int) -> DataFrame:
    """Clipped rays -> a row a brick that a ray passes: the ray (px, py, o, d, tmin), the brick, and which of the ray's samples, i0 to i1, have their lower corner there.

    Places are computed as samples are, so that each sample is in one run, and none of them is a row.
    """
    ray = ["px", "py", *(f"{k}{a}" for k in "od" for a in AXES), "tmin"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                t0 = part.column("tmin").to_numpy()
                many = np.floor((part.column("tmax").to_numpy() - t0) / step).astype(np.int64) + 1
                of = np.repeat(np.arange(part.num_rows), many)
                i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                t = t0[of] + i * step
                brick = [np.floor_divide(np.floor(part.column(f"o{a}").to_numpy()[of] + t * part.column(f"d{a}").to_numpy()[of]), size).astype(np.int32) for a in AXES]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | np.any([b[1:] != b[:-1] for b in brick], axis=0))) if len(of) else np.zeros(0, dtype=np.int64)
                last = np.append(first[1:], len(of)) - 1
                rays = part.select(ray).take(pa.array(of[first]))
                columns = [*rays.columns, *(pa.array(b[first]) for b in brick), pa.array(i[first[: len(last)]], pa.int32()), pa.array(i[last] if len(first) else i, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*ray, *BRICK, "i0", "i1"])

    kinds = "px int, py int, " + ", ".join(f"{c} double" for c in ray[2:])
    return clipped.select(*ray, "tmax").mapInArrow(cut, f"{kinds}, bx int, by int, bz int, i0 int, i1 int")


Reduce = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def in_bricks(met: DataFrame, index: DataFrame, cache: DataFrame, size: int, dims: tuple[int, int, int], step: float, reduce: Reduce, schema: str) -> DataFrame:
    """Runs sampled where their bricks are: reduce(px, py, i, val) makes the rows of schema of a task's samples.

    Runs learn their brick's slot, then they and the cached voxels of the slot meet in one task, which interpolates from these alone. A brick that more rays
    pass than a task should take is there as often as they need. Runs of bricks without a slot go.
    """
    placed = met.join(index.where("slot >= 0").select(*BRICK, "slot"), BRICK)
    shares = placed.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / RUNS_A_TASK).cast("int").alias("shares"))
    shares = materialize(shares)
    left = placed.join(shares, "slot").withColumn("share", F.pmod(F.xxhash64("px", "py"), F.col("shares").cast("long")).cast("int"))
    right = cache.join(shares.select(F.col("slot").alias("of"), "shares"), F.col("slot") == F.col("of")).select("slot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "dx", "dy", "dz", "val")

    def sample(passing: pa.Table, held: pa.Table) -> pa.Table:
        side = size + 1
        grid = np.zeros((side + 1,) * 3)  # one more, which a weight of 0 may look at
        inside = [held.column(f"d{a}").to_numpy() for a in AXES]
        grid[tuple(inside)] = held.column("val").to_numpy()
        many = passing.column("i1").to_numpy().astype(np.int64) - passing.column("i0").to_numpy() + 1 if passing.num_rows else np.zeros(0, dtype=np.int64)
        of = np.repeat(np.arange(len(many)), many)
        i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(passing.column("i0").to_numpy(), many)
        t = passing.column("tmin").to_numpy()[of] + i * step
        place = [passing.column(f"o{a}").to_numpy()[of] + t * passing.column(f"d{a}").to_numpy()[of] for a in AXES]
        within = np.all([(s >= 0) & (s < n - 1) for s, n in zip(place, dims, strict=True)], axis=0)
        base = [np.floor(s).astype(np.int64) for s in place]
        part = [s - b for s, b in zip(place, base, strict=True)]
        local = [np.clip(b - passing.column(c).to_numpy()[of].astype(np.int64) * size, 0, size - 1) for b, c in zip(base, BRICK, strict=True)]
        val = np.zeros(len(i))
        for corner in range(8):
            high = [corner >> k & 1 for k in range(3)]
            weight = np.prod([f if h else 1 - f for f, h in zip(part, high, strict=True)], axis=0)
            val += weight * grid[tuple(p + h for p, h in zip(local, high, strict=True))]
        return pa.table(reduce(passing.column("px").to_numpy()[of], passing.column("py").to_numpy()[of], i, np.where(within, val, 0.0)))

    by = ("slot", "share")
    ray = ["px", "py", *(f"{k}{a}" for k in "od" for a in AXES), "tmin"]
    fresh = left.select([F.col(c).alias(c) for c in (*by, *ray, *BRICK, "i0", "i1")])
    return fresh.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(sample, schema)


def _cached(voxels: DataFrame, wanted: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Index and cache of bricks (bx, by, bz, active), with a voxel more on the high sides."""
    index = materialize(volumes.brick_index(wanted, (1 << 15, 1 << 15, 1 << 15)))
    return index, volumes.brick_cache(index, voxels, size, padding=1)


def mip(clipped: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], step: float, size: int, most: Column) -> DataFrame:
    """px, py, v: the largest sample of each ray over a maximum, as rays.mip() of rays.samples().

    The largest lower bound of the bricks that a ray passes is a value that it reaches; only bricks whose upper bound is above that are sampled for it.
    """
    zones = materialize(zone_map(voxels, size, dims))
    passed = materialize(runs(clipped, step, size).join(zones, BRICK, "left").na.fill(0.0, ["low", "high"]))
    sure = passed.groupBy("px", "py").agg(F.max("low").alias("sure"))
    open_ = materialize(passed.join(sure, ["px", "py"]).where(F.col("high") > F.col("sure")).drop("low", "high", "sure"))
    wanted = zones.join(open_.select(*BRICK).distinct().withColumn("active", F.lit(True)), BRICK, "left").select(*BRICK, F.coalesce("active", F.lit(False)).alias("active"))
    index, cache = _cached(voxels, wanted, size)

    def largest(px: np.ndarray, py: np.ndarray, i: np.ndarray, val: np.ndarray) -> dict[str, np.ndarray]:
        order = np.lexsort((px, py))
        px, py, val = px[order], py[order], val[order]
        first = np.flatnonzero(np.append(True, (px[1:] != px[:-1]) | (py[1:] != py[:-1]))) if len(px) else np.zeros(0, dtype=np.int64)
        return {"px": px[first], "py": py[first], "v": np.maximum.reduceat(val, first) if len(first) else val}

    found = in_bricks(open_, index, cache, size, dims, step, largest, "px int, py int, v double")
    both = sure.select("px", "py", F.col("sure").alias("v")).unionByName(found)
    return both.groupBy("px", "py").agg((F.greatest(F.max("v"), F.lit(0.0)) / most).alias("v"))


def composite(clipped: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], step: float, size: int, table: DataFrame, most: float) -> DataFrame:
    """px, py, r, g, b, a as rays.composite() of rays.samples(): bricks of whose range the table shows nothing aren't sampled, nor are samples that it doesn't show rows."""
    zones = zone_map(voxels, size, dims)
    wanted = materialize(transfer.shown(zones, table, F.lit(most)).select(*BRICK, F.col("visible").alias("active")))
    index, cache = _cached(voxels, wanted, size)
    colours = {r.bin: (r.r, r.g, r.b, r.a) for r in table.collect()}  # 256 rows
    lut = np.array([colours[k] for k in sorted(colours)])

    def seen(px: np.ndarray, py: np.ndarray, i: np.ndarray, val: np.ndarray) -> dict[str, np.ndarray]:
        colour = lut[np.minimum(np.floor(val / most * len(lut)), len(lut) - 1).astype(np.int64)]
        on = colour[:, 3] > 0
        return {"px": px[on], "py": py[on], "i": i[on].astype(np.int32), **{c: colour[on, k] for k, c in enumerate("rgba")}}

    found = in_bricks(runs(clipped, step, size), index, cache, size, dims, step, seen, "px int, py int, i int, r double, g double, b double, a double")
    every = clipped.select("px", "py").distinct().join(blended(found), ["px", "py"], "left")
    return every.select("px", "py", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgba"))
