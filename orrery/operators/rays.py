"""Ray queries over a voxel volume: rays, clipping, samples, and what they add up to."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import with_phong
from ..functions.tables import discard, materialize
from . import volumes
from .intervals import within
from .volumes import AXES, trilinear


@dataclass(frozen=True)
class Camera:
    """A pinhole camera that looks along the third axis, in voxel units."""

    eye: tuple[float, float, float]
    width: int
    height: int
    fovy: float = math.pi / 3
    aspect: float = 1.0


@dataclass(frozen=True)
class OrbitCamera:
    """An eye on a sphere around a point; angles in radians about the x, then the y axis."""

    look_at: tuple[float, float, float]
    distance: float
    pitch: float = 0.0
    yaw: float = 0.0

    def rotation(self) -> list[list[float]]:
        cx, sx, cy, sy = math.cos(self.pitch), math.sin(self.pitch), math.cos(self.yaw), math.sin(self.yaw)
        return [[cy, sy * sx, sy * cx], [0.0, cx, -sx], [-sy, cy * sx, cy * cx]]

    def eye(self) -> tuple[float, ...]:
        return tuple(c - self.distance * row[2] for c, row in zip(self.look_at, self.rotation(), strict=True))


def rays(spark, camera: Camera, turned: list[list[float]] | None = None) -> DataFrame:
    """px, py, origin (ox, oy, oz) and unit direction (dx, dy, dz) of the ray through each pixel."""
    half = math.tan(camera.fovy / 2)
    i = F.col("id")
    pixels = spark.range(camera.width * camera.height).select((i % camera.width).cast("int").alias("px"), F.floor(i / camera.width).cast("int").alias("py"))
    cx = (F.col("px") / camera.width * 2.0 - 1.0) * (half * camera.aspect)
    cy = (F.col("py") / camera.height * 2.0 - 1.0) * half
    size = F.sqrt(cx * cx + cy * cy + 1.0)
    local = [cx / size, cy / size, 1.0 / size]
    if turned is not None:
        local = [sum((c * m for c, m in zip(local[1:], row[1:], strict=True)), local[0] * row[0]) for row in turned]
    return pixels.select("px", "py", *(F.lit(float(o)).alias(f"o{a}") for a, o in zip(AXES, camera.eye, strict=True)), *(c.alias(f"d{a}") for a, c in zip(AXES, local, strict=True)))


def clip(found: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Rays that meet a box, with tmin and tmax: where they are inside all three slabs."""
    enter, leave = [], []
    for a, lo, hi in zip(AXES, low, high, strict=True):
        o, d = F.col(f"o{a}"), F.nullif(F.col(f"d{a}"), F.lit(0.0))
        t0, t1 = (lo - o) / d, (hi - o) / d
        within = (o >= lo) & (o <= hi)
        enter.append(F.when(d.isNull(), F.when(within, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.least(t0, t1)))
        leave.append(F.when(d.isNull(), F.when(within, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.greatest(t0, t1)))
    return found.withColumns({"tmin": F.greatest(*enter), "tmax": F.least(*leave)}).where("tmin <= tmax")


def along(clipped: DataFrame, step: float) -> DataFrame:
    """Places along each ray from tmin to tmax: px, py, i, t, sx, sy, sz."""
    last = F.floor((F.col("tmax") - F.col("tmin")) / step).cast("int")
    p = clipped.withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("t", F.col("tmin") + F.col("i") * step)
    return p.select("px", "py", "i", "t", *((F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"s{a}") for a in AXES))


def samples(clipped: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], step: float) -> DataFrame:
    """px, py, i, t, val along each ray."""
    return trilinear(along(clipped, step), voxels, dims, ["px", "py", "i", "t"])


def mip(found: DataFrame, most: Column) -> DataFrame:
    """The largest sample of each ray over a maximum."""
    return found.groupBy("px", "py").agg((F.greatest(F.max("val"), F.lit(0.0)) / most).alias("v"))


def first_crossing(found: DataFrame, iso: float, rising_only: bool = True) -> DataFrame:
    """px, py, t0, t1, v0, v1 of the first step over a value (upwards only, or either way)."""
    w = Window.partitionBy("px", "py").orderBy("i")
    steps = found.withColumns({"v0": F.lag("val").over(w), "t0": F.lag("t").over(w)})
    up = (F.col("v0") < iso) & (F.col("val") >= iso)
    hit = up if rising_only else up | ((F.col("v0") > iso) & (F.col("val") <= iso))
    first = steps.where(hit).groupBy("px", "py").agg(F.min_by(F.struct("t0", F.col("t").alias("t1"), "v0", F.col("val").alias("v1")), "i").alias("h"))
    return first.select("px", "py", "h.*")


def bisect(crossing: DataFrame, clipped: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], iso: float, rounds: int = 20, close: float = 0.01) -> DataFrame:
    """px, py, t where the value along the ray is within close of iso, by halving. Each round samples all open rays at once."""
    state = crossing.select("px", "py", F.col("t0").alias("a"), F.col("t1").alias("b"), F.lit(None).cast("double").alias("t"))
    rays_ = materialize(clipped).select("px", "py", *(f"{k}{a}" for k in "od" for a in AXES))
    for _ in range(rounds):
        mid = state.join(rays_, ["px", "py"]).withColumn("m", (F.col("a") + F.col("b")) / 2)
        places = mid.select("px", "py", *((F.col(f"o{a}") + F.col("m") * F.col(f"d{a}")).alias(f"s{a}") for a in AXES))
        seen = state.join(trilinear(places, voxels, dims, ["px", "py"]), ["px", "py"]).withColumn("m", (F.col("a") + F.col("b")) / 2)
        done = F.col("t").isNotNull()
        before, state = state, materialize(seen.select("px", "py", F.when(~done & (F.col("val") <= iso), F.col("m")).otherwise(F.col("a")).alias("a"), F.when(~done & (F.col("val") > iso), F.col("m")).otherwise(F.col("b")).alias("b"), F.when(~done & (F.abs(F.col("val") - iso) < close), F.col("m")).otherwise(F.col("t")).alias("t")))
        discard(before, crossing)
    discard(rays_)
    return state.select("px", "py", F.coalesce("t", (F.col("a") + F.col("b")) / 2).alias("t"))


def transfer_bin(val: Column, most: Column, size: int = 256) -> Column:
    """Entry of a transfer table for a value."""
    return F.least(F.floor(val / most * size), F.lit(size - 1)).cast("int")


def composite(found: DataFrame, table: DataFrame, most: Column) -> DataFrame:
    """Front-to-back compositing of samples coloured by a 256-row table (bin, r, g, b, a): px, py, r, g, b, a.

    A ray's samples are an array in order, folded until its opacity is 0.99.
    """
    return blended(found.withColumn("bin", transfer_bin(F.col("val"), most)).join(F.broadcast(table), "bin"))  # 256 rows


def blended(coloured: DataFrame) -> DataFrame:
    """(px, py, i, r, g, b, a) samples -> px, py, r, g, b, a, front to back."""
    lists = coloured.groupBy("px", "py").agg(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b", "a"))).alias("s"))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))

    def blend(acc: Column, s: Column) -> Column:
        w = (1 - acc["a"]) * s["a"]
        return F.when(acc["a"] >= 0.99, acc).otherwise(F.struct(*((acc[c] + w * s[c]).alias(c) for c in "rgb"), (acc["a"] + w).alias("a")))

    return lists.select("px", "py", F.aggregate("s", zero, blend).alias("c")).select("px", "py", "c.*")


def slice_plane(found: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], most: Column) -> DataFrame:
    """Values on the plane through the middle, across the view along the third axis."""
    t = (dims[2] / 2.0 - F.col("oz")) / F.col("dz")
    places = found.select("px", "py", *((F.col(f"o{a}") + t * F.col(f"d{a}")).alias(f"s{a}") for a in AXES))
    return trilinear(places, voxels, dims, ["px", "py"]).select("px", "py", (F.greatest(F.col("val"), F.lit(0.0)) / most).alias("v"))


def shade(hits: DataFrame, gradients: DataFrame, dims: tuple[int, int, int], eye: tuple[float, float, float], colour: list[float], **model) -> DataFrame:
    """Hits (px, py, sx, sy, sz) with Phong colours r, g, b; the light is at the eye."""
    g = trilinear(hits, gradients, dims, ["px", "py"], ["gx", "gy", "gz"]).join(hits, ["px", "py"])
    to_eye = [F.lit(e) - F.col(f"s{a}") for a, e in zip(AXES, eye, strict=True)]
    return with_phong(g, colour, [F.col(f"g{a}") for a in AXES], to_eye, to_eye, **model).select("px", "py", "r", "g", "b")


def visited_boxes(found: DataFrame, dims: tuple[int, int, int], least: int) -> DataFrame:
    """px, py, path, t_in, t_out: the boxes of the octree over dims that each ray passes ahead of its origin, at all depths.

    Many rays walk down together: of the boxes that they pass, the eight halves, by arithmetic; those that are missed go. So no box is looked up and no ray meets boxes far from it.
    """
    depth = volumes.tree_depth(dims, least)
    sides = [np.array(volumes.cuts(n, depth)) for n in dims]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py = batch.column("px").to_numpy(), batch.column("py").to_numpy()
            o, d = ([batch.column(f"{k}{a}").to_numpy() for a in AXES] for k in "od")
            ray, code, piece = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), [np.zeros(batch.num_rows, dtype=np.int64)] * 3
            for level in range(depth + 1):
                box = [s[2**level - 1 + p] for s, p in zip(sides, piece, strict=True)]
                t_in, t_out = np.full(len(ray), -1e30), np.full(len(ray), 1e30)
                for k in range(3):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        t = (box[k] - o[k][ray, None]) / d[k][ray, None]
                    across = d[k][ray] != 0
                    t_in = np.where(across, np.maximum(t_in, t.min(axis=1)), t_in)
                    t_out = np.where(across, np.minimum(t_out, t.max(axis=1)), t_out)
                on = t_out >= np.maximum(t_in, 0)
                ray, code, piece = ray[on], code[on], [p[on] for p in piece]
                columns = [pa.array(px[ray]), pa.array(py[ray]), pa.array(np.full(len(ray), level), pa.int32()), pa.array(code), pa.array(t_in[on]), pa.array(t_out[on])]
                yield pa.RecordBatch.from_arrays(columns, names=["px", "py", "depth", "code", "t_in", "t_out"])
                inner = np.min([b[on][:, 1] - b[on][:, 0] for b in box], axis=0) > least if len(ray) else np.zeros(0, dtype=bool)
                digit = np.tile(np.arange(8), inner.sum())
                ray, code = np.repeat(ray[inner], 8), np.repeat(code[inner], 8) * 8 + digit
                piece = [np.repeat(p[inner], 8) * 2 + (digit >> k & 1) for k, p in enumerate(piece)]

    passed = found.select("px", "py", *(f"{k}{a}" for k in "od" for a in AXES)).mapInArrow(walk, "px int, py int, depth int, code long, t_in double, t_out double")
    return passed.select("px", "py", volumes.path_of(F.col("code"), F.col("depth")).alias("path"), "t_in", "t_out")


def box_events(found: DataFrame, faces: DataFrame, dims: tuple[int, int, int], least: int) -> DataFrame:
    """Rays against emitted box faces (seq, path, class, front): px, py, seq, t, entry, class; front faces give entries at t or 0, back faces exits."""
    both = visited_boxes(found, dims, least).join(faces.select("seq", "path", "class", "front"), "path")
    t = F.when(F.col("front") == 1, F.greatest(F.col("t_in"), F.lit(0.0))).otherwise(F.col("t_out"))
    return both.select("px", "py", "seq", t.alias("t"), F.col("front").alias("entry"), "class")


def ordered_events(events: DataFrame) -> DataFrame:
    """Events with their place in each ray's list (from 1), the last emitted first, and the next event's t: as lists are that grow at their head."""
    w = Window.partitionBy("px", "py").orderBy(F.desc("seq"))
    return events.withColumns({"next": F.lead("t").over(w), "place": F.row_number().over(w).cast("long")})


def events_by_distance(events: DataFrame) -> DataFrame:
    """Events with their place along each ray (from 1), the nearest first, those at one distance in the order of emission, and the next event's t."""
    w = Window.partitionBy("px", "py").orderBy("t", "seq")
    return events.withColumns({"next": F.lead("t").over(w), "place": F.row_number().over(w).cast("long")})


def samples_in_stretches(places: DataFrame, stretches: DataFrame, width: float) -> DataFrame:
    """Samples (px, py, i, t) with n, how many of their ray's stretches (px, py, place, t0, t1) hold them; samples in none are left out."""
    met = within(places.select("px", "py", "i", "t"), stretches.select("px", "py", "t0", "t1"), "t", "t0", "t1", width, ["px", "py"])
    return met.groupBy("px", "py", "i", "t").agg(F.count(F.lit(1)).alias("n"))


def intervals(events: DataFrame) -> DataFrame:
    """Stretches to sample: from the entry into a full box to the ray's next event in its list, the last emitted first."""
    used = ordered_events(events).where("entry = 1 AND class = 1 AND next IS NOT NULL")
    return used.select("px", "py", "place", F.least("t", "next").alias("t0"), F.greatest("t", "next").alias("t1"))


def hit_rectangle(found: DataFrame, low: tuple[float, ...], high: tuple[float, ...], normal: tuple[float, ...]) -> DataFrame:
    """px, py, hit, qx, qy, qz: where rays meet the plane of a rectangle; x and y are held within it where they miss."""
    dot = lambda p: sum((F.col(f"{p}{a}") * n for a, n in zip(AXES[1:], normal[1:], strict=True)), F.col(f"{p}x") * normal[0])
    den = dot("d")
    t = (sum(a * b for a, b in zip(low, normal, strict=True)) - dot("o")) / F.nullif(den, F.lit(0.0))
    ahead = found.withColumn("t", t).where((F.abs(den) >= 1e-6) & (F.col("t") >= 0))
    at = {a: F.col(f"o{a}") + F.col("t") * F.col(f"d{a}") for a in AXES}
    inside = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        inside = inside & (at[a] >= min(lo, hi) - 1e-9) & (at[a] <= max(lo, hi) + 1e-9)
    held = lambda a, k: F.least(F.greatest(at[a], F.lit(float(min(low[k], high[k])))), F.lit(float(max(low[k], high[k]))))
    return ahead.select("px", "py", inside.alias("hit"), held("x", 0).alias("qx"), held("y", 1).alias("qy"), at["z"].alias("qz"))


def rays_by_aspect(spark, camera: Camera) -> DataFrame:
    """px, py, dx, dy, dz: the same pinhole by field of view and aspect, looking down the negative third axis."""
    i = F.col("id")
    x = 2 * camera.aspect * (i % camera.width) / float(camera.width) - camera.aspect
    y = 2 * F.floor(i / camera.width) / float(camera.height) - 1.0
    z = F.lit(-1.0 / math.tan(camera.fovy / 2))
    size = F.sqrt(x * x + y * y + z * z)
    return spark.range(camera.width * camera.height).select((i % camera.width).cast("int").alias("px"), F.floor(i / camera.width).cast("int").alias("py"), (x / size).alias("dx"), (y / size).alias("dy"), (z / size).alias("dz"))


def first_crossing_in_intervals(stretches: DataFrame, found: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], iso: float, step: float) -> DataFrame:
    """px, py, place, t: the first interval of each ray with a step over the value, either way, and where; stretches are (px, py, place, t0, t1)."""
    last = F.floor((F.col("t1") - F.col("t0")) / step).cast("int")
    p = stretches.withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("t", F.col("t0") + F.col("i") * step).join(found, ["px", "py"])
    p = p.select("px", "py", "place", "i", "t", *((F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"s{a}") for a in AXES))
    key = ["px", "py", "place", "i"]
    s = trilinear(p, voxels, dims, key).join(p.select(*key, "t"), key)
    w = Window.partitionBy("px", "py", "place").orderBy("i")
    s = s.withColumn("v0", F.lag("val").over(w))
    hit = s.where((F.col("v0") < iso) & (F.col("val") >= iso) | (F.col("v0") > iso) & (F.col("val") <= iso))
    return hit.groupBy("px", "py").agg(F.min(F.struct("place", "i", "t")).alias("h")).select("px", "py", "h.place", "h.t")
