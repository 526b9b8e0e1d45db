"""Scalar volumes as voxel rows (x, y, z, val): statistics, gradients, sampling, blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered

AXES = ("x", "y", "z")


def histogram(voxels: DataFrame) -> DataFrame:
    """bin (the value's whole part), n: every bin from 0, or the smallest if that is less, to the largest, empty ones too. Bins are a range, cut into tasks, however many there are."""
    counted = voxels.groupBy(F.col("val").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin IS NOT NULL")
    low, high = counted.agg(F.least(F.min("bin"), F.lit(0).cast("long")), F.max("bin")).first()
    every = voxels.sparkSession.range(low, high + 1 if high is not None else low).select(F.col("id").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Voxels along the side of a brick of which gradients are taken at once.
SIDE = 32


def gradients(voxels: DataFrame, clamped: bool = False, side: int = SIDE) -> DataFrame:
    """x, y, z, gx, gy, gz, mag: central differences along each axis, of a dense volume.

    Halved and 0 on the border; or, clamped, neither halved nor 0 there: the border value stands in for the missing one. Voxels go to bricks, those at a brick's
    face to the brick beyond it too, so that one shuffle serves all three axes.
    """
    at = {a: F.floor(F.col(a) / side).cast("int") for a in AXES}
    own = F.struct(*(at[a].alias(f"b{a}") for a in AXES))
    beyond = []
    for a in AXES:
        for edge, step in ((0, -1), (side - 1, 1)):
            there = F.struct(*((at[o] + (step if o == a else 0)).alias(f"b{o}") for o in AXES))
            beyond.append(F.when(F.pmod(F.col(a), F.lit(side)) == edge, there))
    rows = voxels.select(*(F.col(a).cast("int").alias(a) for a in AXES), F.col("val").cast("double").alias("val"), F.explode(F.array_compact(F.array(own, *beyond))).alias("b"))

    def differences(t: pa.Table) -> pa.Table:
        place = np.stack([t.column(a).to_numpy() for a in AXES]).astype(np.int64)
        low = np.array([[t.column(f"b{a}")[0].as_py()] for a in AXES]) * side
        local, val = place - low + 1, t.column("val").to_numpy()
        grid = np.full((side + 2,) * 3, np.nan)
        grid[tuple(local)] = val
        mine = ((local > 0) & (local <= side)).all(axis=0)
        local, val, place = local[:, mine], val[mine], place[:, mine]
        found = []
        for k in range(3):
            step = np.zeros((3, 1), dtype=np.int64)
            step[k] = 1
            after, before = grid[tuple(local + step)], grid[tuple(local - step)]
            found.append(np.where(np.isnan(after), val, after) - np.where(np.isnan(before), val, before) if clamped else (after - before) / 2)
        if not clamped:
            inner = ~np.isnan(found).any(axis=0)
            found = [np.where(inner, f, 0.0) for f in found]
        columns = [pa.array(p, pa.int32()) for p in place] + [pa.array(f) for f in found]
        return pa.table(columns, names=[*AXES, *(f"g{a}" for a in AXES)])

    flat = rows.select("b.*", *AXES, "val").groupBy(*(f"b{a}" for a in AXES)).applyInArrow(differences, "x int, y int, z int, gx double, gy double, gz double")
    return flat.select("*", F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in ("y", "z")), F.col("gx") * F.col("gx"))).alias("mag"))


def nearest(points: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], key: list[str], values: list[str] = ["val"]) -> DataFrame:  # noqa: B006
    """Points (key columns, sx, sy, sz) with the values of the voxel that each is nearest to, half up; 0 outside."""
    cells = points.withColumns({a: F.floor(F.col(f"s{a}") + 0.5).cast("int") for a in AXES})
    return cells.join(voxels, list(AXES), "left").select(*key, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def trilinear(points: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], key: list[str], values: list[str] = ["val"], half_voxel: bool = False) -> DataFrame:  # noqa: B006
    """Points (key columns, sx, sy, sz) with values interpolated from the eight voxels around; 0 outside 0 to dim - 1.

    half_voxel: texture coordinates, whose voxel centres are at one half; what lies in 0 to dim is inside and the border value goes on outwards.
    Each point becomes eight weighted rows that meet their voxels by place and sum up again.
    """
    shift = 0.5 if half_voxel else 0.0
    inside = F.lit(True)
    for a, n in zip(AXES, dims, strict=True):
        inside = inside & (F.col(f"s{a}").between(0, n) if half_voxel else (F.col(f"s{a}") >= 0) & (F.col(f"s{a}") < n - 1))
    p = points.withColumn("inside", inside)
    for a in AXES:
        p = p.withColumn(f"b{a}", F.floor(F.col(f"s{a}") - shift).cast("int")).withColumn(f"f{a}", F.col(f"s{a}") - shift - F.col(f"b{a}"))
    corners = F.array(*(F.struct(*(F.lit((c >> k) & 1).alias(f"c{a}") for k, a in enumerate(AXES))) for c in range(8)))
    p = p.select(*key, "inside", *(f"b{a}" for a in AXES), *(f"f{a}" for a in AXES), F.explode(F.when(F.col("inside"), corners).otherwise(F.slice(corners, 1, 1))).alias("c"))
    weight = F.lit(1.0)
    for a in AXES:
        weight = weight * F.when(F.col(f"c.c{a}") == 1, F.col(f"f{a}")).otherwise(1 - F.col(f"f{a}"))
    at = {a: F.when(F.col("inside"), F.least(F.greatest(F.col(f"b{a}") + F.col(f"c.c{a}"), F.lit(0)), F.lit(n - 1))).cast("int").alias(a) for a, n in zip(AXES, dims, strict=True)}
    rows = p.select(*key, *at.values(), weight.alias("weight"))  # a point outside is a row without a place
    return rows.join(voxels, list(AXES), "left").groupBy(*key).agg(*(F.sum(F.coalesce(F.col("weight") * F.col(v), F.lit(0.0))).alias(v) for v in values))


def bilinear(points: DataFrame, voxels: DataFrame, key: list[str]) -> DataFrame:
    """Points (key columns, sx, sy, z) in a plane: between the four voxels around."""
    p = points.withColumns({"bx": F.floor("sx").cast("int"), "by": F.floor("sy").cast("int")})
    corner = F.explode(F.array(*(F.struct(F.lit(c & 1).alias("cx"), F.lit(c >> 1).alias("cy")) for c in range(4)))).alias("c")
    p = p.select("*", corner)
    side = lambda a: F.when(F.col(f"c.c{a}") == 1, F.col(f"s{a}") - F.col(f"b{a}")).otherwise(1 - (F.col(f"s{a}") - F.col(f"b{a}")))
    rows = p.select(*key, (F.col("bx") + F.col("c.cx")).alias("x"), (F.col("by") + F.col("c.cy")).alias("y"), "z", (side("x") * side("y")).alias("weight"))
    return rows.join(voxels, list(AXES)).groupBy(*key).agg(F.sum(F.col("weight") * F.col("val")).alias("val"))


# ---- bricks --------------------------------------------------------------------------------------------------------


def bricks(voxels: DataFrame, size: int) -> DataFrame:
    """bx, by, bz, low, high: the range of values of each block."""
    block = lambda a: F.floor(F.col(a) / size).cast("int").alias(f"b{a}")
    return voxels.groupBy(*map(block, AXES)).agg(F.min("val").alias("low"), F.max("val").alias("high"))


def active(ranges: DataFrame, least: float = 1.0) -> DataFrame:
    return ranges.withColumn("active", F.col("high") - F.col("low") > least)


def pack_dims(n: int, most: int) -> tuple[int, int, int]:
    """Sides under most of the smallest box for n bricks, of those the one with the smallest z, then y; a row if it fits in most; a single cell if no box does."""
    if n <= most:
        return n, 1, 1
    sides = ((math.ceil(n / (y * z)), y, z) for z in range(1, most) for y in range(1, most))
    return min(((x, y, z) for x, y, z in sides if x < most), key=lambda d: (d[0] * d[1] * d[2], d[2], d[1]), default=(1, 1, 1))


def brick_index(ranges: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Each brick with its slot in the packed cache (and place cx, cy, cz), or -1 for those that aren't active."""
    slots = numbered(ranges.where("active").select("bx", "by", "bz"), "bz", ["by", "bx"], "slot").withColumn("slot", F.col("slot").cast("int"))
    found = ranges.join(slots, ["bx", "by", "bz"], "left").withColumn("slot", F.coalesce("slot", F.lit(-1)))
    at = lambda v: F.when(F.col("slot") >= 0, v).otherwise(-1).cast("int")
    return found.withColumns({"cx": at(F.col("slot") % dims[0]), "cy": at(F.floor(F.col("slot") / dims[0]) % dims[1]), "cz": at(F.floor(F.col("slot") / (dims[0] * dims[1])))})


def brick_cache(index: DataFrame, voxels: DataFrame, size: int, padding: int = 2) -> DataFrame:
    """Voxels of the active bricks, each with padding on the high sides: slot, dx, dy, dz, val (0 outside the volume)."""
    side = size + padding
    offset = F.explode(F.sequence(F.lit(0), F.lit(side**3 - 1))).alias("o")
    cells = index.where("slot >= 0").select("slot", "bx", "by", "bz", offset)
    cells = cells.withColumns({"dx": (F.col("o") % side).cast("int"), "dy": (F.floor(F.col("o") / side) % side).cast("int"), "dz": F.floor(F.col("o") / side**2).cast("int")})
    cells = cells.withColumns({a: F.col(f"b{a}") * size + F.col(f"d{a}") for a in AXES})
    return cells.join(voxels, list(AXES), "left").select("slot", "dx", "dy", "dz", F.coalesce("val", F.lit(0.0)).alias("val"))


# ---- octree --------------------------------------------------------------------------------------------------------


def tree_depth(dims: tuple[int, int, int], least: int) -> int:
    """Depth of the tree: the halvings after which the largest piece of some side is least or shorter."""
    depth = 0
    while all(-(-n >> depth) > least for n in dims):
        depth += 1
    return depth


def cuts(n: int, depth: int) -> list[tuple[int, int]]:
    """The pieces of a side that is halved again and again: one, then two, then four, down to a depth. The number of piece i at depth k is 2^k - 1 + i."""
    found, level = [], [(0, n)]
    for _ in range(depth + 1):
        found += level
        level = [half for low, high in level for half in ((low, (low + high) // 2), ((low + high) // 2, high))]
    return found


def _looked_up(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def path_of(code: Column, depth: Column) -> Column:
    """Digits of a box: one for each depth below the root."""
    return F.when(depth == 0, "").otherwise(F.lpad(F.conv(code.cast("string"), 10, 8), depth.cast("int"), F.lit("0")))


def octree(spark, dims: tuple[int, int, int], least: int) -> DataFrame:
    """path, depth, box corners, leaf: boxes split in the middle until a side is least or shorter.

    Boxes depend on the dimensions alone: a number of a range is a depth and a digit for each, whose bits are a piece of each side. The pieces are a few literals, and
    a box is there if the one above it is long enough, as sides get no longer downwards.
    """
    depth = tree_depth(dims, least)
    before = [(8**k - 1) // 7 for k in range(depth + 2)]  # boxes of the depths above
    level = F.lit(0)
    for k in range(1, depth + 1):
        level = F.when(F.col("id") >= before[k], k).otherwise(level)
    boxes = spark.range(before[depth + 1]).select(level.alias("depth"), "id").select("depth", (F.col("id") - _looked_up(before, F.col("depth"))).alias("code"))
    piece = lambda k: sum((F.shiftleft(F.shiftright("code", 3 * j + k).bitwiseAND(F.lit(1)), j) for j in range(1, depth)), F.shiftright("code", k).bitwiseAND(F.lit(1)))
    first = F.expr("shiftleft(1, depth)") - 1
    boxes = boxes.select("*", *((first + piece(k)).alias(f"p{a}") for k, a in enumerate(AXES)))
    ends = []
    for a, n in zip(AXES, dims, strict=True):
        sides = cuts(n, depth)
        ends += [_looked_up([s[e] for s in sides], F.col(f"p{a}")).alias(f"{a}{e}") for e in (0, 1)]
        # the piece above piece p is (p - 1) / 2
        ends.append(_looked_up([high - low for low, high in sides], F.floor((F.col(f"p{a}") - 1) / 2)).alias(f"above{a}"))
    found = boxes.select("depth", "code", *ends)
    there = F.least(*(F.col(f"above{a}") for a in AXES)) > least
    leaf = F.least(*(F.col(f"{a}1") - F.col(f"{a}0") for a in AXES)) <= least
    kept = found.where((F.col("depth") == 0) | there)
    return kept.select(path_of(F.col("code"), F.col("depth")).alias("path"), "depth", *(F.col(f"{a}{e}").cast("int").alias(f"{a}{e}") for e in (0, 1) for a in AXES), leaf.alias("leaf"))


def leaf_path(dims: tuple[int, int, int], least: int) -> Column:
    """The path of the leaf that holds a voxel (x, y, z): what each coordinate says of it, digits and how deep it goes, is looked up in literals as long as the sides."""
    depth = tree_depth(dims, least)
    code, deep = F.lit(0).cast("long"), []
    for k, (a, n) in enumerate(zip(AXES, dims, strict=True)):
        digits, depths = [], []
        for at in range(n):
            low, high, number, end = 0, n, 0, depth if n > least else 0
            for j in range(1, depth + 1):
                middle = (low + high) // 2
                number = 8 * number + ((at >= middle) << k)
                low, high = (middle, high) if at >= middle else (low, middle)
                if high - low <= least:
                    end = min(end, j)
            digits.append(number)
            depths.append(end)
        code = code + _looked_up(digits, F.col(a))
        deep.append(_looked_up(depths, F.col(a)))
    full = path_of(code, F.lit(depth))
    return F.substr(full, F.lit(1), F.least(*deep))


def prefixes(path: Column) -> Column:
    """A path and all paths above it."""
    return F.transform(F.sequence(F.lit(0), F.length(path)), lambda k: F.substr(path, F.lit(1), k))


def occupied_leaves(boxes: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], least: int, occupied: Column) -> DataFrame:
    """Leaves with whether a condition over their voxels holds (occupied: an aggregate of val). Voxels are grouped by the paths that their places give."""
    hit = voxels.groupBy(leaf_path(dims, least).alias("path")).agg(occupied.alias("full"))
    return boxes.where("leaf").join(hit, "path", "left").withColumn("full", F.coalesce("full", F.lit(False)))


def occupancy(boxes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Every box with its numbers of empty and full leaves, and its class: 0 if more are empty, else 1."""
    rolled = leaves.select(F.explode(prefixes(F.col("path"))).alias("path"), "full").groupBy("path").agg(F.sum(F.when(F.col("full"), 0).otherwise(1)).cast("long").alias("n_empty"), F.sum(F.when(F.col("full"), 1).otherwise(0)).cast("long").alias("n_full"))
    return boxes.join(rolled, "path").withColumn("class", F.when(F.col("n_empty") > F.col("n_full"), 0).otherwise(1))


def emitted(classed: DataFrame) -> DataFrame:
    """Back and front faces of the root and of boxes of another class than their parent's, in the order of a walk through the tree."""
    up = classed.select(F.col("path").alias("parent"), F.col("class").alias("parent_class"))
    own = classed.withColumn("parent", F.when(F.length("path") > 0, F.expr("substr(path, 1, length(path) - 1)")))
    shown = own.join(up, "parent", "left").where(F.col("parent_class").isNull() | (F.col("parent_class") != F.col("class")))
    faces = shown.select("path", "x0", "y0", "z0", "x1", "y1", "z1", "class", F.explode(F.array(F.lit(0), F.lit(1))).alias("front"))
    # a box's back comes before its children and its front after them: ~ sorts behind all digits
    keyed = faces.withColumn("key__", F.when(F.col("front") == 0, F.col("path")).otherwise(F.concat("path", F.lit("~")))).withColumn("top__", F.left("key__", F.lit(2)))
    return numbered(keyed, "top__", ["key__"], "seq", start=1).drop("key__", "top__")


def edges(boxes: DataFrame) -> DataFrame:
    """path, edge (0 to 11), ax, ay, az, bx, by, bz: the edges of boxes, four along each axis, with their end points."""
    along, first, second = F.floor(F.col("e") / 4), F.col("e") % 2 == 1, F.floor(F.col("e") / 2) % 2 == 1
    cut = boxes.select("path", *(f"{a}{e}" for a in AXES for e in (0, 1)), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("e"))
    ends = []
    for end in (0, 1):
        for k, a in enumerate(AXES):
            # of the two other axes the first one has the lower bit
            high = {0: F.when(along == 2, first).when(along == 1, first), 1: F.when(along == 0, first).when(along == 2, second), 2: second}[k]
            ends.append(F.when(along == k, F.col(f"{a}{end}")).when(high, F.col(f"{a}1")).otherwise(F.col(f"{a}0")).alias(f"{'ab'[end]}{a}"))
    return cut.select("path", F.col("e").alias("edge"), *ends)
