"""Quadtrees of points in the plane, and Barnes-Hut sums on them: points in Z-order, in stretches that send each other what they need of their cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize

#: Points a stretch, about.
STRETCH_ROWS = 16_384
#: Bits of a hash after a point's place in Z-order, so that points at one place can be in several stretches.
SALT_BITS = 10
#: (point, cell) pairs that one step of a walk holds.
WALK_PAIRS = 1 << 21


def bounding_square(points: DataFrame) -> dict[str, float]:
    """Centre and side of the square around all points, a little larger than they need."""
    m = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(m[1] - m[0], m[3] - m[2])
    return {"cx": (m[0] + m[1]) * 0.5, "cy": (m[2] + m[3]) * 0.5, "side": side * (1 + 1e-9)}


def quadtree(points: DataFrame, bucket: int = 100, levels: int = 24) -> DataFrame:
    """(id, x, y) -> depth, ix, iy, n, mx, my, w, leaf: the cells of a quadtree whose leaves hold at most bucket points.

    A point's cells at all depths are its coordinates on ever finer grids, so the whole tree is one aggregation; cells under a leaf are dropped.
    """
    box = bounding_square(points)
    side = box["side"] if box["side"] > 0 else 1.0
    at = lambda c, k: F.least(F.floor((F.col(c) - (box[f"c{c}"] - side / 2)) / side * F.pow(F.lit(2.0), k)), F.pow(F.lit(2.0), k) - 1).cast("long")
    cells = points.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("depth"))
    cells = cells.withColumns({"ix": at("x", F.col("depth")), "iy": at("y", F.col("depth"))})
    cells = cells.groupBy("depth", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    up = cells.select((F.col("depth") + 1).alias("depth"), F.col("ix").alias("ux"), F.col("iy").alias("uy"), F.col("n").alias("parent_n"))
    child = cells.withColumns({"ux": F.shiftright("ix", 1), "uy": F.shiftright("iy", 1)})
    kept = child.join(up, ["depth", "ux", "uy"], "left").where((F.col("depth") == 0) | (F.col("parent_n") > bucket))
    leaf = (F.col("n") <= bucket) | (F.col("depth") == levels)
    return kept.select(F.col("depth").cast("int").alias("depth"), "ix", "iy", "n", "mx", "my", (F.lit(side) / F.pow(F.lit(2.0), "depth")).alias("w"), leaf.alias("leaf"))


# ---- Z-order -------------------------------------------------------------------------------------------------------


def z_order(ix: np.ndarray, iy: np.ndarray, bits: int) -> np.ndarray:
    """Bits of two numbers in turn, those of iy first."""
    code = np.zeros(len(ix), dtype=np.int64)
    for k in range(bits):
        code |= ((ix >> k & 1) << (2 * k)) | ((iy >> k & 1) << (2 * k + 1))
    return code


@dataclass
class Cells:
    """Cells of a quadtree in the order of keys: a 1, then two bits a depth. Children of key k are 4 k to 4 k + 3, the root is 1."""

    key: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, -1: nowhere."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(len(key), -1)

    def plus(self, other: Cells) -> Cells:
        joined = [np.concatenate(x) for x in ((self.key, other.key), (self.n, other.n), (self.x, other.x), (self.y, other.y))]
        order = np.argsort(joined[0], kind="stable")
        return Cells(*(x[order] for x in joined))


NO_CELLS = Cells(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))


@dataclass
class Square:
    """The square of a tree, its depth and what makes a leaf."""

    left: float
    low: float
    side: float
    levels: int
    bucket: int

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = 2.0**self.levels
        ix, iy = (np.minimum(np.floor((v - edge) / self.side * size), size - 1).astype(np.int64) for v, edge in ((x, self.left), (y, self.low)))
        return z_order(ix, iy, self.levels)

    def key(self, code: np.ndarray, depth: int) -> np.ndarray:
        return (code >> (2 * (self.levels - depth))) | (1 << (2 * depth))

    def width(self, depth: int) -> float:
        return self.side / 2.0**depth

    def cut_sums(self, code: np.ndarray, x: np.ndarray, y: np.ndarray, cut: list[np.ndarray]) -> Cells:
        """Numbers and sums of coordinates of points in Z-order, in some cells of each depth."""
        found = [NO_CELLS]
        for depth, wanted in enumerate(cut):
            key = self.key(code, depth)
            on = np.isin(key, wanted)
            if on.any():
                found.append(_grouped(key[on], x[on], y[on]))
        return _joined(found)

    def own(self, code: np.ndarray, x: np.ndarray, y: np.ndarray, top: Cells) -> Cells:
        """Cells of a stretch's points in Z-order, but for those under a leaf and those of top, which more stretches have a part in."""
        found, open_ = [NO_CELLS], np.ones(len(code), dtype=bool)
        for depth in range(self.levels + 1):
            on = np.flatnonzero(open_)
            if not len(on):
                break
            cells = _grouped(self.key(code[on], depth), x[on], y[on])
            shared = top.find(cells.key)
            whole = np.where(shared >= 0, top.n[shared] if len(top.n) else 0, cells.n)
            open_[on] = np.repeat(whole > self.bucket, cells.n)
            found.append(Cells(*(v[shared < 0] for v in (cells.key, cells.n, cells.x, cells.y))))
        return _joined(found)

    def runs(self, key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points of cells begin and end among points in Z-order."""
        depth = np.zeros(len(key), dtype=np.int64)
        for k in range(1, self.levels + 1):
            depth[key >> (2 * k) > 0] = k
        shift = 2 * (self.levels - depth)
        first = (key - (np.int64(1) << (2 * depth))) << shift
        return np.searchsorted(code, first), np.searchsorted(code, first + (np.int64(1) << shift))

    def members(self, key: np.ndarray, code: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, x, y, number of points) of each place in some leaves."""
        begin, end = self.runs(key, code)
        many = end - begin
        at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        return _places(np.repeat(key, many), x[at], y[at], np.ones(len(at), dtype=np.int64))


def _grouped(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> Cells:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return Cells(key[first], np.diff(np.append(first, len(key))), np.add.reduceat(x, first), np.add.reduceat(y, first))


def _joined(cells: list[Cells]) -> Cells:
    """Cells of rising depths, whose keys rise too."""
    return Cells(*(np.concatenate([getattr(c, f) for c in cells]) for f in ("key", "n", "x", "y")))


def _far(width: float, theta: float, d2: np.ndarray) -> np.ndarray:
    return (d2 > 0) & (width * width < theta * theta * d2)


# ---- what stretches send each other ----------------------------------------------------------------------------------


def _essential(square: Square, mine: Cells, top: Cells, boxes: np.ndarray, to: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells of a stretch, those that the walks of other stretches may come to: (stretch, place of the cell in mine), and (stretch, key) of leaves whose points they need.

    A walk that any point of a box (left, right, low, high) might make goes on under a cell; where all points of the box take a cell as far, it ends.
    """
    key = np.ones(len(to), dtype=np.int64)
    sent, leaves = [], []
    for depth in range(square.levels + 1):
        if not len(to):
            break
        shared, own = top.find(key), mine.find(key)
        some = (shared >= 0) | (own >= 0)
        to, key, shared, own = to[some], key[some], shared[some], own[some]
        at_top = shared >= 0
        pick = lambda f: np.where(at_top, getattr(top, f)[shared] if len(top.key) else 0, getattr(mine, f)[own] if len(mine.key) else 0)
        n = pick("n")
        mx, my = pick("x") / n, pick("y") / n
        sent.append((to[~at_top], own[~at_top]))
        b = boxes[to]
        dx, dy = np.maximum(np.maximum(b[:, 0] - mx, mx - b[:, 1]), 0), np.maximum(np.maximum(b[:, 2] - my, my - b[:, 3]), 0)
        leaf = (n <= square.bucket) | (depth == square.levels)
        leaves.append((to[leaf], key[leaf]))
        on = ~leaf & ~_far(square.width(depth), theta, (dx * dx + dy * dy) * (1 - 1e-9))
        to = np.repeat(to[on], 4)
        key = (key[on][:, None] * 4 + np.arange(4)).ravel()
    join = lambda pairs, k: np.concatenate([p[k] for p in pairs] or [np.zeros(0, dtype=np.int64)])
    return join(sent, 0), join(sent, 1), join(leaves, 0), join(leaves, 1)


def _places(key: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points of a leaf that stand at one place, as one with their number."""
    order = np.lexsort((y, x, key))
    key, x, y, m = key[order], x[order], y[order], m[order]
    new = np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(key) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return key[first], x[first], y[first], np.add.reduceat(m, first) if len(first) else m[:0]


def _walked(square: Square, cells: Cells, members: tuple[np.ndarray, ...], px: np.ndarray, py: np.ndarray, theta: float) -> np.ndarray:
    """Sums (z, fx, fy) of each point over the cells: far ones stand for their points, leaves give theirs, others are opened."""
    out = np.zeros((3, len(px)))
    leaf_key, lx, ly, lm = members
    begin, end = np.searchsorted(leaf_key, cells.key, "left"), np.searchsorted(leaf_key, cells.key, "right")

    def add(p: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        dx, dy = x - px[p], y - py[p]
        q = 1 / (1 + dx * dx + dy * dy)
        for row, value in zip(out, (n * q, n * q * q * dx, n * q * q * dy), strict=True):
            row += np.bincount(p, weights=value, minlength=len(px))

    step = max(1, WALK_PAIRS // 1024)
    for low in range(0, len(px), step):
        p = np.arange(low, min(low + step, len(px)))
        key = np.ones(len(p), dtype=np.int64)
        for depth in range(square.levels + 1):
            at = cells.find(key)
            p, at = p[at >= 0], at[at >= 0]
            if not len(p):
                break
            n = cells.n[at]
            mx, my = cells.x[at] / n, cells.y[at] / n
            leaf = (n <= square.bucket) | (depth == square.levels)
            far = ~leaf & _far(square.width(depth), theta, (mx - px[p]) ** 2 + (my - py[p]) ** 2)
            add(p[far], mx[far], my[far], n[far])
            lp, la = p[leaf], at[leaf]
            for part in range(0, len(lp), max(1, WALK_PAIRS // max(1, square.bucket))):
                q, a = (v[part : part + max(1, WALK_PAIRS // max(1, square.bucket))] for v in (lp, la))
                many = end[a] - begin[a]
                of, place = np.repeat(q, many), np.repeat(begin[a] - np.cumsum(many) + many, many) + np.arange(many.sum())
                others = lm[place] - ((lx[place] == px[of]) & (ly[place] == py[of]))  # a point isn't its own neighbour
                add(of, lx[place], ly[place], others)
            on = ~leaf & ~far
            key = (cells.key[at[on]][:, None] * 4 + np.arange(4)).ravel()
            p = np.repeat(p[on], 4)
    return out


_SENT = "to int, kind int, key long, id long, x double, y double, n long"
_POINT, _CELL, _MEMBER = 0, 1, 2


def barnes_hut(points: DataFrame, theta: float = 0.6, bucket: int = 100, levels: int = 24, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """(id, x, y) -> i, z, fx, fy as repulsion(), with far cells standing for their points.

    Points are dealt to stretches of their Z-order, each of which is a run of cells and a box. A cell that a border between stretches cuts is known to all: there are as
    many of these as borders times depths, and their sums are gathered first. Every other cell belongs to one stretch, which sends it to those whose points may come
    to it: few cells to far ones. A stretch then walks down for its points in what it has. So the points are shuffled once to their
    stretches and once on with what these were sent, whatever the depth; the driver holds a box a stretch and the cut cells. Points at one place are one with their
    number where others meet them, and several stretches share them if they are many.
    """
    points = materialize(points.select("id", "x", "y"))
    m = points.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not m[0]:
        return points.select(F.col("id").alias("i"), F.col("x").alias("z"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    side = max(m[2] - m[1], m[4] - m[3]) * (1 + 1e-9)
    side = side if side > 0 else 1.0
    square = Square((m[1] + m[2]) * 0.5 - side / 2, (m[3] + m[4]) * 0.5 - side / 2, side, levels, bucket)
    stretches = -(-m[0] // stretch_rows)

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        number, x, y = (batch.column(c).to_numpy() for c in ("id", "x", "y"))
        code = square.code(x, y)
        salt = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SALT_BITS)
        return number, x, y, code, (code << SALT_BITS) | salt.astype(np.int64)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(placed(batch)[4])], names=["code"])

    bounds = np.zeros(0, dtype=np.int64)
    if stretches > 1:
        cuts = points.mapInArrow(codes, "code long").agg(F.percentile_approx("code", [k / stretches for k in range(1, stretches)], 100 * stretches).alias("c")).first()[0]
        bounds = np.unique(np.array(cuts, dtype=np.int64))
    border = bounds >> SALT_BITS
    # a border cuts the cells that hold the place where it is, at all depths
    cut = [np.unique(square.key(border, depth)) for depth in range(levels + 1)]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, y, code, salted = placed(batch)
            order = np.argsort(code, kind="stable")
            cells = square.cut_sums(code[order], x[order], y[order], cut)
            of = np.searchsorted(bounds, salted, "right")
            ends = np.full((len(bounds) + 1, 4), np.inf)
            for k, v in enumerate((x, -x, y, -y)):
                np.minimum.at(ends[:, k], of, v)
            here = np.flatnonzero(np.isfinite(ends[:, 0]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((-1 - here, cells.key))), pa.array(np.concatenate((np.zeros(len(here), dtype=np.int64), cells.n))),
                *(pa.array(np.concatenate((a, b))) for a, b in ((ends[here, 0], cells.x), (ends[here, 1], cells.y), (ends[here, 2], np.zeros(len(cells.key))), (ends[here, 3], np.zeros(len(cells.key))))),
            ], names=["key", "n", "a", "b", "c", "d"])

    parts = points.mapInArrow(summary, "key long, n long, a double, b double, c double, d double").groupBy("key")
    sums = parts.agg(F.sum("n").alias("n"), *(F.when(F.col("key") < 0, F.min(c)).otherwise(F.sum(c)).alias(c) for c in "abcd")).toPandas().sort_values("key")
    boxes = np.full((len(bounds) + 1, 4), np.inf)
    box = sums[sums.key < 0]
    boxes[-1 - box.key.to_numpy()] = box[["a", "b", "c", "d"]].to_numpy() * [1, -1, 1, -1]
    known = sums[sums.key > 0]
    top = Cells(*(known[c].to_numpy() for c in ("key", "n", "a", "b"))) if len(bounds) else NO_CELLS
    filled = np.flatnonzero(np.isfinite(boxes[:, 0]))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, x, y, code, salted = placed(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, salted, "right"), pa.int32()), *(pa.array(v) for v in (number, x, y, code))], names=["stretch", "id", "x", "y", "code"])

    def send(rows: pa.Table) -> pa.Table:
        me = rows.column("stretch")[0].as_py()
        number, x, y, code = (rows.column(c).to_numpy() for c in ("id", "x", "y", "code"))
        order = np.argsort(code, kind="stable")
        number, x, y, code = number[order], x[order], y[order], code[order]
        mine = square.own(code, x, y, top)
        to, at, leaf_to, leaf = _essential(square, mine, top, boxes, filled[filled != me], theta)
        key, lx, ly, lm = square.members(np.unique(leaf), code, x, y)
        low, high = np.searchsorted(key, leaf, "left"), np.searchsorted(key, leaf, "right")
        place = np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange((high - low).sum())
        none = lambda k: np.zeros(k, dtype=np.int64)
        parts = [
            (np.full(len(code), me), np.full(len(code), _POINT), code, number, x, y, none(len(code))),
            (to, np.full(len(to), _CELL), mine.key[at], none(len(to)), mine.x[at], mine.y[at], mine.n[at]),
            (np.repeat(leaf_to, high - low), np.full(len(place), _MEMBER), key[place], none(len(place)), lx[place], ly[place], lm[place]),
        ]
        return pa.table([pa.array(np.concatenate(c), pa.int32() if k < 2 else None) for k, c in enumerate(zip(*parts, strict=True))], names=["to", "kind", "key", "id", "x", "y", "n"])

    def walk(rows: pa.Table) -> pa.Table:
        kind, key, number, x, y, n = (rows.column(c).to_numpy() for c in ("kind", "key", "id", "x", "y", "n"))
        p, c, m = (np.flatnonzero(kind == k) for k in (_POINT, _CELL, _MEMBER))
        p = p[np.argsort(key[p], kind="stable")]
        cells = square.own(key[p], x[p], y[p], top).plus(top)
        leaves = square.members(np.sort(cells.key[(cells.n <= bucket) | (cells.key >> (2 * levels) > 0)]), key[p], x[p], y[p])
        leaves = _places(*(np.concatenate(v) for v in zip(leaves, (key[m], x[m], y[m], n[m]), strict=True)))
        z, fx, fy = _walked(square, cells.plus(Cells(key[c], n[c], x[c], y[c])), leaves, x[p], y[p], theta)
        return pa.table({"i": number[p], "z": z, "fx": fx, "fy": fy})

    own = points.mapInArrow(dealt, "stretch int, id long, x double, y double, code long")
    return own.groupBy("stretch").applyInArrow(send, _SENT).groupBy("to").applyInArrow(walk, "i long, z double, fx double, fy double")
