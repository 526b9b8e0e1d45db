"""The t-SNE optimiser: exact, Barnes-Hut and interpolated gradients, steps, convergence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cauchy
from ..functions.tables import discard, materialize, numbered
from .neighbours import BLOCK_ROWS, block_count, streamed
from .quadtree import barnes_hut, bounding_square, quadtree  # noqa: F401  part of this module's interface

LEARNING_RATE, EXAGGERATION, EXAGGERATED_STEPS = 100.0, 3.0, 2500


def momentum(step: int) -> float:
    return 0.5 if step < 250 else 0.8


def exaggeration(step: int) -> float:
    return EXAGGERATION if step < EXAGGERATED_STEPS else 1.0


def rescaled(points: DataFrame) -> DataFrame:
    """(id, x, y) with each axis brought to 0 to 1; 0 where all agree."""
    m = points.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    scale = lambda c: F.coalesce((F.col(c) - F.col(f"min_{c}")) / F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c)
    return points.crossJoin(F.broadcast(m)).select("id", scale("x"), scale("y"))


def random_start(ids: DataFrame) -> DataFrame:
    """(id) -> id, x, y in [0, 1) by a linear congruential rule of the id."""
    lcg = lambda c: (c * 1103515245 + 12345) % 2147483648
    first = lcg(F.col("id") % 2147483648)
    return ids.select("id", (first / 2147483648.0).alias("x"), (lcg(first) / 2147483648.0).alias("y"))


#: Rows of each side of a piece of the exact forces: it stays in the cache. Coordinates up to which differences may come from products.
FORCE_ROWS, NEAR_ORIGIN = (256, 2048), 100.0


def _forces(a: np.ndarray, b: np.ndarray, same: np.ndarray | None, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Points (n, 2) and (m, 2) -> sums of q, and of q^2 times the way there, for each of a; and, if both, for each of b. same: pairs that are one point."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= NEAR_ORIGIN:
        one, other = np.ones((len(a), 1)), np.ones((len(b), 1))
        q = np.concatenate((-2 * a, (a * a).sum(1)[:, None], one), axis=1) @ np.concatenate((b, other, 1 + (b * b).sum(1)[:, None]), axis=1).T
    else:
        dx, dy = b[:, 0] - a[:, 0, None], b[:, 1] - a[:, 1, None]
        q = 1 + dx * dx + dy * dy
    np.divide(1, q, out=q)
    if same is not None:
        q[same] = 0
    rows, columns = np.ones(len(a)), np.ones(len(b))
    z, z_b = q @ columns, rows @ q if both else None  # products with vectors, each of which is one pass over q
    np.multiply(q, q, out=q)
    here, there = a - (centre := b.mean(0)), b - centre
    n, n_b = q @ columns, rows @ q if both else None
    of_a = [z, *(q @ np.ascontiguousarray(there[:, c]) - here[:, c] * n for c in (0, 1))]
    of_b = [z_b, *(np.ascontiguousarray(here[:, c]) @ q - there[:, c] * n_b for c in (0, 1))] if both else None
    return np.column_stack(of_a), np.column_stack(of_b) if both else None


def repulsion(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, x, y) -> i, z, fx, fy: sums over all others of q, and of q^2 (y_j - y_i). Each pair of blocks meets once, in a task of its own, and gives the sums of both sides."""
    n = points.count()
    blocks = block_count(points, n, block_rows)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    pair = lambda a, b: (a * blocks - F.floor(a * (a - 1) / 2) + b - a).cast("int")  # noqa: E731  a number for each a <= b
    cols = [F.col(c) for c in ("id", "x", "y")]
    left = points.select(own.alias("own"), *cols).select(F.explode(F.sequence("own", F.lit(blocks - 1))).alias("other"), "own", *cols)
    right = points.select(own.alias("own"), *cols).select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("other"), "own", *cols)
    left = left.select(pair(F.col("own"), F.col("other")).alias("block"), (F.col("own") == F.col("other")).alias("itself"), *cols)
    right = right.select(pair(F.col("other"), F.col("own")).alias("block"), (F.col("own") == F.col("other")).alias("itself"), *cols)

    def places(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return t.column("id").to_numpy(), np.column_stack([t.column(c).to_numpy() for c in ("x", "y")])

    def sums(mine: pa.Table, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda i, s: pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), *map(pa.array, np.ascontiguousarray(s.T))], names=["i", "z", "fx", "fy"])
        ids, a = places(mine) if mine.num_rows else (np.zeros(0, dtype=np.int64), np.zeros((0, 2)))
        total = np.zeros((len(ids), 3))
        for batch in stream:
            ids_b, b = places(batch)
            itself = batch.column("itself")[0].as_py()
            back = np.zeros((len(ids_b), 3))
            for low in range(0, len(ids), FORCE_ROWS[0]):
                i = slice(low, low + FORCE_ROWS[0])
                for first in range(0, len(ids_b), FORCE_ROWS[1]):
                    j = slice(first, first + FORCE_ROWS[1])
                    here, there = _forces(a[i], b[j], ids[i, None] == ids_b[j] if itself else None, not itself)
                    total[i] += here
                    if there is not None:
                        back[j] += there
            if not itself:
                yield rows(ids_b, back)
        yield rows(ids, total)

    parts = streamed(left, right, blocks * (blocks + 1) // 2, sums, "i long, z double, fx double, fy double")
    return parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("z", "fx", "fy")))


def negative_exact(points: DataFrame) -> DataFrame:
    """(id, x, y) -> i, gx, gy: the exact repulsive gradient."""
    r = materialize(repulsion(points))  # read twice
    z = r.agg(F.sum("z").alias("total"))
    return r.crossJoin(F.broadcast(z)).select("i", (-4 * F.col("fx") / F.col("total")).alias("gx"), (-4 * F.col("fy") / F.col("total")).alias("gy"))


def attraction(points: DataFrame, p: DataFrame, exaggerated: float) -> DataFrame:
    """Edges (i, j, p) and points -> i, gx, gy: the attractive gradient over the neighbours."""
    edges = edge_forces(points, p, exaggerated)
    return edges.groupBy("i").agg(F.sum("fx").alias("gx"), F.sum("fy").alias("gy"))


def edge_forces(points: DataFrame, p: DataFrame, exaggerated: float) -> DataFrame:
    a = points.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = points.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    pull = 4 * exaggerated * F.col("p") * cauchy(dx * dx + dy * dy)
    return p.where("i <> j").join(a, "i").join(b, "j").select("i", "j", (pull * dx).alias("fx"), (pull * dy).alias("fy"))


def gradient(points: DataFrame, p: DataFrame, step: int, negative=negative_exact) -> DataFrame:
    """(id, x, y) and affinities -> i, gx, gy. negative: how repulsion is found (exact, quadtree or interpolated)."""
    both = negative(points).unionByName(attraction(points, p, exaggeration(step)))
    return both.groupBy("i").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))


def step(state: DataFrame, p: DataFrame, number: int, negative=negative_exact) -> DataFrame:
    """State (id, x, y, px, py) -> the state after step number (from 1), where px, py is where a point stood before."""
    g = gradient(state.select("id", "x", "y"), p, number, negative)
    move = lambda c: (F.col(c) + LEARNING_RATE * F.col(f"g{c}") + momentum(number) * (F.col(c) - F.col(f"p{c}"))).alias(c)
    return state.join(g, state.id == g.i).select("id", move("x"), move("y"), F.col("x").alias("px"), F.col("y").alias("py"))


def displacement(state: DataFrame) -> DataFrame:
    """Mean length of the last step."""
    return state.agg(F.avg(F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))).alias("displacement"))


def run(start: DataFrame, p: DataFrame, steps: int, negative=negative_exact, threshold: float = 0.0) -> tuple[DataFrame, list[float]]:
    """Steps from (id, x, y), each cut off from the last one's plan: the final state and the smoothed displacement after each.

    Stops early once that is under the threshold.
    """
    p = materialize(p)
    state = materialize(start.select("id", "x", "y", F.col("x").alias("px"), F.col("y").alias("py")))
    smooth: list[float] = []
    for number in range(1, steps + 1):
        stepped = step(state, p, number, negative)
        state = materialize(stepped)
        discard(stepped, p)  # the state before it, and what the forces were found from
        moved = displacement(state).first()[0]
        smooth.append(moved if not smooth else 0.9 * smooth[-1] + 0.1 * moved)
        if smooth[-1] < threshold:
            break
    discard(p)
    return state, smooth


#: Terms of a series that one task folds.
EMA_TERMS = 1 << 16


def ema(series: DataFrame, order: str, value: str, keep: float = 0.9, terms: int = EMA_TERMS) -> DataFrame:
    """Exponential mean of a series in an order, seeded by its first value: order, value, ema. Terms with equal order are in no order; null values are an error.

    Stretches of the series are folded by themselves, as if nothing came before; their last values, a row a stretch, are folded in turn, and what is left of them is added to
    each term of the next stretch.
    """
    placed = series.select(order, value).repartitionByRange(order)  # as many ranges as there are partitions, in order
    ranked = numbered(materialize(placed.withColumn("shard", F.spark_partition_id())), "shard", [order], "r").drop("shard").withColumn("part", F.floor(F.col("r") / terms).cast("long"))

    def fold(values: np.ndarray, weights: np.ndarray, decay: np.ndarray) -> np.ndarray:
        out, last = np.zeros(len(values)), 0.0
        for k, (v, w, d) in enumerate(zip(values.tolist(), weights.tolist(), decay.tolist(), strict=True)):
            out[k] = last = d * last + w * v
        return out

    def stretch(t: pa.Table) -> pa.Table:
        t = t.sort_by("r")
        r, v = t.column("r").to_numpy(), t.column(value).to_numpy().astype(float)
        e = fold(v, np.where(r == 0, 1.0, 1 - keep), np.full(len(v), keep))
        return pa.table({"part": t.column("part"), "r": t.column("r"), "e": e})

    def carry(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        e = fold(t.column("e").to_numpy(), np.ones(t.num_rows), keep ** t.column("n").to_numpy().astype(float))
        return pa.table({"next": pa.array(t.column("part").to_numpy() + 1, pa.int64()), "before": e})

    own = ranked.select("part", "r", value).groupBy("part").applyInArrow(stretch, "part long, r long, e double")
    ends = own.groupBy("part").agg(F.max_by("e", "r").alias("e"), F.count(F.lit(1)).alias("n"))
    before = ends.groupBy(F.lit(0).alias("all")).applyInArrow(carry, "next long, before double")
    found = ranked.join(own.select("r", "e"), "r").join(before, F.col("part") == F.col("next"), "left")
    age = (F.col("r") - F.col("part") * terms + 1).cast("double")
    return found.select(order, value, (F.col("e") + F.coalesce(F.col("before") * F.pow(F.lit(keep), age), F.lit(0.0))).alias("ema"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two gradients (i, gx, gy): mean distance, mean length of the first, and their ratio (0 if that length is 0)."""
    both = a.join(b.select("i", F.col("gx").alias("hx"), F.col("gy").alias("hy")), "i")
    m = both.agg(F.avg(F.hypot(F.col("gx") - F.col("hx"), F.col("gy") - F.col("hy"))).alias("difference"), F.avg(F.hypot("gx", "gy")).alias("magnitude"))
    return m.withColumn("ratio", F.when(F.col("magnitude") == 0, 0.0).otherwise(F.col("difference") / F.col("magnitude")))


# ---- Barnes-Hut ----------------------------------------------------------------------------------------------------


def negative_barnes_hut(points: DataFrame, theta: float = 0.6, bucket: int = 100) -> DataFrame:
    found = barnes_hut(points, theta, bucket)
    r = materialize(found)
    discard(found, points)
    z = r.agg(F.sum("z").alias("total"))
    return r.crossJoin(F.broadcast(z)).select("i", (-4 * F.col("fx") / F.col("total")).alias("gx"), (-4 * F.col("fy") / F.col("total")).alias("gy"))


def force_magnitude(forces: DataFrame) -> DataFrame:
    """Sum of the edges' force lengths over the number of points."""
    return forces.agg((F.sum(F.hypot("fx", "fy")) / F.count_distinct("i")).alias("mean_force"))

