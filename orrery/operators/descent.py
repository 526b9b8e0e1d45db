"""Approximate nearest neighbours by descent on a graph: neighbours of neighbours are likely to be neighbours."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import discard, materialize, numbered
from .neighbours import _matrix

#: Rows of a cell of the start, which are compared with each other, and how many starts in different directions there are.
CELL_ROWS, STARTS = 48, 2
#: Rows whose neighbourhoods a task joins at a time.
GROUP_ROWS = 1024


def _projected(points: DataFrame, seed: int) -> DataFrame:
    """points with a coordinate along two directions drawn from a seed (p, q); the direction follows the hash of a component's place."""
    draw = lambda axis: (lambda x, k: x * (F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), k), F.lit(20001)) - 10000).cast("double"))
    total = lambda axis: F.aggregate(F.transform("v", draw(axis)), F.lit(0.0), lambda s, x: s + x)
    return points.select("id", "v", total(0).alias("p"), total(1).alias("q"))


def _cells(points: DataFrame, n: int, seed: int, cell_rows: int) -> DataFrame:
    """(id, v) -> id, v, cell: about cell_rows rows a cell, near each other along two drawn directions: slabs of the first, cut along the second."""
    slabs = max(1, round((n / cell_rows) ** 0.5))
    first = materialize(_projected(points, seed).repartitionByRange("p").withColumn("range", F.spark_partition_id()))
    ranked = numbered(first, "range", ["p", "id"], "r").withColumn("slab", F.floor(F.col("r") * slabs / n).cast("int"))
    # rows of a slab stand in one window: n / slabs, the root of n times that of cell_rows
    within = Window.partitionBy("slab").orderBy("q", "id")
    cut = F.floor((F.row_number().over(within) - 1) / cell_rows).cast("long")
    found = materialize(ranked.select("id", "v", (F.col("slab") * (1 << 32) + cut).alias("cell")))
    discard(first)
    return found


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy("d2", F.desc("j"))
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _joined(members: pa.Table, vectors: pa.Table) -> pa.Table:
    """Neighbourhoods (of, a, new) and their members' vectors (a, v, reach) -> pairs i, j, d2 nearer than i's reach, at most once each; and a row without i that counts the pairs compared."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    compared = 0
    if members.num_rows:
        number = vectors.column("a").to_numpy()
        order = np.argsort(number)
        number, v, reach = number[order], _matrix(vectors)[order], vectors.column("reach").to_numpy()[order]
        of, at, new = members.column("of").to_numpy(), np.searchsorted(number, members.column("a").to_numpy()), members.column("new").to_numpy(zero_copy_only=False)
        order = np.lexsort((at, of))
        of, at, new = of[order], at[order], new[order]
        edge = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        pairs = []
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            mine, fresh = at[low:high], new[low:high]
            a, b = np.nonzero(np.triu(fresh[:, None] | fresh[None, :], 1))
            pairs.append(mine[a] * len(number) + mine[b])
        key = np.unique(np.concatenate(pairs))  # a pair that meets in several neighbourhoods is compared once
        compared = len(key)
        for low in range(0, len(key), 1 << 15):
            a, b = np.divmod(key[low : low + (1 << 15)], len(number))
            d2 = ((v[a] - v[b]) ** 2).sum(axis=1)
            for x, y in ((a, b), (b, a)):
                on = d2 < reach[x]
                found.append((number[x[on]], number[y[on]], d2[on]))
    i, j, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"i": pa.array([*i, None] if compared else i, pa.int64()), "j": pa.array(np.append(j, compared) if compared else j, pa.int64()), "d2": pa.array(np.append(d2, 0.0) if compared else d2, pa.float64())})


def _first(cells: pa.Table) -> pa.Table:
    """Rows (cell, id, v) of whole cells -> all pairs of a cell, as _joined()."""
    n = cells.num_rows
    members = pa.table({"of": cells.column("cell"), "a": cells.column("id"), "new": pa.array(np.ones(n, dtype=bool))})
    return _joined(members, pa.table({"a": cells.column("id"), "v": cells.column("v"), "reach": pa.array(np.full(n, np.inf))}))


def knn_descent(points: DataFrame, k: int, cell_rows: int = CELL_ROWS, starts: int = STARTS, rounds: int = 12, tolerance: float = 0.001, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, list[dict[str, float]]]:
    """(id, v array<double>) -> i, rank, j, d2 as knn(), most of the true neighbours, and what each round did: pairs compared, and links that changed.

    The start is what cells find among themselves: rows that lie together along drawn directions. Then, in each round, a row's neighbours and those who have it as a neighbour (k of
    these at most, so that a row that all are near to costs no more than others) are compared with each other, pairs of old ones left out, and whoever gets nearer neighbours keeps
    them. A round is a few shuffles of n k links; neighbourhoods are joined in groups of rows of one cell region, to which each vector goes once. It ends after so many rounds, or when fewer than
    tolerance n k links change. How many pairs that takes depends on the number of directions in which the data vary: measure it against knn().
    Ids are distinct; there may be fewer than k other rows.
    """
    points = materialize(points.select("id", "v"))
    n = points.count()
    log: list[dict[str, float]] = []
    edges, tables = [], []
    for seed in range(starts):
        cells = _cells(points, max(n, 1), seed, cell_rows)
        few = F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-n // group_rows))))
        edges.append(cells.select(few.alias("group"), "cell", "id", "v").groupBy("group").applyInArrow(_first, "i long, j long, d2 double"))
        tables.append(cells)
    every = materialize(reduce(DataFrame.unionByName, edges))
    log.append({"pairs": every.where("i IS NULL").agg(F.coalesce(F.sum("j"), F.lit(0))).first()[0], "changed": 0})
    state = materialize(_nearest(every.where("i IS NOT NULL").dropDuplicates(["i", "j"]), k).select("i", "j", "d2", F.lit(True).alias("new")))
    discard(every)
    # rows of one region are joined in one task: cells of a slab that follow each other
    region = F.struct(F.floor(F.col("cell") / (1 << 32)).alias("slab"), F.floor((F.col("cell") % (1 << 32)) * cell_rows / group_rows).alias("part"))
    at = materialize(tables[0].select("id", "v", region.alias("home")))
    for table in tables:
        discard(table)
    for _ in range(rounds):
        out = state.select(F.col("i").alias("of"), F.col("j").alias("a"), "new")
        few = Window.partitionBy("of").orderBy(F.desc("new"), "d2", "a")
        back = state.select(F.col("j").alias("of"), F.col("i").alias("a"), "new", "d2").withColumn("place", F.row_number().over(few)).where(F.col("place") <= k).select("of", "a", "new")
        members = materialize(out.unionByName(back).groupBy("of", "a").agg(F.max("new").alias("new")).join(at.select(F.col("id").alias("of"), "home"), "of"))
        reach = state.groupBy("i").agg(F.when(F.count(F.lit(1)) == k, F.max("d2")).otherwise(float("inf")).alias("reach"))
        needed = members.select(F.col("home").alias("home"), F.col("a").alias("a")).distinct()  # fresh columns, as both sides come of one table
        vectors = needed.join(at.select(F.col("id").alias("a"), "v"), "a").join(reach.select(F.col("i").alias("a"), "reach"), "a", "left").select("home", "a", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        met = materialize(members.groupBy("home").cogroup(vectors.groupBy("home")).applyInArrow(_joined, "i long, j long, d2 double"))
        pairs = met.where("i IS NULL").agg(F.coalesce(F.sum("j"), F.lit(0))).first()[0]
        both = state.select("i", "j", "d2", F.lit(False).alias("new")).unionByName(met.where("i IS NOT NULL").select("i", "j", "d2", F.lit(True).alias("new")))
        merged = both.groupBy("i", "j").agg(F.min("d2").alias("d2"), F.min("new").alias("new"))
        after = materialize(_nearest(merged, k).select("i", "j", "d2", "new"))
        changed = after.where("new").count()
        for table in (state, members, met):
            discard(table)
        state = after
        log.append({"pairs": pairs, "changed": changed})
        if changed <= tolerance * n * k:
            break
    return _nearest(state.select("i", "j", "d2"), k).select("i", F.col("rank").cast("long").alias("rank"), "j", "d2"), log
