"""Affinities of neighbours: perplexity calibration, symmetry, normalisation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 100, 1e-5


def calibrate(d2: np.ndarray, perplexity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of squared distances -> precision of each, and its affinities: bisection until the entropy is ln(perplexity)."""
    n = len(d2)
    beta, low, high = np.ones(n), np.full(n, np.nan), np.full(n, np.nan)
    p = np.zeros_like(d2)
    todo = np.arange(n)
    for _ in range(STEPS):
        e = np.exp(-d2[todo] * beta[todo, None])
        total = e.sum(axis=1)
        total[total == 0] = 1e-8
        p[todo] = e / total[:, None]
        off = np.log(total) + beta[todo] * (d2[todo] * p[todo]).sum(axis=1) - math.log(perplexity)
        far = np.abs(off) > TOLERANCE
        todo, off = todo[far], off[far]
        if not len(todo):
            break
        b, up = beta[todo], off > 0
        low[todo] = np.where(up, b, low[todo])
        high[todo] = np.where(up, high[todo], b)
        lo, hi = low[todo], high[todo]
        beta[todo] = np.where(up, np.where(np.isnan(hi), b * 2, (b + hi) / 2), np.where(np.isnan(lo), b / 2, (b + lo) / 2))
    return beta, p


def conditional(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """(i, rank, j, d2) -> i, rank, j, p, beta. A row's neighbours are an array of some tens of numbers; rows are calibrated many at once."""
    lists = neighbours.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d2"))).alias("near"))
    lists = lists.select("i", F.transform("near", lambda x: x["j"]).alias("j"), F.transform("near", lambda x: x["d2"]).alias("d2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(r) for r in batch.column("d2").to_pylist()]
            size = np.array([len(r) for r in rows])
            p: list = [None] * len(rows)
            beta = np.zeros(len(rows))
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                beta[at], found = calibrate(np.stack([rows[a] for a in at]), perplexity)
                for a, f in zip(at, found, strict=True):
                    p[a] = f
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(p, pa.list_(pa.float64())), pa.array(beta)], names=["i", "j", "p", "beta"])

    found = lists.mapInArrow(run, "i long, j array<long>, p array<double>, beta double")
    rows = found.select("i", "beta", F.posexplode(F.arrays_zip("j", "p")).alias("at", "e"))
    return rows.select("i", (F.col("at") + 1).cast("long").alias("rank"), F.col("e.j").alias("j"), F.col("e.p").alias("p"), "beta")


def symmetrized(p: DataFrame) -> DataFrame:
    """Both directions of an edge get their mean; an edge of one direction keeps its value."""
    back = p.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("back"))
    return p.join(back, ["i", "j"], "left").select("i", "rank", "j", F.coalesce((F.col("p") + F.col("back")) / 2, F.col("p")).alias("p"))


def normalized(p: DataFrame) -> DataFrame:
    """Affinities that sum to 1. The sum is one number that all rows meet."""
    total = p.agg(F.sum("p").alias("total"))
    return p.crossJoin(F.broadcast(total)).select("i", "rank", "j", (F.col("p") / F.col("total")).alias("p"))
