"""Fourier transforms of long tables: (n, re, im) and (y, x, re, im)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions and frequencies a block of the direct transform.
BLOCK = 4096


def complex_signal(df: DataFrame, index: str = "n", value: str = "value") -> DataFrame:
    return df.select(F.col(index).alias("n"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))


def _power_of_two(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"the length must be a power of two, not {n}")
    return n.bit_length() - 1


def _lines_of(batches: Iterator[pa.RecordBatch], group: str, place: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of length rows each, from rows that stand in the order of (group, place): group numbers, and a line of complex values a group, many at once."""
    left: list[np.ndarray] = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=complex)]
    for batch in batches:
        z = batch.column("re").to_numpy(zero_copy_only=False) + 1j * batch.column("im").to_numpy(zero_copy_only=False)
        new = (batch.column(group).to_numpy(zero_copy_only=False), batch.column(place).to_numpy(zero_copy_only=False), z)
        left = [np.concatenate(x) for x in zip(left, new, strict=True)]
        whole = len(left[0]) // length * length
        if whole:
            of, at, values = (x[:whole].reshape(-1, length) for x in left)
            if (at != np.arange(length)).any() or (of != of[:, :1]).any():
                raise ValueError("the signal has gaps or repeated places")
            yield of[:, 0], values
            left = [x[whole:] for x in left]
    if len(left[0]):
        raise ValueError("the signal has gaps or repeated places")


def fft_lines(lines: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """(line, n, re, im), lines of one length n, a power of two -> (line, k, re, im), each line's transform; the inverse isn't normalised.

    With n = A B and places B a + b: transforms of length A for each b, twiddle factors, then transforms of length B for each of the first ones'
    frequencies. So two shuffles, and pieces as long as the root of n, many of which, of whatever lines, a task transforms at once: no line has to fit anywhere.
    """
    bits = _power_of_two(n)
    a_len = 1 << (bits - bits // 2)
    b_len = n // a_len
    sign = 1 if inverse else -1

    def transform(z: np.ndarray) -> np.ndarray:
        return np.fft.ifft(z, axis=1) * z.shape[1] if inverse else np.fft.fft(z, axis=1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.arange(a_len)
        for piece, z in _lines_of(batches, "piece", "a", a_len):
            line, b = np.divmod(piece, b_len)
            z = (transform(z) * np.exp(sign * 2j * np.pi * (np.outer(b, f) % n) / n)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.add.outer(line * a_len, f).ravel()), pa.array(np.repeat(b, a_len)), pa.array(z.real), pa.array(z.imag)], names=["piece", "b", "re", "im"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, z in _lines_of(batches, "piece", "b", b_len):
            line, f = np.divmod(piece, a_len)
            z = transform(z).ravel()
            k = np.add.outer(f, a_len * np.arange(b_len)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(line, b_len)), pa.array(k), pa.array(z.real), pa.array(z.imag)], names=["line", "k", "re", "im"])

    place = F.col("n")
    split = lines.select((F.col("line") * b_len + place % b_len).cast("long").alias("piece"), F.floor(place / b_len).cast("long").alias("a"), "re", "im")
    half = split.repartition("piece").sortWithinPartitions("piece", "a").mapInArrow(first, "piece long, b long, re double, im double")
    return half.repartition("piece").sortWithinPartitions("piece", "b").mapInArrow(second, "line long, k long, re double, im double")


def fft(signal: DataFrame, n: int | None = None, inverse: bool = False) -> DataFrame:
    """(n, re, im) -> (k, re, im). The length is a power of two, places run from 0 without gaps; the inverse isn't normalised."""
    n = signal.count() if n is None else n
    return fft_lines(signal.select(F.lit(0).cast("long").alias("line"), "n", "re", "im"), n, inverse).drop("line")


def _chirp(place: str, n: int, sign: int) -> tuple[Column, Column]:
    """cos and sin of sign pi place^2 / n; the square is reduced before it is divided, so that long signals lose no digits (places below 3 x 10^9)."""
    angle = ((F.col(place) * F.col(place)) % (2 * n)).cast("double") * (sign * math.pi / n)
    return F.cos(angle), F.sin(angle)


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def fft_any(signal: DataFrame, n: int | None = None, inverse: bool = False) -> DataFrame:
    """(n, re, im) of any length -> (k, re, im) in N log N, by chirps; the inverse is normalised, as dft()'s.

    As k p = (k^2 + p^2 - (k - p)^2) / 2, the transform is a convolution with a chirp between two multiplications with its conjugate: three transforms of a power of two of at least 2 N - 1.
    """
    n = signal.count() if n is None else n
    spark = signal.sparkSession
    if not n:
        return signal.select(F.col("n").alias("k"), "re", "im")
    m = 1 << (2 * n - 2).bit_length()
    sign = 1 if inverse else -1
    value = (F.col("re"), F.col("im"))
    named = lambda pair: (pair[0].alias("re"), pair[1].alias("im"))
    zeros = (F.lit(0.0), F.lit(0.0))
    turned = signal.select("n", *named(_times(value, _chirp("n", n, sign)))).unionByName(spark.range(n, m).select(F.col("id").alias("n"), *named(zeros)))
    back = F.when(F.col("id") < n, F.col("id")).when(F.col("id") > m - n, m - F.col("id"))
    chirp = spark.range(m).select(F.col("id").alias("n"), back.alias("p")).select("n", *(F.coalesce(c, F.lit(0.0)).alias(x) for c, x in zip(_chirp("p", n, -sign), ("re", "im"), strict=True)))
    left = fft(turned, m)
    right = fft(chirp, m).select(F.col("k").alias("kb"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    product = left.join(right, F.col("k") == F.col("kb")).select(F.col("k").alias("n"), *named(_times(value, (F.col("rb"), F.col("ib")))))
    found = fft(product, m, inverse=True).where(F.col("k") < n)
    scale = 1.0 / m / (n if inverse else 1)
    re, im = _times(value, _chirp("k", n, sign))
    return found.select("k", (re * scale).alias("re"), (im * scale).alias("im"))


def dft(signal: DataFrame, n: int | None = None, inverse: bool = False) -> DataFrame:
    """(n, re, im) of any length -> (k, re, im) straight from the definition; the inverse is normalised. fft_any() gives the same in N log N.

    Blocks of positions against blocks of frequencies, summed by Spark: the work of N^2, but no row a pair.
    """
    n = signal.count() if n is None else n
    sign = 1 if inverse else -1
    blocks = max(1, math.ceil(n / BLOCK))

    def part(t: pa.Table) -> pa.Table:
        at = t.column("n").to_numpy()
        low = int(t.column("to")[0].as_py()) * BLOCK
        k = np.arange(low, min(n, low + BLOCK))
        z = np.exp(sign * 2j * np.pi * (np.outer(k, at) % n) / n) @ (t.column("re").to_numpy() + 1j * t.column("im").to_numpy())
        return pa.table({"k": pa.array(k, pa.int64()), "re": z.real, "im": z.imag})

    every = signal.select("n", "re", "im", F.floor(F.col("n") / BLOCK).alias("from"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"))
    scale = 1.0 / n if inverse and n else 1.0
    return every.groupBy("from", "to").applyInArrow(part, "k long, re double, im double").groupBy("k").agg(*((F.sum(c) * scale).alias(c) for c in ("re", "im")))


def _direct(grid: DataFrame, along: str, across: str, inverse: bool) -> DataFrame:
    def line(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column(along).to_numpy())
        z = (t.column("re").to_numpy() + 1j * t.column("im").to_numpy())[order]
        n = len(z)
        k = np.arange(n)
        z = np.exp((2j if inverse else -2j) * np.pi * (np.outer(k, k) % n) / n) @ z / (n if inverse else 1)
        fixed = np.full(n, t.column(across)[0].as_py())
        return pa.table({along: pa.array(np.arange(n), pa.int32()), across: pa.array(fixed, pa.int32()), "re": z.real, "im": z.imag}).select(["y", "x", "re", "im"])

    return grid.groupBy(across).applyInArrow(line, "y int, x int, re double, im double")


def fft_grids(grids: DataFrame, height: int, width: int, inverse: bool = False) -> DataFrame:
    """(grid, y, x, re, im), grids of one size, sides powers of two -> the same, each grid's transform; the inverse is normalised.

    All rows of all grids are lines of one transform, then all columns are, which are cut into pieces in turn: four shuffles, and no line has to fit in a task.
    """
    rows = grids.select((F.col("grid") * height + F.col("y")).cast("long").alias("line"), F.col("x").cast("long").alias("n"), "re", "im")
    half = fft_lines(rows, width, inverse)
    columns = half.select((F.floor(F.col("line") / height) * width + F.col("k")).cast("long").alias("line"), (F.col("line") % height).alias("n"), "re", "im")
    found = fft_lines(columns, height, inverse)
    scale = 1.0 / (height * width) if inverse else 1.0
    return found.select(F.floor(F.col("line") / width).cast("int").alias("grid"), F.col("k").cast("int").alias("y"), (F.col("line") % width).cast("int").alias("x"), *((F.col(c) * scale).alias(c) for c in ("re", "im")))


def fft_2d(grid: DataFrame, inverse: bool = False) -> DataFrame:
    """(y, x, re, im) -> the same: rows, then columns. Sides are powers of two; the inverse is normalised."""
    size = grid.agg(F.max("y"), F.max("x")).first()
    if size[0] is None:
        return grid
    return fft_grids(grid.withColumn("grid", F.lit(0)), size[0] + 1, size[1] + 1, inverse).drop("grid")


def dft_2d(grid: DataFrame, inverse: bool = False) -> DataFrame:
    """As fft_2d by the definition, for sides of any length."""
    return _direct(_direct(grid, "x", "y", inverse), "y", "x", inverse)
