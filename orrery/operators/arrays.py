"""Dense arrays as rows of index columns and a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(spark, shape: tuple[int, ...]) -> DataFrame:
    """i0, i1, ... and val 0.0 for every cell, the last index fastest."""
    size = reduce(lambda a, b: a * b, shape, 1)
    return unflatten(spark.range(size).select(F.col("id").alias("idx"), F.lit(0.0).alias("val")), shape)


def flatten(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Index columns to one row-major index."""
    idx = reduce(lambda acc, k: acc * shape[k] + F.col(f"i{k}"), range(1, len(shape)), F.col("i0").cast("long"))
    return df.select(idx.cast("long").alias("idx"), "val")


def unflatten(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    cols: list[Column] = []
    stride = 1
    for k in range(len(shape) - 1, -1, -1):
        cols.insert(0, (F.floor(F.col("idx") / stride) % shape[k]).cast("int").alias(f"i{k}"))
        stride *= shape[k]
    return df.select(*cols, "val")


def reshape(df: DataFrame, old: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """The same cells in another shape of as many."""
    if reduce(lambda a, b: a * b, old, 1) != reduce(lambda a, b: a * b, new, 1):
        raise ValueError(f"{old} and {new} don't have as many cells")
    return unflatten(flatten(df, old), new)


def lookup(df: DataFrame, shape: tuple[int, ...], *at: int) -> DataFrame:
    """One cell's value; an index beyond the shape, or too few of them, is an error."""
    if len(at) != len(shape):
        raise ValueError(f"{len(shape)} indices are needed, not {len(at)}")
    if any(not 0 <= i < n for i, n in zip(at, shape, strict=True)):
        raise IndexError(f"{at} is outside {shape}")
    return df.where(reduce(lambda c, k: c & (F.col(f"i{k}") == at[k]), range(len(at)), F.lit(True))).select("val")


def difference(a: DataFrame, b: DataFrame, on: list[str], values: list[str], kind: str = "abs") -> DataFrame:
    """Cell by cell: "abs" |a - b|, "euclid" the distance of vectors, "sum" of the parts' absolute differences (for complex values)."""
    other = b.select(*on, *(F.col(v).alias(f"{v}__") for v in values))
    each = [F.abs(F.col(v) - F.col(f"{v}__")) for v in values]
    diff = F.sqrt(reduce(lambda x, y: x + y, (e * e for e in each))) if kind == "euclid" else reduce(lambda x, y: x + y, each)
    return a.join(other, on, "full_outer").select(*on, diff.alias("diff"))


def approx_equals(a: DataFrame, b: DataFrame, on: list[str], values: list[str], eps: float = 5e-5, kind: str = "abs") -> DataFrame:
    """equal: whether both have the same cells and all differ by less than eps."""
    return difference(a, b, on, values, kind).agg(F.coalesce(F.bool_and(F.coalesce(F.col("diff") < eps, F.lit(False))), F.lit(True)).alias("equal"))


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(*(F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns))
