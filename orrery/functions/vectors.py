"""Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def deviation(v: Column) -> Column:
    """Population standard deviation, from sums of the values and of their squares; 1 where it is 0."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(v, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")), lambda acc: F.sqrt(F.greatest(acc["q"] / F.size(v) - F.pow(acc["s"] / F.size(v), 2), F.lit(0.0))))
    return F.when(sums == 0, 1.0).otherwise(sums)


def standardized(v: Column) -> Column:
    """Each value less the mean over the deviation; the array of one struct keeps both from being found anew for each element."""
    moments = F.array(F.struct(mean(v).alias("m"), deviation(v).alias("s")))
    return F.transform(moments, lambda t: F.transform(v, lambda x: (x - t["m"]) / t["s"]))[0]
