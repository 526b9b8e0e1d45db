"""Joins on ranges: intervals are cut into buckets, which places meet by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(places: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, on: list[str] | None = None, closed: str = "both") -> DataFrame:
    """Rows of places and of intervals (columns of both, on once) where at is between low and high.

    A place is in the bucket of its number over width, an interval in all that it reaches into: an equi-join finds candidates and the bounds decide, so that no plan
    compares all rows with all. width should be about as long as most intervals; a longer one is a row for each bucket that it passes. closed: "both", or "high" for
    low < at <= high. Null bounds or places match nothing. An interval that ends before it begins holds nothing.
    """
    on = on or []
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = intervals.where(F.col(low) <= F.col(high)).withColumn("bucket__", F.explode(F.sequence(bucket(low), bucket(high))))
    met = places.withColumn("bucket__", bucket(at)).join(cut, [*on, "bucket__"])
    above: Column = F.col(at) > F.col(low) if closed == "high" else F.col(at) >= F.col(low)
    return met.where(above & (F.col(at) <= F.col(high))).drop("bucket__")
