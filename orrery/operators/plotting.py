"""The arithmetic of a scatter plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import nice_interval


def extent(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))


def axis_ticks(points: DataFrame, axis: str, lines: int = 6) -> DataFrame:
    """Multiples of a round interval from the lowest value on, below the highest."""
    m = points.agg(F.min(axis).alias("low"), F.max(axis).alias("high"))
    m = m.withColumn("step", nice_interval(F.col("low"), F.col("high"), lines))
    first, last = F.ceil(F.col("low") / F.col("step")), F.ceil(F.col("high") / F.col("step")) - 1
    return m.where(first <= last).select("step", F.explode(F.sequence(first, last)).alias("k")).select((F.col("k") * F.col("step")).alias("tick"))


def to_plot(points: DataFrame, pad: float = 0.05, size: float = 1.5) -> DataFrame:
    """(id, x, y) scaled to a square of the given size around 0, over the range with a margin on either side."""
    e = extent(points)
    at = lambda c: ((F.col(c) - (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2) * size / ((F.col(f"high_{c}") - F.col(f"low_{c}")) * (1 + 2 * pad))).alias(c)
    return points.crossJoin(F.broadcast(e)).select("id", at("x"), at("y"))


def in_view(points: DataFrame, centre: tuple[float, float], zoom: float, pad: float = 0.05) -> DataFrame:
    """Points within half a unit over the zoom from the centre, and a margin."""
    half = 0.5 / zoom * (1 + pad)
    return points.where(F.col("x").between(centre[0] - half, centre[0] + half) & F.col("y").between(centre[1] - half, centre[1] + half))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The middle value of each group, the upper one of two. A group's values meet as (value, count) pairs."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(value)
    upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    return upto.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min(value).alias("median"))
