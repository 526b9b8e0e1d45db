"""Transfer functions: control points, and the table of 256 colours between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import within

# The default control points (place, red, green, blue, opacity).
DEFAULT = [
    (0.0, 0.0, 0.0, 0.0, 0.0),
    (0.06, 0.0, 0.0, 0.0, 0.0),
    (0.15, 0.25, 0.75, 1.0, 0.15),
    (0.2, 0.1, 0.3, 0.5, 0.0),
    (0.3, 0.8, 0.8, 0.2, 0.0),
    (0.4, 1.0, 1.0, 0.25, 0.4),
    (0.5, 0.8, 0.8, 0.2, 0.0),
    (0.7, 0.7, 0.7, 0.7, 0.0),
    (0.8, 0.8, 0.8, 0.8, 1.0),
    (1.0, 1.0, 1.0, 1.0, 1.0),
]


def control_points(spark, rows: list[tuple] = DEFAULT) -> DataFrame:  # noqa: B006
    return spark.createDataFrame(rows, "pos double, r double, g double, b double, a double")


def _spans(points: DataFrame) -> DataFrame:
    w = Window.orderBy("pos")
    return points.select("*", *(F.lead(c).over(w).alias(f"{c}2") for c in ("pos", "r", "g", "b", "a"))).where("pos2 IS NOT NULL")


def colour_table(points: DataFrame, size: int = 256) -> DataFrame:
    """bin, r, g, b, a: linear between neighbouring control points. An entry on a control point belongs to the stretch that ends there."""
    spans = _spans(points)
    entries = points.sparkSession.range(size).select(F.col("id").cast("int").alias("bin"))
    x = F.col("x")
    placed = entries.withColumn("x", F.col("bin") / float(size))
    met = within(placed, spans, "x", "pos", "pos2", 1 / 16, closed="high")
    # the first entry is on the first point, where no stretch ends
    met = met.unionByName(placed.where("bin = 0").join(spans.withColumn("first", F.lit(0)), (F.col("bin") == F.col("first")) & (F.col("pos") == 0)).drop("first"))
    f = (x - F.col("pos")) / (F.col("pos2") - F.col("pos"))
    return met.select("bin", *((F.col(c) * (1 - f) + F.col(f"{c}2") * f).alias(c) for c in "rgba"))


def insert_point(points: DataFrame, pos: float, opacity: float) -> DataFrame:
    """The points and a new one, coloured from its neighbours by ((right - left) - pos) / (right - left)."""
    d = ((F.col("pos2") - F.col("pos")) - pos) / (F.col("pos2") - F.col("pos"))
    new = _spans(points).where((F.col("pos") <= pos) & (F.col("pos2") > pos))
    return points.unionByName(new.select(F.lit(pos).alias("pos"), *((F.col(c) * (1 - d) + F.col(f"{c}2") * d).alias(c) for c in "rgb"), F.lit(opacity).alias("a")))


def opacity_sums(table: DataFrame) -> DataFrame:
    """bin, total: running sums of the opacity, which tell whether a range of values is invisible."""
    return table.select("bin", F.sum("a").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def shown(ranges: DataFrame, table: DataFrame, most: Column, least: float = 1.0) -> DataFrame:
    """Ranges (low, high) with opacity, the table's over the entries after that of low up to that of high; active: whether it is over least; and visible: whether any entry of the range, low's too, has some.

    Two lookups in the running sums answer for a range, however many values it has.
    """
    sums = opacity_sums(table)  # as many rows as the table
    entry = lambda c: F.greatest(F.least(F.floor(F.col(c) / most * 256), F.lit(255)), F.lit(0)).cast("int")
    low = sums.join(table.select("bin", "a"), "bin").select(F.col("bin").alias("from"), F.col("total").alias("t0"), F.col("a").alias("a0"))
    high = sums.select(F.col("bin").alias("to"), F.col("total").alias("t1"))
    met = ranges.withColumns({"from": entry("low"), "to": entry("high")}).join(F.broadcast(low), "from").join(F.broadcast(high), "to")
    opacity = F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0))
    return met.select(*ranges.columns, opacity.alias("opacity"), (opacity > least).alias("active"), ((F.col("a0") > 0) | (opacity > 1e-12)).alias("visible"))
