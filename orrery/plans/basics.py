"""Queries: arrays, plots and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed, lerp, nice_interval, tidy
from ..operators import arrays, plotting, quantiles
from ..sources import formats
from .inputs import DIMS, P2, VOX, points_2d, voxels
from .registry import query
from .shared import new_path


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select(F.col("z").alias("i0"), F.col("y").alias("i1"), F.col("x").alias("i2"), "val")


SHAPE = (DIMS[2], DIMS[1], DIMS[0])


@query("""WITH m AS (SELECT max(round(l_tax * 100))::INT AS i0, max(round(l_discount * 100))::INT AS i1, max(round(l_quantity - 1))::INT AS i2 FROM lineitem)
SELECT a.k::INT AS i0, b.k::INT AS i1, c.k::INT AS i2, 0.0::DOUBLE AS val FROM m, range(m.i0 + 1) a(k), range(m.i1 + 1) b(k), range(m.i2 + 1) c(k)""")
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    """A zero array as large as the table's quantities, discounts and taxes need."""
    cell = lambda c: F.max(F.round(c).cast("int"))
    m = spark.read.parquet(f"{d}/lineitem.parquet").agg(cell(F.col("l_tax") * 100), cell(F.col("l_discount") * 100), cell(F.col("l_quantity") - 1)).first()
    return arrays.dense(spark, tuple(n + 1 for n in m))


@query(f"WITH {VOX} SELECT val FROM vox WHERE x = 20 AND y = 5 AND z = 4")
def nd_lookup(spark: SparkSession, d: str) -> DataFrame:
    return arrays.lookup(_cells(spark, d), SHAPE, 4, 5, 20)


@query(f"WITH {VOX}, f AS (SELECT x + 50 * (y + 11 * z) AS idx, val FROM vox) SELECT (idx // 99)::INT AS i0, (idx % 99)::INT AS i1, val FROM f")
def nd_reshape(spark: SparkSession, d: str) -> DataFrame:
    return arrays.reshape(_cells(spark, d), SHAPE, (50, 99))


@query(f"WITH {VOX} SELECT true AS same, max(val) < 5e-5 AS zero FROM vox")
def approx_equals(spark: SparkSession, d: str) -> DataFrame:
    """The array against itself, and against zeros."""
    a = _cells(spark, d)
    on = ["i0", "i1", "i2"]
    same = arrays.approx_equals(a, a.select("*"), on, ["val"]).withColumnRenamed("equal", "same")
    return same.crossJoin(arrays.approx_equals(a, arrays.dense(spark, SHAPE), on, ["val"]).withColumnRenamed("equal", "zero"))


@query(f"WITH {P2} SELECT id, round(sqrt(pow(x - y, 2) + pow(y - x, 2)), 9) AS diff FROM p2")
def diff_euclid(spark: SparkSession, d: str) -> DataFrame:
    """How far points are from their mirror images, as vectors."""
    p = points_2d(spark, d)
    return arrays.difference(p, arrays.swap_columns(p, "x", "y"), ["id"], ["x", "y"], "euclid").withColumn("diff", tidy(F.col("diff"), 9))


@query(f"WITH {P2} SELECT id, round(abs(x - y) + abs(y - x), 9) AS diff FROM p2")
def diff_sum(spark: SparkSession, d: str) -> DataFrame:
    """The same as complex numbers, by parts."""
    p = points_2d(spark, d)
    return arrays.difference(p, arrays.swap_columns(p, "x", "y"), ["id"], ["x", "y"], "sum").withColumn("diff", tidy(F.col("diff"), 9))


_AT = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query(f"WITH p AS (SELECT event_type, unnest({_AT}) AS q, unnest(quantile_cont(value, {_AT})) AS exact FROM events GROUP BY event_type) SELECT event_type, q::DOUBLE AS q, round(exact, 6) AS exact, true AS close FROM p")
def event_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the events' values by type, and whether a sketch's are within its bound of these."""
    return quantiles.with_exact(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], "value", _AT).withColumn("exact", F.round("exact", 6))


def _there_and_back(cells: DataFrame, kind: str) -> DataFrame:
    """An array (i0, i1, i2 and values) written as a file of the array format and read again, in several tasks."""
    spark = formats.register(cells.sparkSession)
    path = new_path(spark, "files") + ".bin"
    cells.write.format("ndarray").options(shape=",".join(map(str, SHAPE)), kind=kind).mode("overwrite").save(path)
    return spark.read.format("ndarray").options(kind=kind, splitBytes=16_384).load(path)


@query(f"WITH {VOX} SELECT x, y, z, val FROM vox")
def nd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written in the array format and read again."""
    return _there_and_back(_cells(spark, d), "double").select(F.col("i2").alias("x"), F.col("i1").alias("y"), F.col("i0").alias("z"), "val")


@query(f"WITH {VOX} SELECT z AS i0, y AS i1, x AS i2, val::INT AS val FROM vox")
def nd_roundtrip_int(spark: SparkSession, d: str) -> DataFrame:
    return _there_and_back(_cells(spark, d).withColumn("val", F.col("val").cast("int")), "int")


@query(f"WITH {VOX} SELECT z AS i0, y AS i1, x AS i2, val AS a, val / 4 - x AS b FROM vox")
def nd_roundtrip_pair(spark: SparkSession, d: str) -> DataFrame:
    return _there_and_back(_cells(spark, d).select("i0", "i1", "i2", F.col("val").alias("a"), (F.col("val") / 4 - F.col("i2")).alias("b")), "pair")


@query(f"WITH {P2} SELECT id, y AS x, x AS y FROM p2")
def swap_columns(spark: SparkSession, d: str) -> DataFrame:
    return arrays.swap_columns(points_2d(spark, d), "x", "y")


@query(f"WITH {P2}, r AS (SELECT *, round((hi - lo) / 6, 12) AS rough FROM (SELECT min(x) AS lo, max(x) AS hi FROM p2)), m AS (SELECT lo, hi, pow(10.0, floor(log10((hi - lo) / 6))) AS pw, (hi - lo) / 6 AS rough FROM r) SELECT round((CASE WHEN rough / pw < 1.5 THEN 1 WHEN rough / pw < 3 THEN 2 WHEN rough / pw < 7 THEN 5 ELSE 10 END) * pw, 9) AS step FROM m")
def nice_step(spark: SparkSession, d: str) -> DataFrame:
    m = points_2d(spark, d).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return m.select(F.round(nice_interval(F.col("low"), F.col("high"), 6), 9).alias("step"))


@query(f"WITH {P2}, m AS (SELECT min(x) AS lo, max(x) AS hi, pow(10.0, floor(log10((max(x) - min(x)) / 6))) AS pw FROM p2), s AS (SELECT lo, hi, (CASE WHEN (hi - lo) / 6 / pw < 1.5 THEN 1 WHEN (hi - lo) / 6 / pw < 3 THEN 2 WHEN (hi - lo) / 6 / pw < 7 THEN 5 ELSE 10 END) * pw AS step FROM m) SELECT round(unnest(range(ceil(lo / step)::BIGINT, ceil(hi / step)::BIGINT)) * step, 6) + 0 AS tick FROM s")
def axis_ticks(spark: SparkSession, d: str) -> DataFrame:
    return plotting.axis_ticks(points_2d(spark, d), "x").select(tidy(F.col("tick")).alias("tick"))


@query(f"WITH {P2} SELECT id, round((x - (min(x) OVER () + max(x) OVER ()) / 2) * 1.5 / ((max(x) OVER () - min(x) OVER ()) * 1.1), 6) + 0 AS x, round((y - (min(y) OVER () + max(y) OVER ()) / 2) * 1.5 / ((max(y) OVER () - min(y) OVER ()) * 1.1), 6) + 0 AS y FROM p2")
def plot_transform(spark: SparkSession, d: str) -> DataFrame:
    return plotting.to_plot(points_2d(spark, d)).select("id", tidy(F.col("x")).alias("x"), tidy(F.col("y")).alias("y"))


@query(f"WITH {P2} SELECT id FROM p2 WHERE x BETWEEN -0.13125 AND 0.13125 AND y BETWEEN -0.13125 AND 0.13125")
def viewport_filter(spark: SparkSession, d: str) -> DataFrame:
    return plotting.in_view(points_2d(spark, d), (0.0, 0.0), 4.0).select("id")


@query("SELECT event_id, printf('%.2f', value) AS text FROM events")
def format_fixed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fixed(F.col("value"), 2).alias("text"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS median FROM r WHERE k = n // 2")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return plotting.upper_median(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) + 50 * l_discount, 6) AS v, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def lerp_values(spark: SparkSession, d: str) -> DataFrame:
    """From the quantity to 50, by the discount."""
    v = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(lerp(F.col("l_quantity"), F.lit(50.0), F.col("l_discount")), 6).alias("v"))
    return v.groupBy("l_orderkey", "l_linenumber", "v").agg(F.count(F.lit(1)).alias("n"))

