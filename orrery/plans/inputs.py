"""The inputs of the registered queries, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered

PERPLEXITY, K = 10.0, 31


def points_hd(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """points_hd() as they are stored, half as long."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def points_2d(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), e.embedding[0].cast("double").alias("x"), e.embedding[1].cast("double").alias("y"))


def orders_3d(spark: SparkSession, d: str) -> DataFrame:
    """Orders by price, date and customer, each brought to 0 to 1."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("a"), F.unix_date(F.to_date("o_orderdate")).cast("double").alias("b"), F.col("o_custkey").cast("double").alias("c"))
    m = o.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "abc" for f in (F.min, F.max)))
    scale = lambda c: (F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-300))
    return o.crossJoin(F.broadcast(m)).select("id", F.array(*(scale(c) for c in "abc")).alias("v"))


DIMS = (50, 11, 9)


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """Line items counted by quantity, discount and tax, on the full grid."""
    cell = lambda c: F.round(c).cast("int")
    counted = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(cell(F.col("l_quantity") - 1).alias("x"), cell(F.col("l_discount") * 100).alias("y"), cell(F.col("l_tax") * 100).alias("z")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return dense(spark, *DIMS).join(counted, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("val", F.lit(0.0)).alias("val"))


def dense(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """All cells of a grid, x fastest."""
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z"))


def signal(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """All event values in the order of ids, then zeros up to a power of two, as (n, value); and their number."""
    return padded_signal(spark.read.parquet(f"{d}/events.parquet"), F.coalesce(F.floor(F.col("event_id") / 65536), F.lit(1 << 62)), ["event_id"], F.coalesce("value", F.lit(0.0)))


def padded_signal(rows: DataFrame, shard: Column, order: list[str], value: Column) -> tuple[DataFrame, int]:
    """Values of rows in an order, then zeros up to a power of two, as (n, value); and their number. shard is rows' coarse place in that order."""
    count = rows.count()
    size = 1 << max(count - 1, 0).bit_length()
    found = numbered(rows.select(*order, value.alias("value__"), shard.alias("shard__")), "shard__", order, "n").select("n", F.col("value__").alias("value"))
    return found.unionByName(rows.sparkSession.range(count, size).select(F.col("id").alias("n"), F.lit(0.0).alias("value"))), size


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value of each hour that has events, numbered in order: (n, value)."""
    h = spark.read.parquet(f"{d}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("value"))
    return numbered(h.withColumn("day", F.to_date("h")), "day", ["h"], "n").select("n", "value")


# DuckDB SQL of the same inputs, as common table expressions.
HD = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
P2 = "p2 AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
VOX = """g AS (SELECT a.x::INT AS x, b.y::INT AS y, c.z::INT AS z FROM range(50) a(x), range(11) b(y), range(9) c(z)),
cnt AS (SELECT round(l_quantity - 1)::INT AS x, round(l_discount * 100)::INT AS y, round(l_tax * 100)::INT AS z, count(*) AS n FROM lineitem GROUP BY ALL),
vox AS (SELECT g.x, g.y, g.z, coalesce(n, 0)::DOUBLE AS val FROM g LEFT JOIN cnt USING (x, y, z))"""
SIGNAL = """num AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, value FROM events), pl AS (SELECT unnest(range((SELECT pow(2, ceil(log2(count(*))))::BIGINT FROM events))) AS n),
sig AS (SELECT pl.n, coalesce(value, 0) AS value FROM pl LEFT JOIN num ON num.n = pl.n)"""
HOURLY = "hrs AS (SELECT (row_number() OVER (ORDER BY h) - 1)::BIGINT AS n, value FROM (SELECT date_trunc('hour', ts) AS h, avg(value) AS value FROM events GROUP BY 1))"
KNN = f"""{HD}, dist AS (SELECT a.id AS i, b.id AS j, pow(list_distance(a.v, b.v), 2) AS d2 FROM pts a JOIN pts b ON a.id <> b.id),
knn AS (SELECT * FROM (SELECT i, row_number() OVER (PARTITION BY i ORDER BY d2, j DESC) AS rank, j, d2 FROM dist) WHERE rank <= {K})"""
BETA = f"""{KNN}, d AS (SELECT i, list(d2 ORDER BY rank) AS d FROM knn GROUP BY i),
it(i, d, step, beta, lo, hi, off) AS (
  SELECT i, d, 0, 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, ln(list_sum(list_transform(d, lambda x: exp(-x)))) + list_sum(list_transform(d, lambda x: x * exp(-x))) / list_sum(list_transform(d, lambda x: exp(-x))) - ln({PERPLEXITY}) FROM d
  UNION ALL
  SELECT i, d, step + 1, b, l, h, ln(list_sum(list_transform(d, lambda x: exp(-x * b)))) + b * list_sum(list_transform(d, lambda x: x * exp(-x * b))) / list_sum(list_transform(d, lambda x: exp(-x * b))) - ln({PERPLEXITY})
  FROM (SELECT i, d, step, CASE WHEN off > 0 THEN CASE WHEN hi IS NULL THEN beta * 2 ELSE (beta + hi) / 2 END ELSE CASE WHEN lo IS NULL THEN beta / 2 ELSE (beta + lo) / 2 END END AS b,
               CASE WHEN off > 0 THEN beta ELSE lo END AS l, CASE WHEN off > 0 THEN hi ELSE beta END AS h FROM it WHERE abs(off) > 1e-5 AND step < 99)),
beta AS (SELECT i, arg_max(beta, step) AS beta FROM it GROUP BY i)"""
PCOND = f"""{BETA}, e AS (SELECT knn.i, rank, j, exp(-d2 * beta) AS e, beta FROM knn JOIN beta USING (i)),
pc AS (SELECT i, rank, j, e / sum(e) OVER (PARTITION BY i) AS p, beta FROM e)"""
PSYM = f"{PCOND}, ps AS (SELECT a.i, a.rank, a.j, coalesce((a.p + b.p) / 2, a.p) AS p FROM pc a LEFT JOIN pc b ON a.i = b.j AND a.j = b.i)"
PMAT = f"{PSYM}, pm AS (SELECT i, rank, j, p / (SELECT sum(p) FROM ps) AS p FROM ps)"
