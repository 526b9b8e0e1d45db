"""Queries: Fourier transforms of event values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import bit_reverse, tidy
from ..operators import spectral
from .inputs import HOURLY, SIGNAL, hourly, padded_signal, signal
from .registry import query
from .shared import numbered

_OUT = lambda k, d: f"SELECT {k} AS k, round(re, {d}) + 0 AS re, round(im, {d}) + 0 AS im"


def _dft_sql(table: str, value: str = "value", sign: str = "-", norm: str = "1", digits: int = 4) -> str:
    angle = f"2 * pi() * ((k.n * s.n) % c.n) / c.n"
    return f"""c AS (SELECT count(*) AS n FROM {table}), f AS (SELECT k.n AS k, sum(s.{value} * cos({angle})) / {norm} AS re, {sign}sum(s.{value} * sin({angle})) / {norm} AS im FROM {table} k, {table} s, c GROUP BY k.n, c.n)
{_OUT('k', digits)} FROM f"""


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select("k", tidy(F.col("re"), digits).alias("re"), tidy(F.col("im"), digits).alias("im"))


@query(f"WITH {HOURLY}, {_dft_sql('hrs')}")
def dft_1d(spark: SparkSession, d: str) -> DataFrame:
    """Of hourly means, whatever their number."""
    return _rounded(spectral.dft(spectral.complex_signal(hourly(spark, d))))


@query(f"WITH {HOURLY} SELECT n AS k, round(value, 6) AS value FROM hrs")
def idft_1d(spark: SparkSession, d: str) -> DataFrame:
    """There and back again."""
    there = spectral.dft(spectral.complex_signal(hourly(spark, d)))
    return spectral.dft(there.withColumnRenamed("k", "n"), inverse=True).select("k", F.round("re", 6).alias("value"))


EVENTS = "ev AS (SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS n, coalesce(value, 0) AS value FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("shard", F.coalesce(F.floor(F.col("event_id") / 65536), F.lit(1 << 62)))
    return spectral.complex_signal(numbered(rows.select("event_id", "value", "shard"), "shard", ["event_id"], "n").select("n", F.coalesce("value", F.lit(0.0)).alias("value")))


@query(f"WITH {EVENTS}, {_dft_sql('ev', digits=2)}")
def dft_events(spark: SparkSession, d: str) -> DataFrame:
    """Of every event's value, as many as there are, in N log N."""
    return _rounded(spectral.fft_any(_events(spark, d)), 2)


@query(f"WITH {EVENTS} SELECT n AS k, round(value, 4) AS value FROM ev")
def idft_events(spark: SparkSession, d: str) -> DataFrame:
    there = spectral.fft_any(_events(spark, d)).withColumnRenamed("k", "n")
    return spectral.fft_any(there, inverse=True).select("k", F.round("re", 4).alias("value"))


@query(f"WITH {HOURLY}, {_dft_sql('hrs')}")
def dft_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The same as dft_1d by chirps."""
    return _rounded(spectral.fft_any(spectral.complex_signal(hourly(spark, d))))


# Each query of the fast transform has two names; both transform every event.
_FFT = f"WITH {SIGNAL}, {_dft_sql('sig', digits=3)}"


@query(_FFT, name="fft_1d_whole")
@query(_FFT)
def fft_1d(spark: SparkSession, d: str) -> DataFrame:
    s, n = signal(spark, d)
    return _rounded(spectral.fft(spectral.complex_signal(s), n), 3)


_COMPLEX = f"""WITH {SIGNAL}, c AS (SELECT count(*) AS n FROM sig), f AS (SELECT k.n AS k, sum(s.value * cos(2 * pi() * ((k.n * s.n) % c.n) / c.n) + (s.value / 2) * sin(2 * pi() * ((k.n * s.n) % c.n) / c.n)) AS re,
sum((s.value / 2) * cos(2 * pi() * ((k.n * s.n) % c.n) / c.n) - s.value * sin(2 * pi() * ((k.n * s.n) % c.n) / c.n)) AS im FROM sig k, sig s, c GROUP BY k.n, c.n)
{_OUT('k', 3)} FROM f"""


@query(_COMPLEX, name="fft_1d_complex_whole")
@query(_COMPLEX)
def fft_1d_complex(spark: SparkSession, d: str) -> DataFrame:
    s, n = signal(spark, d)
    return _rounded(spectral.fft(spectral.complex_signal(s).withColumn("im", F.col("re") / 2), n), 3)


_INVERSE = f"WITH {SIGNAL} SELECT n AS k, round(value * (SELECT count(*) FROM sig), 3) AS value FROM sig"


@query(_INVERSE, name="ifft_1d_whole")
@query(_INVERSE)
def ifft_1d(spark: SparkSession, d: str) -> DataFrame:
    """The inverse isn't normalised: N times the signal."""
    s, n = signal(spark, d)
    there = spectral.fft(spectral.complex_signal(s), n)
    return spectral.fft(there.withColumnRenamed("k", "n"), n, inverse=True).select("k", F.round("re", 3).alias("value"))


_REVERSED = f"WITH {SIGNAL}, b AS (SELECT log2(count(*))::INT AS b FROM sig) SELECT n, list_sum(list_transform(range(b), lambda i: ((n >> i::INT) & 1) << (b - 1 - i)::INT))::BIGINT AS reversed FROM sig, b"


@query(_REVERSED, name="bit_reversal_whole")
@query(_REVERSED)
def bit_reversal(spark: SparkSession, d: str) -> DataFrame:
    s, n = signal(spark, d)
    return s.select("n", bit_reverse(F.col("n"), n.bit_length() - 1).alias("reversed"))


_PRICES = """num AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS n, l_extendedprice::DOUBLE AS value FROM lineitem), size AS (SELECT pow(2, ceil(log2(count(*))))::BIGINT AS n FROM lineitem)"""


@query(f"WITH {_PRICES} SELECT k, round(coalesce(value, 0) * size.n, 0) + 0 AS value FROM size, (SELECT unnest(range((SELECT n FROM size))) AS k) LEFT JOIN num ON num.n = k")
def ifft_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Prices of all line items there and back again: the longest signal of the tables."""
    s, n = padded_signal(spark.read.parquet(f"{d}/lineitem.parquet"), F.floor(F.col("l_orderkey") / 16384), ["l_orderkey", "l_linenumber", "l_extendedprice"], F.col("l_extendedprice").cast("double"))
    there = spectral.fft(spectral.complex_signal(s), n)
    return spectral.fft(there.withColumnRenamed("k", "n"), n, inverse=True).select("k", tidy(F.col("re"), 0).alias("value"))


GRID = "gr AS (SELECT b.y::INT AS y, a.x::INT AS x, coalesce(v, 0) AS v FROM range(32) a(x) CROSS JOIN range(32) b(y) LEFT JOIN (SELECT (user_id % 32)::INT AS x, (event_id % 32)::INT AS y, round(sum(value), 6) AS v FROM events GROUP BY ALL) s ON s.x = a.x AND s.y = b.y)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Event values summed by user and event number modulo 32."""
    sums = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 32).cast("int").alias("x"), (F.col("event_id") % 32).cast("int").alias("y")).agg(F.round(F.sum("value"), 6).alias("v"))
    cells = spark.range(1024).select(F.floor(F.col("id") / 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"))
    return cells.join(sums, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


_DFT2 = f"""WITH {GRID}, h AS (SELECT y, k.k AS kx, sum(v * cos(2 * pi() * ((x * k.k) % 32) / 32)) AS re, -sum(v * sin(2 * pi() * ((x * k.k) % 32) / 32)) AS im FROM gr, range(32) k(k) GROUP BY ALL),
f AS (SELECT k.k AS ky, kx, sum(re * cos(2 * pi() * ((y * k.k) % 32) / 32) + im * sin(2 * pi() * ((y * k.k) % 32) / 32)) AS re, sum(im * cos(2 * pi() * ((y * k.k) % 32) / 32) - re * sin(2 * pi() * ((y * k.k) % 32) / 32)) AS im FROM h, range(32) k(k) GROUP BY ALL)
SELECT ky::INT AS y, kx::INT AS x, round(re, 3) + 0 AS re, round(im, 3) + 0 AS im FROM f"""


def _rounded2(df: DataFrame) -> DataFrame:
    return df.select("y", "x", tidy(F.col("re"), 3).alias("re"), tidy(F.col("im"), 3).alias("im"))


@query(_DFT2)
def fft_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded2(spectral.fft_2d(_grid(spark, d)))


@query(_DFT2)
def dft_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded2(spectral.dft_2d(_grid(spark, d)))


@query(f"WITH {GRID} SELECT y, x, round(v, 5) AS value FROM gr")
def ifft_2d(spark: SparkSession, d: str) -> DataFrame:
    return spectral.fft_2d(spectral.fft_2d(_grid(spark, d)), inverse=True).select("y", "x", F.round("re", 5).alias("value"))


@query(f"WITH {GRID} SELECT y, x, round(v, 5) AS value FROM gr")
def idft_2d(spark: SparkSession, d: str) -> DataFrame:
    return spectral.dft_2d(spectral.dft_2d(_grid(spark, d)), inverse=True).select("y", "x", F.round("re", 5).alias("value"))
