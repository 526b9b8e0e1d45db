"""Quantiles: exact ones, and those of mergeable sketches with a stated error of rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; with 400, ranks are within 0.7 % of all rows (99 times of 100).
K = 400
ERROR = 0.007


def sketched(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys, sketch, n: a KLL sketch of the values of each key, merged from the tasks' own, whatever the number of rows. Sketches of parts can be merged again."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same keys as one."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, at: list[float]) -> DataFrame:
    """keys, ..., q, approx: a row a sketch and quantile."""
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("approx")) for q in at)))
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), each.alias("e")).select("*", "e.*").drop("e")


def with_exact(rows: DataFrame, keys: list[str], value: str, at: list[float], k: int = K, error: float = ERROR) -> DataFrame:
    """keys, q, exact, close: exact quantiles (interpolated), and whether the sketch's answer has a rank within error of q.

    The rank of the answer lies between the shares of values below it and up to it, as values repeat.
    """
    exact = rows.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("p"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), F.col("p").alias("exact"))).alias("of__")
    exact = exact.select(*keys, each).select(*keys, F.col("of__.q").alias("q"), F.col("of__.exact").alias("exact"))
    found = quantiles(sketched(rows, keys, value, k), at)
    names = [F.col(c).alias(f"{c}__") for c in keys]
    same = lambda: [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in keys]
    asked = found.groupBy(*names).agg(F.collect_list(F.struct("q", "approx")).alias("asked"))  # as many as at
    met = rows.where(F.col(value).isNotNull()).join(asked, same()) if keys else rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(asked))
    ranks = met.select(*keys, value, F.explode("asked").alias("a")).groupBy(*keys, "a.q").agg(F.avg((F.col(value) < F.col("a.approx")).cast("double")).alias("below"), F.avg((F.col(value) <= F.col("a.approx")).cast("double")).alias("to"))
    ranks = ranks.select(F.col("q").alias("q__"), *names, ((F.col("below") <= F.col("q") + error) & (F.col("to") >= F.col("q") - error)).alias("close"))
    return exact.join(ranks, [*same(), F.col("q") == F.col("q__")], "left").select(*keys, "q", "exact", F.coalesce("close", F.lit(False)).alias("close"))
