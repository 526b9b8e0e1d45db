import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import intervals, quantiles
from orrery.streaming import means


def test_batches_give_what_one_pass_gives_and_late_rows_are_counted(spark, tmp_path):
    day = dt.datetime(2024, 3, 1)
    rng = np.random.default_rng(1)
    rows = [(k, day + dt.timedelta(hours=float(h)), float(v)) for k in ("a", "b", None) for h, v in zip(rng.uniform(0, 24 * 9.5, 200), rng.normal(size=200), strict=True)]
    rows += [("b", day + dt.timedelta(days=3, hours=1), None), ("a", None, 1.0)]
    rows.sort(key=lambda r: r[1] or day)
    schema = "kind string, at timestamp, amount double"
    parts = [rows[:200], rows[200:410], rows[410:]]
    late = [("a", day + dt.timedelta(hours=2), 99.0), ("b", day + dt.timedelta(hours=3), 99.0)]
    for i, part in enumerate([*parts, late]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        (tmp_path / f"{i}").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found, query = means.run_to_end(means.exponential_means(means.windowed_means(stream, "kind", "at", "amount", "1 day", "2 hours"), 0.8))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4 and means.dropped_rows(query) == 2
    last = max(r[1] for r in rows if r[1]) - dt.timedelta(hours=2)
    want = {}
    for k in ("a", "b", None):
        ema = None
        for d in range(10):
            start = day + dt.timedelta(days=d)
            mine = [v for kk, t, v in rows if kk == k and t and v is not None and start <= t < start + dt.timedelta(days=1)]
            if mine and start + dt.timedelta(days=1) <= last:
                ema = np.mean(mine) if ema is None else 0.8 * ema + 0.2 * np.mean(mine)
                want[k, start] = (np.mean(mine), ema)
    got = {(r.key, r.start): (r.value, r.ema) for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize(("width", "closed"), [(0.3, "both"), (5.0, "high")])
def test_range_join_is_that_of_all_pairs(spark, width, closed):
    rng = np.random.default_rng(2)
    places = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 120), rng.normal(size=120) * 3, strict=True)] + [(0, 1.0), (1, None)]
    spans = [(int(g), float(a), float(a + b)) for g, a, b in zip(rng.integers(0, 3, 60), rng.normal(size=60) * 3, rng.normal(size=60) + 0.5, strict=True)] + [(0, 1.0, 1.0), (0, 1.0, 2.0), (0, -1.0, 1.0), (1, None, 3.0)]
    left = spark.createDataFrame(places, "g int, x double")
    right = spark.createDataFrame(spans, "g int, low double, high double")
    found = intervals.within(left, right, "x", "low", "high", width, ["g"], closed)
    want = sorted((g, x, a, b) for g, x in places for h, a, b in spans if g == h and x is not None and a is not None and (a <= x if closed == "both" else a < x) and x <= b)
    assert sorted(map(tuple, found.select("g", "x", "low", "high").collect())) == want and want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = intervals.within(left, right, "x", "low", "high", width)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_keep_their_bound_and_merge(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 == 0, 5.0).when(F.col("id") % 101 == 0, None).otherwise(F.exp(F.randn(3))).alias("v")).cache()
    at = [0.0, 0.01, 0.5, 0.9, 1.0]
    found = quantiles.with_exact(rows, ["g"], "v", at).collect()
    assert len(found) == 15 and all(r.close for r in found)
    parts = quantiles.sketched(rows.withColumn("part", F.col("id") if "id" in rows.columns else F.floor(F.rand(1) * 10)), ["g", "part"], "v")
    whole = {(r.g, r.q): r.approx for r in quantiles.quantiles(quantiles.merged(parts, ["g"]), [0.5]).collect()}
    exact = {(r.g, r.q): r.exact for r in found}
    assert parts.count() == 30 and all(abs(whole[k] - exact[k]) < 0.05 for k in whole)
    assert all(r.close for r in quantiles.with_exact(rows, [], "v", [0.3]).collect())
    assert quantiles.with_exact(rows.limit(0), ["g"], "v", at).count() == 0
