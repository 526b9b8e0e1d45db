import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import bricked, rays, transfer, volumes


def volume(spark, dims, seed, hollow=0.7):
    """Voxels of which most of the blocks are empty."""
    rng = np.random.default_rng(seed)
    v = rng.random(dims) * 10
    v[rng.random(dims) < hollow] = 0
    v[: dims[0] // 2] *= rng.random() < 0.5
    rows = [(int(x), int(y), int(z), float(v[x, y, z])) for x, y, z in np.ndindex(*dims)]
    return spark.createDataFrame(rows, "x int, y int, z int, val double").cache()


@pytest.mark.parametrize(("dims", "size", "negative"), [((13, 9, 11), 4, False), ((8, 8, 8), 3, True), ((6, 5, 4), 16, False)])
def test_pictures_are_those_of_all_samples(spark, dims, size, negative):
    v = volume(spark, dims, sum(dims))
    if negative:
        v = v.withColumn("val", F.col("val") - 4).cache()
    camera = rays.Camera((dims[0] / 2 + 0.2, dims[1] / 2 - 0.1, -6.0), 11, 9)
    clipped = rays.clip(rays.rays(spark, camera), (0.0, 0.0, 0.0), tuple(float(n - 1) for n in dims)).cache()
    most = v.agg(F.max("val")).first()[0]
    every = rays.samples(clipped, v, dims, 0.4).cache()
    near = lambda a, b: len(a) == len(b) and all(x[:2] == y[:2] and np.allclose(x[2:], y[2:], atol=1e-12) for x, y in zip(sorted(a), sorted(b), strict=True))
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert near(rows(bricked.mip(clipped, v, dims, 0.4, size, F.lit(most))), rows(rays.mip(every, F.lit(most))))
    if not negative:
        table = transfer.colour_table(transfer.control_points(spark))
        assert near(rows(bricked.composite(clipped, v, dims, 0.4, size, table, most)), rows(rays.composite(every, table, F.lit(most))))


def test_each_sample_is_in_one_run_and_bounds_hold(spark):
    dims, size, step = (13, 9, 11), 4, 0.4
    v = volume(spark, dims, 1, 0.0)
    clipped = rays.clip(rays.rays(spark, rays.Camera((6.0, 4.0, -6.0), 8, 8)), (0.0, 0.0, 0.0), tuple(float(n - 1) for n in dims))
    every = rays.samples(clipped, v, dims, step)
    found = bricked.runs(clipped, step, size)
    assert found.count() < every.count() / 3
    each = found.select("px", "py", "bx", "by", "bz", F.explode(F.sequence("i0", "i1")).alias("i"))
    met = every.join(each, ["px", "py", "i"]).join(bricked.zone_map(v, size, dims), ["bx", "by", "bz"], "left")
    assert met.count() == every.count() == each.count()
    assert met.where("val < coalesce(low, 0) - 1e-9 OR val > coalesce(high, 0) + 1e-9").count() == 0


def test_a_brick_that_many_rays_pass_is_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(bricked, "RUNS_A_TASK", 10)
    dims = (6, 5, 4)
    v = volume(spark, dims, 2, 0.2)
    clipped = rays.clip(rays.rays(spark, rays.Camera((2.5, 2.0, -4.0), 10, 10)), (0.0, 0.0, 0.0), tuple(float(n - 1) for n in dims)).cache()
    a = sorted(map(tuple, bricked.mip(clipped, v, dims, 0.5, 8, F.lit(1.0)).collect()))
    b = sorted(map(tuple, rays.mip(rays.samples(clipped, v, dims, 0.5), F.lit(1.0)).collect()))
    assert len(a) == len(b) and np.allclose(a, b, atol=1e-12)


def test_ranges_by_two_lookups(spark):
    table = transfer.colour_table(transfer.control_points(spark)).cache()
    alpha = [r.a for r in table.orderBy("bin").collect()]
    rng = np.random.default_rng(0)
    ranges = [tuple(sorted(map(float, x))) for x in rng.random((200, 2)) * 10] + [(0.0, 0.0), (10.0, 10.0), (-1.0, 0.1), (0.0, 10.0)]
    for r in transfer.shown(spark.createDataFrame(ranges, "low double, high double"), table, F.lit(10.0)).collect():
        low, high = (max(0, min(255, int(np.floor(v / 10 * 256)))) for v in (r.low, r.high))
        assert abs(r.opacity - sum(alpha[low + 1 : high + 1])) < 1e-9 and r.active == (sum(alpha[low + 1 : high + 1]) > 1) and r.visible == (max(alpha[low : high + 1]) > 0)
