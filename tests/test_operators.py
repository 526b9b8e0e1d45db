import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import numbers, vectors
from orrery.operators import affinity, arrays, embedding, interpolation, matrices, neighbours, plotting, rays, spectral, transfer, volumes


def points(spark, n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")


# ---- neighbours and affinities ----


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("ties", ["high", "low"])
def test_knn_with_ties_and_duplicates(spark, block, ties):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, size=(40, 3)).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for skip in (False, True):
        found = neighbours.knn(df, 5, ties, skip, block).collect()
        got = {(r.i, r["rank"]): r.j for r in found}
        for i in range(40):
            d2 = ((x - x[i]) ** 2).sum(1)
            rest = sorted((j for j in range(40) if j != i and not (skip and d2[j] == 0)), key=lambda j: (d2[j], -j if ties == "high" else j))[:5]
            assert [got.get((i, k + 1)) for k in range(len(rest))] == rest


def test_knn_of_few_rows(spark):
    _, df = points(spark, 3, 2)
    assert neighbours.knn(df, 10).count() == 6
    assert neighbours.knn(df.limit(0), 3).count() == 0
    assert neighbours.neighbour_count(100, 10.0) == 31 and neighbours.neighbour_count(5, 10.0) == 4


def test_calibration_reaches_the_perplexity():
    d2 = np.sort(np.random.default_rng(2).gamma(2.0, size=(50, 31)), axis=1)
    beta, p = affinity.calibrate(d2, 10.0)
    entropy = -(p * np.log(p)).sum(1)
    assert np.allclose(p.sum(1), 1) and np.allclose(entropy, math.log(10.0), atol=1e-4) and (beta > 0).all()


def test_affinities_are_normalised_and_symmetric_where_mutual(spark):
    _, df = points(spark, 60, 4)
    p = affinity.normalized(affinity.symmetrized(affinity.conditional(neighbours.knn(df, 10), 3.0)))
    rows = {(r.i, r.j): r.p for r in p.collect()}
    assert abs(sum(rows.values()) - 1) < 1e-9
    assert all(abs(v - rows[j, i]) < 1e-12 for (i, j), v in rows.items() if (j, i) in rows)


# ---- matrices ----


def test_principal_components_of_a_flat_cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [5.0, 1.0] @ rng.normal(size=(2, 6)) + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    _, values, vecs = matrices.components(df, 2)
    truth = np.linalg.eigvalsh(np.cov(x.T))[::-1][:2]
    assert np.allclose(values, truth, rtol=1e-6) and np.allclose(vecs @ vecs.T, np.eye(2), atol=1e-6)
    y = np.array([r.v for r in matrices.pca(df).orderBy("id").collect()])
    assert np.allclose(y.T @ y / 199, np.diag(truth), atol=1e-6 * truth[0])


def test_matrix_algebra(spark):
    a, da = points(spark, 5, 4, 1)
    m = matrices.to_cells(da)
    got = np.zeros((4, 4))
    for r in matrices.matmul(matrices.transpose(m), m).collect():
        got[r.i, r.j] = r.val
    assert np.allclose(got, a.T @ a)
    assert matrices.subtract(m, m).where("val <> 0").count() == 0


# ---- gradients ----


def test_far_cells_and_the_grid_stand_for_points(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(size=(150, 2)) * 8
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xy)], "id long, x double, y double")
    exact = {r.i: (r.gx, r.gy) for r in embedding.negative_exact(df).collect()}
    d = xy[None] - xy[:, None]
    q = 1 / (1 + (d**2).sum(2))
    np.fill_diagonal(q, 0)
    truth = -4 * (q**2)[..., None] * d / q.sum()
    assert np.allclose(np.array([exact[i] for i in range(150)]), truth.sum(1), atol=1e-12)
    size = np.linalg.norm(truth.sum(1), axis=1).mean()
    for found, most in ((embedding.negative_barnes_hut(df, 0.0, 10), 1e-9), (embedding.negative_barnes_hut(df, 0.6, 10), 0.05), (interpolation.negative_interpolated(df, 16), 0.01)):
        g = {r.i: (r.gx, r.gy) for r in found.collect()}
        off = np.linalg.norm(np.array([g[i] for i in range(150)]) - truth.sum(1), axis=1).mean()
        assert off <= most * size


def test_steps_pull_clusters_together(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(15, 5)), rng.normal(size=(15, 5)) + 20])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    p = affinity.normalized(affinity.symmetrized(affinity.conditional(neighbours.knn(df, 7), 2.0)))
    state, smooth = embedding.run(embedding.random_start(df.select("id")), p, 4)
    y = {r.id: (r.x, r.y) for r in state.collect()}
    assert len(y) == 30 and np.isfinite(list(y.values())).all() and len(smooth) == 4


def test_one_point_and_equal_points(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(6)], "id long, x double, y double")
    assert {(r.x, r.y) for r in embedding.rescaled(same).collect()} == {(0.0, 0.0)}
    assert {round(r.z, 9) for r in embedding.repulsion(same).collect()} == {5.0}
    assert {round(r.z, 9) for r in embedding.barnes_hut(same, bucket=2, levels=3).collect()} == {5.0}


def test_lagrange_weights_are_exact_for_cubics(spark):
    df = spark.range(11).select((F.col("id") / 10).alias("r"))
    at = interpolation.node_positions()
    for power in range(4):
        got = df.select("r", sum((w * x**power for w, x in zip(interpolation.lagrange(F.col("r")), at)), F.lit(0.0)).alias("v")).collect()
        assert all(abs(r.v - r.r**power) < 1e-12 for r in got)


# ---- transforms ----


@pytest.mark.parametrize("n", [1, 2, 4, 8, 256, 1024])
def test_fft_is_the_dft(spark, n):
    z = np.random.default_rng(n).uniform(size=(n, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "n long, re double, im double")
    out = np.zeros(n, dtype=complex)
    for r in spectral.fft(df).collect():
        out[r.k] = r.re + 1j * r.im
    assert np.allclose(out, np.fft.fft(z[:, 0] + 1j * z[:, 1]), atol=1e-8)


@pytest.mark.parametrize("n", [255, 500])
def test_dft_comes_back(spark, n):
    x = np.random.default_rng(n).uniform(size=n)
    df = spectral.complex_signal(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "n long, value double"))
    back = {r.k: r.re for r in spectral.dft(spectral.dft(df).withColumnRenamed("k", "n"), inverse=True).collect()}
    assert np.allclose([back[i] for i in range(n)], x, atol=5e-5)


def test_other_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        spectral.fft(spectral.complex_signal(spark.createDataFrame([(i, 1.0) for i in range(6)], "n long, value double")))


# ---- volumes and rays ----


def _volume(spark, f, dims):
    return spark.createDataFrame([(x, y, z, float(f(x, y, z))) for z in range(dims[2]) for y in range(dims[1]) for x in range(dims[0])], "x int, y int, z int, val double")


def test_a_linear_field(spark):
    dims = (6, 5, 4)
    v = _volume(spark, lambda x, y, z: 2 * x - y + 3 * z, dims)
    inner = volumes.gradients(v).where("x between 1 and 4 and y between 1 and 3 and z between 1 and 2").select("gx", "gy", "gz").distinct().collect()
    assert [tuple(r) for r in inner] == [(2.0, -1.0, 3.0)]
    assert volumes.gradients(v).where("x = 0").agg(F.max("mag")).first()[0] == 0
    assert volumes.gradients(v, clamped=True).where("x between 1 and 4").select("gx").distinct().first()[0] == 4.0
    at = spark.createDataFrame([(0, 1.25, 2.5, 0.75), (1, 4.99, 3.0, 2.5), (2, 5.0, 1.0, 1.0), (3, -0.1, 1.0, 1.0)], "k long, sx double, sy double, sz double")
    got = {r.k: r.val for r in volumes.trilinear(at, v, dims, ["k"]).collect()}
    assert np.allclose([got[k] for k in range(4)], [2.25, 14.48, 0, 0])
    near = {r.k: r.val for r in volumes.nearest(at, v, dims, ["k"]).collect()}
    assert near[0] == 2 * 1 - 3 + 3 * 1 and near[3] == 2 * 0 - 1 + 3


def test_bricks_and_packing(spark):
    v = _volume(spark, lambda x, y, z: x, (5, 3, 3))
    b = {(r.bx, r.by, r.bz): (r.low, r.high) for r in volumes.bricks(v, 2).collect()}
    assert len(b) == 3 * 2 * 2 and b[2, 0, 0] == (4.0, 4.0) and b[0, 1, 1] == (0.0, 1.0)
    assert volumes.pack_dims(5, 16) == (5, 1, 1) and math.prod(volumes.pack_dims(100, 16)) == 100 and math.prod(volumes.pack_dims(17, 16)) == 18


def test_octree_covers_the_volume(spark):
    boxes = volumes.octree(spark, (20, 9, 9), 4)
    assert boxes.where("leaf").select(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0")))).first()[0] == 20 * 9 * 9
    v = _volume(spark, lambda x, y, z: 1.0 if x == 19 and y == 8 and z == 8 else 0.0, (20, 9, 9))
    leaves = volumes.occupied_leaves(boxes, v, (20, 9, 9), 4, F.max("val") > 0)
    assert leaves.where("full").count() == 1
    classed = volumes.occupancy(boxes, leaves)
    faces = volumes.emitted(classed).orderBy("seq").collect()
    assert faces[0].path == "" and faces[0].front == 0 and faces[-1].path == "" and faces[-1].front == 1 and len(faces) % 2 == 0


def test_long_exponential_means(spark):
    v = np.random.default_rng(3).random(9000) + 1
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "n long, v double").repartition(5)
    want = [v[0]]
    for x in v[1:]:
        want.append(0.9 * want[-1] + 0.1 * x)
    for terms in (1 << 16, 1000):
        got = [r.ema for r in embedding.ema(df, "n", "v", terms=terms).orderBy("n").collect()]
        assert np.allclose(got, want, atol=1e-12)


def test_gradients_cross_bricks(spark):
    rng = np.random.default_rng(6)
    a = rng.random((9, 7, 5))
    v = _volume(spark, lambda x, y, z: float(a[x, y, z]), a.shape)
    for clamped in (False, True):
        pad = np.pad(a, 1, mode="edge")
        g = [(np.roll(pad, -1, k) - np.roll(pad, 1, k))[1:-1, 1:-1, 1:-1] for k in range(3)]
        if not clamped:
            inner = np.zeros(a.shape, dtype=bool)
            inner[1:-1, 1:-1, 1:-1] = True
            g = [np.where(inner, x / 2, 0) for x in g]
        for side in (3, 32):
            rows = volumes.gradients(v, clamped, side).collect()
            assert len(rows) == a.size and all(np.allclose((r.gx, r.gy, r.gz), [x[r.x, r.y, r.z] for x in g]) for r in rows)


def test_leaves_by_arithmetic_hold_their_voxels(spark):
    for dims, least in (((20, 9, 9), 4), ((13, 30, 7), 2), ((3, 3, 3), 4), ((1, 1, 1), 1)):
        boxes = {r.path: r for r in volumes.octree(spark, dims, least).collect()}
        v = _volume(spark, lambda x, y, z: 0.0, dims)
        for r in v.select("x", "y", "z", volumes.leaf_path(dims, least).alias("p")).collect():
            b = boxes[r.p]
            assert b.leaf and b.x0 <= r.x < b.x1 and b.y0 <= r.y < b.y1 and b.z0 <= r.z < b.z1
        assert sum((b.x1 - b.x0) * (b.y1 - b.y0) * (b.z1 - b.z0) for b in boxes.values() if b.leaf) == math.prod(dims)


def test_rays_pass_the_boxes_that_a_plain_search_finds(spark):
    dims, least = (20, 9, 9), 3
    found = rays.rays(spark, rays.Camera((9.0, 4.0, -12.0), 6, 6))
    boxes = volumes.octree(spark, dims, least).collect()
    want = set()
    for r in found.collect():
        for b in boxes:
            with np.errstate(divide="ignore"):
                t = np.array([[(b[f"{a}{e}"] - r[f"o{a}"]) / r[f"d{a}"] if r[f"d{a}"] else (-np.inf, np.inf)[e] for e in (0, 1)] for a in "xyz"])
            low, high = t.min(1).max(), t.max(1).min()
            if high >= max(low, 0.0):
                want.add((r.px, r.py, b.path))
    assert {(r.px, r.py, r.path) for r in rays.visited_boxes(found, dims, least).collect()} == want


def test_edges_join_corners(spark):
    e = volumes.edges(volumes.octree(spark, (4, 6, 8), 8)).collect()
    corners = {(x, y, z) for x in (0, 4) for y in (0, 6) for z in (0, 8)}
    pairs = {frozenset([(r.ax, r.ay, r.az), (r.bx, r.by, r.bz)]) for r in e}
    assert len(pairs) == 12 and all(p <= corners and sum(a != b for a, b in zip(*p)) == 1 for p in pairs)


def test_numbers_follow_the_order(spark):
    from orrery.functions.tables import numbered

    df = spark.createDataFrame([(k // 7 if k % 5 else None, k) for k in range(60)], "shard int, v int").repartition(5)
    got = sorted((r.n, r.shard, r.v) for r in numbered(df, "shard", ["v"], "n", start=1).collect())
    assert [g[0] for g in got] == list(range(1, 61))
    assert [(-1 if s is None else s, v) for _, s, v in got] == sorted((-1 if k % 5 == 0 else k // 7, k) for k in range(60))


def test_transforms_refuse_gaps(spark):
    from orrery.operators import spectral

    df = spark.createDataFrame([(n, float(n), 0.0) for n in (0, 1, 2, 2, 4, 5, 6, 7)], "n long, re double, im double")
    with pytest.raises(Exception, match="gaps"):
        spectral.fft(df).collect()


def test_barnes_hut_with_points_at_one_place(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.random((60, 2)), np.tile([[0.25, 0.75]], (40, 1))])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    exact = {r.i: (r.z, r.fx, r.fy) for r in embedding.repulsion(points).collect()}
    for levels in (2, 8, 12):  # theta 0 takes no cell for its points
        got = {r.i: (r.z, r.fx, r.fy) for r in embedding.barnes_hut(points, 0.0, 5, levels).collect()}
        assert got.keys() == exact.keys() and all(np.allclose(got[i], exact[i]) for i in exact)


def test_neighbours_in_cells(spark):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(20, 8)) * 9, 30, axis=0) + rng.normal(size=(600, 8))
    points = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    pairs = lambda df: {(r.i, r.j) for r in df.collect()}
    truth = pairs(neighbours.knn(points, 10))
    assert len(truth & pairs(neighbours.knn_cells(points, 10, 40, 6, block_rows=16))) >= 0.9 * len(truth)
    assert pairs(neighbours.knn_cells(points, 10, 12, 12, block_rows=50)) == truth  # all cells


def test_cells_find_nine_of_ten_given_neighbours(spark):
    from orrery.plans import catalog

    pairs = lambda name: {(r.i, r.j) for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    truth = pairs("knn_topk")
    assert len(truth & pairs("knn_cells")) >= 0.9 * len(truth)


def test_orbit_camera():
    c = rays.OrbitCamera((1.0, 2.0, 3.0), 10.0)
    assert np.allclose(c.eye(), (1, 2, -7))
    r = np.array(rays.OrbitCamera((0, 0, 0), 1.0, 0.3, -1.1).rotation())
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)


def test_rays_meet_boxes(spark):
    cam = rays.Camera((2.0, 2.0, -5.0), 8, 8)
    r = rays.rays(spark, cam)
    assert r.where("abs(dx * dx + dy * dy + dz * dz - 1) > 1e-12").count() == 0
    hit = rays.clip(r, (0.0, 0.0, 0.0), (4.0, 4.0, 4.0)).collect()
    assert hit and all(abs(h.oz + h.tmin * h.dz) < 1e-9 or h.tmin > 5 for h in hit)
    straight = [h for h in hit if h.px == 4 and h.py == 4][0]
    assert (straight.tmin, straight.tmax) == (5.0, 9.0)


def test_compositing_stops_when_opaque(spark):
    s = spark.createDataFrame([(0, 0, i, 1.0) for i in range(5)], "px int, py int, i int, val double")
    table = spark.createDataFrame([(b, 1.0, 0.5, 0.0, 0.9) for b in range(256)], "bin int, r double, g double, b double, a double")
    c = rays.composite(s, table, F.lit(1.0)).first()
    assert abs(c.a - 0.99) < 1e-9 and abs(c.r - 0.99) < 1e-9 and abs(c.g - 0.495) < 1e-9


def test_transfer_table(spark):
    t = {r.bin: r for r in transfer.colour_table(transfer.control_points(spark)).collect()}
    assert len(t) == 256 and t[0].a == 0 and 0 < t[30].a <= 0.15 and t[255].a > 0.98
    assert transfer.insert_point(transfer.control_points(spark), 0.35, 0.5).count() == 11
    assert transfer.opacity_sums(transfer.colour_table(transfer.control_points(spark))).where("bin = 15").first().total == 0


def test_phong_limits(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (0.0, 0.0, -2.0)], "a double, b double, c double")
    up = [F.lit(0.0), F.lit(0.0), F.lit(5.0)]
    got = [r.r for r in numbers.with_phong(df, [0.5, 0.5, 0.5], [F.col(k) for k in "abc"], up, up, 0.1, 0.7, 0.2, 25).collect()]
    assert np.allclose(got, [0.05, 0.6, 0.6])


# ---- small things ----


def test_arrays(spark):
    a = arrays.dense(spark, (3, 4, 5)).withColumn("val", (F.col("i0") + F.col("i1") + F.col("i2")).cast("double"))
    assert arrays.lookup(a, (3, 4, 5), 2, 3, 4).first().val == 9
    with pytest.raises(IndexError):
        arrays.lookup(a, (3, 4, 5), 0, 0, -1)
    with pytest.raises(ValueError):
        arrays.lookup(a, (3, 4, 5), 1)
    with pytest.raises(ValueError):
        arrays.reshape(a, (3, 4, 5), (7, 7))
    back = arrays.reshape(arrays.reshape(a, (3, 4, 5), (6, 10)), (6, 10), (3, 4, 5))
    assert arrays.approx_equals(a, back.select("*"), ["i0", "i1", "i2"], ["val"]).first().equal
    assert not arrays.approx_equals(a, back.withColumn("val", F.col("val") + 1e-3), ["i0", "i1", "i2"], ["val"]).first().equal


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, 7.3), (0.0, 1.0), (-2.0, 1000.0)], "a double, b double")
    assert [round(r[0], 6) for r in df.select(numbers.nice_interval(F.col("a"), F.col("b"), 6)).collect()] == [1.0, 0.2, 200.0]
    assert [r[0] for r in spark.range(8).select(numbers.bit_reverse(F.col("id"), 3)).collect()] == [0, 4, 2, 6, 1, 5, 3, 7]
    assert df.select(numbers.fixed(F.col("b"), 3)).first()[0] == "7.300"
    v = spark.createDataFrame([([3.0, 4.0],), ([2.0, 2.0],)], "v array<double>")
    assert [r[0] for r in v.select(vectors.norm(F.col("v"))).collect()][0] == 5.0
    assert [r[0] for r in v.select(vectors.deviation(F.col("v"))).collect()] == [0.5, 1.0]
    p = spark.createDataFrame([(i, float(i), 0.0) for i in range(11)], "id long, x double, y double")
    assert sorted(r.tick for r in plotting.axis_ticks(p, "x").collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert plotting.upper_median(p.withColumn("g", F.lit(1)), "g", "x").first().median == 5.0
