import numpy as np
import pytest

from orrery.operators import quadtree


def recursive(v, theta, bucket, levels):
    """z, fx, fy of each point by a walk from the root, cell after cell."""
    low, high = v.min(axis=0), v.max(axis=0)
    side = (high - low).max() * (1 + 1e-9) or 1.0
    corner = (low + high) / 2 - side / 2

    def walk(p, members, corner, side, depth):
        if not len(members):
            return np.zeros(3)
        if len(members) <= bucket or depth == levels:
            d = v[members[members != p]] - v[p]
            q = 1 / (1 + (d**2).sum(axis=1))
            return np.array([q.sum(), *(q[:, None] ** 2 * d).sum(axis=0)])
        d = v[members].mean(axis=0) - v[p]
        d2 = (d**2).sum()
        if d2 > 0 and side * side < theta * theta * d2:
            q = 1 / (1 + d2)
            return len(members) * np.array([q, *(q * q * d)])
        half = side / 2
        quarter = np.minimum(np.floor((v[members] - corner) / half), 1)
        return sum(walk(p, members[(quarter == (a, b)).all(axis=1)], corner + half * np.array([a, b]), half, depth + 1) for a in (0, 1) for b in (0, 1))

    return np.array([walk(p, np.arange(len(v)), corner, side, 0) for p in range(len(v))])


def sums(spark, v, **how):
    points = spark.createDataFrame([(i * 3 - 50, float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, x double, y double")
    rows = sorted(quadtree.barnes_hut(points, **how).collect())
    assert [r.i for r in rows] == [i * 3 - 50 for i in range(len(v))]
    return np.array([(r.z, r.fx, r.fy) for r in rows])


@pytest.mark.parametrize("stretch_rows", [7, 60, 10_000])
def test_stretches_give_what_one_walk_gives(spark, stretch_rows):
    rng = np.random.default_rng(2)
    v = np.concatenate((rng.normal(size=(150, 2)), rng.normal(size=(100, 2)) * 0.01 + 2, np.repeat([[0.3, 0.3]], 90, axis=0)))  # a dense part, and many at one place
    for theta, bucket, levels in ((0.6, 5, 12), (1.2, 1, 4), (0.0, 20, 8)):
        assert np.allclose(sums(spark, v, theta=theta, bucket=bucket, levels=levels, stretch_rows=stretch_rows), recursive(v, theta, bucket, levels), rtol=1e-9, atol=1e-10)


def test_few_points(spark):
    assert quadtree.barnes_hut(spark.createDataFrame([], "id long, x double, y double")).count() == 0
    assert np.allclose(sums(spark, [[1.0, 2.0]]), 0)
    assert np.allclose(sums(spark, [[1.0, 2.0]] * 30, stretch_rows=4, bucket=2), [[29.0, 0, 0]] * 30)


def test_far_stretches_send_few_cells():
    """What a stretch sends to one far away is a handful of cells, however many points both have."""
    rng = np.random.default_rng(4)
    square = quadtree.Square(0.0, 0.0, 1.0, 16, 10)
    for n in (1000, 16_000):
        x, y = rng.random(n) * 0.125, rng.random(n) * 0.125
        code = square.code(x, y)
        order = np.argsort(code)
        mine = square.own(code[order], x[order], y[order], quadtree.NO_CELLS)
        near, far = np.array([0.13, 0.25, 0.0, 0.125]), np.array([0.875, 1.0, 0.875, 1.0])
        sent = [len(quadtree._essential(square, mine, quadtree.NO_CELLS, np.array([near, far]), np.array([k]), 0.6)[0]) for k in (0, 1)]
        assert sent[1] <= 5 < sent[0] < len(mine.key)


def test_z_order_interleaves():
    ix, iy = np.array([0b101, 0b011]), np.array([0b110, 0b000])
    assert [f"{c:06b}" for c in quadtree.z_order(ix, iy, 3)] == ["111001", "000101"]
