import numpy as np
import pytest

from orrery.operators import matrices, sketching
from orrery.plans.inputs import points_hd

D = "/root/testdata/sf0.01"


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)


def test_both_pairs_agree_with_the_matrix(spark):
    """The given vectors vary about as much in all directions: the hardest case, and an exact one here, as the blocks reach all 64 of them."""
    points = points_hd(spark, D)
    x = np.array([r.v for r in points.collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    mean, got, w = sketching.principal(points, blocks=7)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(got, values[[-1, -2]], atol=1e-8)
    assert np.allclose(np.abs((w * vectors[:, [-1, -2]].T).sum(axis=1)), 1, atol=1e-6)
    y = np.array([r.v for r in sketching.projected(points, mean, w).orderBy("id").collect()])
    assert np.allclose(y.T @ y / (len(x) - 1), np.diag(got), atol=1e-8)
    _, fewer, _ = sketching.principal(points)
    assert np.allclose(fewer, values[[-1, -2]], atol=1e-4)


def test_a_hundred_thousand_components(spark):
    rng = np.random.default_rng(5)
    d, n = 100_000, 60
    directions = np.linalg.qr(rng.normal(size=(d, 3)))[0]
    x = rng.normal(size=(n, 3)) * [40.0, 15.0, 4.0] @ directions.T + rng.normal(size=(n, d)) * 0.01 + 3
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    _, got, w = sketching.principal(points, width=4, blocks=4)
    c = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(c @ c.T)[::-1][:2] / (n - 1)
    assert np.allclose(got, values, rtol=1e-8) and w.shape == (2, d)
    with pytest.raises(ValueError, match="components"):
        matrices.covariance(points)


def test_few_rows_and_flat_ones(spark):
    assert sketching.principal(frame(spark, np.zeros((0, 3))))[1].size == 0
    x = np.outer(np.arange(6), [1.0, -2.0, 0.0]) + 5
    _, values, vectors = sketching.principal(frame(spark, x))
    assert np.allclose(values, [17.5, 0], atol=1e-9) and np.allclose(vectors[0], np.array([-1, 2, 0]) / 5**0.5)
    assert np.allclose(sketching.principal(frame(spark, np.ones((4, 2))))[1], 0)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_factors_merge(spark, fan_in):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7))
    r = sketching.tall_skinny_r(frame(spark, x).repartition(11), 7, fan_in)
    assert r.shape == (7, 7) and np.allclose(np.tril(r, -1), 0) and np.allclose(r.T @ r, x.T @ x)


def test_products_of_tiles(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((13, 9)), rng.random((9, 17))
    a[rng.random(a.shape) < 0.6] = 0
    cells = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.argwhere(m).tolist()], "i long, j long, val double")
    got = {(r.i, r.j): r.val for r in matrices.matmul(cells(a), cells(b), tile=4).collect()}
    want = a @ b
    assert got.keys() == {(i, j) for i, j in np.argwhere(want).tolist()} and all(abs(want[k] - v) < 1e-12 for k, v in got.items())
    assert matrices.matmul(cells(a).limit(0), cells(b)).count() == 0
