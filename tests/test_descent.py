import numpy as np

from orrery.operators.descent import knn_descent
from orrery.operators.neighbours import knn
from orrery.plans.inputs import orders_3d, points_hd

D = "/root/testdata"


def measured(points, k, **how):
    """Share of the true neighbours found, share of all pairs compared, and the rows."""
    n = points.count()
    found, log = knn_descent(points, k, **how)
    rows = found.collect()
    true = {(r.i, r.j) for r in knn(points, k).collect()}
    return len(true & {(r.i, r.j) for r in rows}) / len(true), 2 * sum(r["pairs"] for r in log) / (n * (n - 1)), rows, log


def test_orders_take_a_small_share_of_pairs(spark):
    points = orders_3d(spark, f"{D}/sf0.01").cache()
    recall, share, rows, log = measured(points, 10)
    assert recall >= 0.98 and share < 0.02 and len(rows) == 10 * 15_000
    assert log[-1]["changed"] <= 0.001 * 150_000 < log[1]["changed"]
    v = {r.id: np.array(r.v) for r in points.collect()}
    last = {}
    for r in sorted(rows, key=lambda r: (r.i, r.rank)):
        assert r.i != r.j and abs(r.d2 - ((v[r.i] - v[r.j]) ** 2).sum()) < 1e-12
        assert r.rank == last.get(r.i, (0, 0.0))[0] + 1 and r.d2 >= last.get(r.i, (0, 0.0))[1]
        last[r.i] = (r.rank, r.d2)


def test_vectors_that_vary_in_all_directions(spark):
    """The given vectors have no structure to descend along: the neighbours are found, but hardly fewer pairs than all are needed for it."""
    recall, _, rows, _ = measured(points_hd(spark, f"{D}/sf0.001"), 31)
    assert recall >= 0.95 and len(rows) == 31 * 500


def test_hubs_copies_and_few_rows(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate((np.zeros((150, 6)), rng.normal(size=(450, 6)), np.repeat(rng.normal(size=(1, 6)), 100, axis=0)))  # two places with many rows, one of them the centre of all
    points = spark.createDataFrame([(int(i) * 7 - 900, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    found, _ = knn_descent(points, 5, cell_rows=16, group_rows=64)
    d2 = {}
    for r in found.collect():
        d2.setdefault((r.i + 900) // 7, []).append(r.d2)
    full = np.sort(((v[:, None] - v[None]) ** 2).sum(axis=2) + np.where(np.eye(len(v)), np.inf, 0), axis=1)[:, :5]
    assert sorted(d2) == list(range(700)) and np.mean([np.allclose(sorted(d2[i]), full[i], atol=1e-12) for i in d2]) > 0.6  # links into the hub lead nowhere else
    assert knn_descent(points.limit(0), 3)[0].count() == 0
    for n in (1, 2, 4):
        few = points.limit(n)
        assert sorted((r.i, r.j) for r in knn_descent(few, 5)[0].collect()) == sorted((r.i, r.j) for r in knn(few, 5).collect())


def test_more_starts_find_more(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.random((800, 2)))], "id long, v array<double>")
    recall, share, _, _ = measured(points, 8, starts=3, rounds=2)
    assert recall > 0.95 and share < 0.5
