"""Queries that leave no row of their tables out."""

import numpy as np
import pytest

from orrery.plans import catalog

D = "/root/testdata/sf0.001"


def test_every_event_is_transformed(spark, tmp_path):
    # 700 ids with gaps, over two shards
    ids = [*range(5, 1200, 2)] + [*range(65_000, 66_000, 10)] + [7 * 10**9, 7 * 10**9 + 3]
    value = np.random.default_rng(1).random(len(ids))
    spark.createDataFrame([(i, float(v)) for i, v in zip(ids, value)], "event_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    padded = np.concatenate((value, np.zeros(1024 - len(ids))))
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    for name, signal in (("fft_1d_whole", padded), ("fft_1d_complex_whole", padded * (1 + 0.5j))):
        got = run(name)
        assert [k for k, _, _ in got] == list(range(1024))
        assert np.allclose([complex(re, im) for _, re, im in got], np.fft.fft(signal), atol=2e-3)
    assert np.allclose([v for _, v in run("ifft_1d_whole")], 1024 * padded, atol=2e-3)
    assert run("bit_reversal_whole") == [(n, int(f"{n:010b}"[::-1], 2)) for n in range(1024)]


def test_every_column_is_multiplied(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").select("embedding").collect()
    m = np.array([r[0] for r in rows])
    got = {(r.i, r.j): r.val for r in catalog.QUERIES["matmul_whole"](spark, D).collect()}
    assert len(got) == 64 * 64 and np.allclose([[got[i, j] for j in range(64)] for i in range(64)], m.T @ m, atol=2e-6)


def test_every_voxel_is_looked_up(spark):
    got = sorted(map(tuple, catalog.QUERIES["voxel_lookup_whole"](spark, D).collect()))
    want = sorted((r.x + 50 * (r.y + 11 * r.z), r.val) for r in catalog.QUERIES["voxel_grid"](spark, D).collect())
    assert len(got) == 4950 and got == want


def test_two_components_and_every_row(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    m = np.array([r[1] for r in rows])
    values, vectors = np.linalg.eigh(np.cov(m.T))
    assert np.allclose([r.value for r in catalog.QUERIES["eigen_top2"](spark, D).orderBy("k").collect()], values[[-1, -2]], atol=1e-6)
    y = (m - m.mean(0)) @ vectors[:, [-1, -2]]
    y *= np.sign(y[np.abs(y).argmax(0), [0, 1]])
    got = catalog.QUERIES["pca_embed2"](spark, D).orderBy("id").collect()
    assert [r.id for r in got] == [r.vec_id for r in rows] and np.allclose([(r.x, r.y) for r in got], y, atol=2e-6)


def test_the_grid_of_the_reference(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").selectExpr("vec_id", "double(embedding[0])", "double(embedding[1])").orderBy("vec_id").collect()
    p = np.array([r[1:] for r in rows])
    p = (p - p.min(0)) / (p.max(0) - p.min(0))
    run = lambda name: catalog.QUERIES[name](spark, D)
    away = p[:, None] - p[None]
    q = 1 / (1 + (away**2).sum(2))
    z = q.sum() - len(p)
    assert abs(run("fit_sum_q_32").first().z - z) < 1e-5 * z
    force = 4 * (q[:, :, None] ** 2 * away).sum(1) / z
    assert np.allclose([(r.gx, r.gy) for r in run("fit_repulsive_32").orderBy("i").collect()], force, atol=1e-7)
    assert np.allclose([r.p0 for r in run("fit_potentials_32").orderBy("id").collect()], (q**2).sum(1), atol=1e-3)
    w = run("fit_w_32").collect()
    assert max(r.nx for r in w) > 100 and np.allclose([sum(r.w0 for r in w), sum(r.w1 for r in w)], [len(p), p[:, 0].sum()], atol=1e-2)


def boxes_below(path, box):
    """(path, box, whether a leaf) of a box and all below it, split in the middle until a side is 2 or shorter."""
    leaf = min(high - low for low, high in box) <= 2
    yield path, box, leaf
    if not leaf:
        for k in range(8):
            halves = [((low + high) // 2, high) if k >> a & 1 else (low, (low + high) // 2) for a, (low, high) in enumerate(box)]
            yield from boxes_below(f"{path}{k}", halves)


@pytest.mark.parametrize("even", [False, True])
def test_every_child_is_sorted(spark, tmp_path, even):
    d = D
    if even:  # a line item in each voxel: no leaf is full
        rows = [(x + 1.0, y / 100, z / 100) for x in range(50) for y in range(11) for z in range(9)]
        d = str(tmp_path)
        spark.createDataFrame(rows, "l_quantity double, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    val = np.zeros((50, 11, 9))
    for r in catalog.QUERIES["voxel_grid"](spark, d).collect():
        val[r.x, r.y, r.z] = r.val
    iso = np.floor(val.mean() + 2.2 * val.std()) + 0.5
    boxes = {path: (box, leaf) for path, box, leaf in boxes_below("", [(0, 50), (0, 11), (0, 9)])}
    inside = {path: val[tuple(slice(*side) for side in box)] for path, (box, leaf) in boxes.items() if leaf}
    full = {path: bool(v.min() <= iso <= v.max()) for path, v in inside.items()}
    far = {path: sum(((low + high) / 2 - eye) ** 2 for (low, high), eye in zip(box, (10, 20, 30), strict=True)) for path, (box, _) in boxes.items()}
    want = set()
    for parent, (_, leaf) in boxes.items():
        children = [] if leaf else sorted((f"{parent}{k}" for k in range(8)), key=lambda path: (-far[path], path))
        for place, path in enumerate(children, 1):
            below = [f for p, f in full.items() if p.startswith(path)]
            want.add((path, place, below.count(False), below.count(True), int(below.count(False) <= below.count(True))))
    got = [tuple(r) for r in catalog.QUERIES["occ_sort"](spark, d).collect()]
    assert len(got) == len(boxes) - 1 == 168 and set(got) == want
    assert any(n_full for _, _, _, n_full, _ in got) != even
