import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import embedding_dedup, hnsw

D = "/root/testdata"


def by_hand(rows, cosine=0.9):
    """All pairs: (vec_id, n_links, component_id, kept) in the order of rows."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for n in {len(rows[i][1]) for i in ok}:
        mine = [i for i in ok if len(rows[i][1]) == n]
        v = np.array([rows[i][1] for i in mine])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for a, b in np.argwhere(v @ v.T >= cosine).tolist():
            if a != b:
                links[mine[a]].add(mine[b])
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for x in todo for j in links[x] - seen]
            seen |= set(todo)
        first = min((rows[j][0] for j in seen), default=None) if k is not None else None
        out.append((k, len(links[i]), first, k == first))
    return out


def grouped(n, d, seed, sizes):
    """Unit vectors, and groups around some of them: near copies, within and without the bound."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    for size in sizes:
        at = rng.integers(0, n, size)
        v[at] = v[at[0]] + rng.normal(size=(size, d)) * rng.uniform(0.05, 0.5)
    return v


def test_links_equal_those_of_all_pairs(spark):
    v = grouped(1500, 24, 1, [2] * 20 + [5] * 10 + [200])
    rows = [(int(i) * 3, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(10_000 + i, rows[7][1]) for i in range(30)] + [(rows[9][0], rows[9][1]), (rows[9][0], rows[11][1]), (-5, rows[7][1])]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(20_000 + i, x) for i, x in enumerate(odd * 2)] + [(None, rows[7][1]), (None, None), (30_000, [1.0, 2.0]), (30_001, [2.0, 4.0]), (30_002, [-1.0, 2.0]), (30_003, [3.0]), (30_004, [5.0]), (30_005, [-0.0, 1.0]), (30_006, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, `key.v` int")
    key = lambda x: tuple((v is not None, v) for v in x)
    got = embedding_dedup.near_duplicates(frame, min_shards=3, block_rows=500)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows), key=key)


def test_lengths_and_scales_of_doubles(spark):
    rows = [(1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [1e-300, 2e-300]), (4, [2.0, -1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    kept = embedding_dedup.keep_first(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, `a.b` string"))
    assert sorted(r.vec_id for r in kept.collect()) == [1, 4] and kept.columns == ["vec_id", "embedding", "a.b"]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_given_vectors_and_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{D}/sf0.1/embeddings.parquet").collect()]
    rng = np.random.default_rng(4)
    for i in range(0, 400, 2):  # near copies of some, close to the bound on either side
        v = np.array(rows[i][1])
        rows.append((100_000 + i, (v / np.linalg.norm(v) + rng.normal(size=len(v)) * 0.48 / 8).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.array([np.float32(x) for _, x in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= 0.9).sum(axis=1) - 1
    got = dict(embedding_dedup.near_duplicates(frame).select("vec_id", "n_links").collect())
    found = np.array([got[k] for k, _ in rows])
    assert 20 < true.sum() and (found <= true).all() and found.sum() >= 0.995 * true.sum()


def test_audit_widens_beams(spark):
    v = grouped(1200, 32, 6, [3] * 40)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    keyed = rows.select("vec_id", F.col("embedding").alias("v"), embedding_dedup._key(F.col("embedding")).alias("key"))
    nodes = embedding_dedup.distinct_vectors(keyed, min_shards=2)
    made = embedding_dedup.graphs(nodes)
    width, tried = embedding_dedup.audited_width(nodes, made, width=1, recall=0.999)
    assert [w for w, *_ in tried] == [2**k for k in range(len(tried))] and width == tried[-1][0] and min(tried[-1][1:]) >= 0.999
    assert len(tried) > 1 and min(tried[0][1:]) < 0.999


@pytest.mark.parametrize("n", [1, 2, 63, 700])
def test_graphs_reach_every_node(n):
    v = grouped(n, 16, n, [min(n, 50)])
    top = hnsw.levels(np.arange(n))
    order = np.argsort(-top, kind="stable")
    graph = hnsw.build(hnsw.unit(v[order]), top[order])
    reached, front = np.zeros(n, dtype=bool), np.array([0, *graph.entries])
    while len(front):
        reached[front] = True
        near = graph.links[0][front].ravel()
        near = near[near >= 0]
        front = np.unique(near[~reached[near]])
    assert reached.all()
    for links in graph.links:
        assert all(len(set(x[x >= 0])) == (x >= 0).sum() and k not in x for k, x in enumerate(links))
    r, c = graph.within(graph.exact, 0.9, n + 8)
    assert set(zip(r.tolist(), c.tolist(), strict=True)) == {(i, j) for i, j in zip(*np.nonzero(graph.exact @ graph.exact.T >= 0.9), strict=True)}
