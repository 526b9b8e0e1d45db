"""Queries: matrices, principal components, and the optimiser of the embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.numbers import clamp, tidy
from ..operators import embedding, interpolation, matrices, sketching
from .inputs import HD, P2, PMAT, points_2d, points_hd
from .neighbours import p_matrix_of, with_
from .registry import query

CELLS = f"{HD}, cells AS (SELECT id AS i, unnest(range(len(v))) AS j, unnest(v) AS val FROM pts)"


# ---- rows and matrices ---------------------------------------------------------------------------------------------


@query(f"WITH {HD} SELECT id, round(list_avg(v), 6) AS mean FROM pts")
def row_mean(spark: SparkSession, d: str) -> DataFrame:
    return points_hd(spark, d).select("id", tidy(vectors.mean(F.col("v"))).alias("mean"))


@query(f"WITH {HD} SELECT id, round(list_stddev_pop(v), 6) AS sd FROM pts")
def row_std(spark: SparkSession, d: str) -> DataFrame:
    return points_hd(spark, d).select("id", tidy(vectors.deviation(F.col("v"))).alias("sd"))


@query(f"WITH {HD} SELECT id, round(list_sum(list_transform(v, lambda x: abs((x - list_avg(v)) / list_stddev_pop(v)))), 6) AS spread, round((v[1] - list_avg(v)) / list_stddev_pop(v), 6) AS first FROM pts")
def row_standardize(spark: SparkSession, d: str) -> DataFrame:
    z = points_hd(spark, d).select("id", vectors.standardized(F.col("v")).alias("z"))
    return z.select("id", tidy(vectors.total(F.transform("z", F.abs))).alias("spread"), tidy(z.z[0]).alias("first"))


@query(f"WITH {HD} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM pts")
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return points_hd(spark, d).select("id", tidy(vectors.norm(F.col("v"))).alias("norm"))


@query(f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(covar_samp(a.val, b.val), 6) + 0 AS val FROM cells a JOIN cells b USING (i) GROUP BY a.j, b.j")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return matrices.covariance(points_hd(spark, d)).withColumn("val", tidy(F.col("val")))


_PRODUCT = f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.val * b.val), 6) + 0 AS val FROM cells a JOIN cells b USING (i) GROUP BY a.j, b.j"


@query(_PRODUCT, name="matmul_whole")
@query(_PRODUCT)
def matmul(spark: SparkSession, d: str) -> DataFrame:
    """The transposed matrix times the matrix, all columns."""
    m = matrices.to_cells(points_hd(spark, d))
    return matrices.matmul(matrices.transpose(m), m).withColumn("val", tidy(F.col("val")))


@query(f"WITH {CELLS} SELECT j AS i, i AS j, val FROM cells")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return matrices.transpose(matrices.to_cells(points_hd(spark, d)))


@query(f"WITH {CELLS} SELECT i, j, round(val / 4, 6) + 0 AS val FROM cells")
def matrix_divide(spark: SparkSession, d: str) -> DataFrame:
    return matrices.divide(matrices.to_cells(points_hd(spark, d)), 4.0).withColumn("val", tidy(F.col("val")))


@query(f"WITH {CELLS}, m AS (SELECT j, avg(val) AS m FROM cells GROUP BY j) SELECT i, j, round(val - m, 6) + 0 AS val FROM cells JOIN m USING (j)")
def matrix_subtract(spark: SparkSession, d: str) -> DataFrame:
    """The matrix less a matrix of column means."""
    cells = matrices.to_cells(points_hd(spark, d))
    means = cells.groupBy("j").agg(F.avg("val").alias("val"))
    wide = cells.select("i", "j").join(means, "j")
    return matrices.subtract(cells, wide).withColumn("val", tidy(F.col("val")))


_POWER = """cov AS (SELECT a.j AS i, b.j AS j, covar_samp(a.val, b.val) AS c FROM cells a JOIN cells b USING (i) GROUP BY a.j, b.j),
rows_ AS (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i), m AS (SELECT list(r ORDER BY i) AS m FROM rows_),
s AS (SELECT list((((i + 1) * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE ORDER BY i) AS v FROM rows_),
p1(step, v) AS (SELECT 0, v FROM s UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT step, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM p1, m WHERE step < 100)),
v1 AS (SELECT v FROM p1 WHERE step = 100), l1 AS (SELECT list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM v1, m),
m2 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list_transform(list_zip(r, v1.v), lambda x: x[1] - l * v1.v[i + 1] * x[2]) AS row FROM rows_, v1, l1)),
p2(step, v) AS (SELECT 0, v FROM s UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT step, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM p2, m2 WHERE step < 100)),
v2 AS (SELECT v FROM p2 WHERE step = 100), l2 AS (SELECT list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM v2, m2),
pairs AS (SELECT k, l, list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v
  FROM (SELECT 0 AS k, l, v FROM l1, v1 UNION ALL SELECT 1, l, v FROM l2, v2))"""


@query(with_(f"{CELLS}, {_POWER}", "SELECT k::INT AS k, round(l, 4) AS value, list_transform(v, lambda x: round(x, 4) + 0) AS vector FROM pairs"))
def eigen_top(spark: SparkSession, d: str) -> DataFrame:
    """The two largest eigenvalues of the covariance with their vectors, by a hundred rounds of power iteration and deflation; the largest entry of a vector is positive."""
    _, values, vectors = matrices.components(points_hd(spark, d), 2)
    rows = [(k, round(float(v), 4), [round(float(x), 4) + 0.0 for x in w]) for k, (v, w) in enumerate(zip(values, vectors, strict=True))]
    return spark.createDataFrame(rows, "k int, value double, vector array<double>")


@query(with_(f"{CELLS}, {_POWER}, mn AS (SELECT j, avg(val) AS m FROM cells GROUP BY j)", "SELECT c.i AS id, round(sum((c.val - mn.m) * a.v[c.j + 1]), 4) + 0 AS x, round(sum((c.val - mn.m) * b.v[c.j + 1]), 4) + 0 AS y FROM cells c JOIN mn USING (j), pairs a, pairs b WHERE a.k = 0 AND b.k = 1 GROUP BY c.i"))
def pca_embed(spark: SparkSession, d: str) -> DataFrame:
    """Both coordinates of every row along the vectors of eigen_top."""
    p = matrices.pca(points_hd(spark, d), 2)
    return p.select("id", tidy(F.col("v")[0], 4).alias("x"), tidy(F.col("v")[1], 4).alias("y"))


_EIGEN = 4  # digits


@query()
def pca_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The two largest eigenvalues of the covariance with their vectors, by a random range and tall-skinny QR."""
    _, values, vectors_ = sketching.principal(points_hd(spark, d))
    rows = [(k, round(float(v), 6), [round(float(x), _EIGEN) + 0.0 for x in w]) for k, (v, w) in enumerate(zip(values, vectors_, strict=True))]
    return spark.createDataFrame(rows, "k int, value double, vector array<double>")


@query()
def pca_sketch_embed(spark: SparkSession, d: str) -> DataFrame:
    """Both coordinates of every row along the vectors of pca_sketch."""
    points = points_hd(spark, d)
    mean, _, vectors_ = sketching.principal(points)
    p = sketching.projected(points, mean, vectors_)
    return p.select("id", tidy(F.col("v")[0], _EIGEN).alias("x"), tidy(F.col("v")[1], _EIGEN).alias("y"))


#: Rounds for two components, as their eigenvalues are within 1 to 7 % of the next ones in the given tables.
ROUNDS = 5000


@query()
def eigen_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two largest eigenvalues of the covariance, the second after deflation."""
    _, values, _ = matrices.components(points_hd(spark, d), 2, ROUNDS)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, value double").select("k", F.round("value", 6).alias("value"))


@query()
def pca_embed2(spark: SparkSession, d: str) -> DataFrame:
    """Both principal coordinates of every row; the largest of each in size is positive."""
    p = matrices.pca(points_hd(spark, d), 2, ROUNDS).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    signs = p.agg(*(F.signum(F.max_by(c, F.abs(c))).alias(f"s{c}") for c in ("x", "y")))
    return p.crossJoin(F.broadcast(signs)).select("id", tidy(F.col("x") * F.col("sx")).alias("x"), tidy(F.col("y") * F.col("sy")).alias("y"))


# ---- starts and scales ---------------------------------------------------------------------------------------------

SCALED = f"{P2}, sc AS (SELECT id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM p2)"


@query(f"WITH {SCALED} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM sc")
def minmax_rescale(spark: SparkSession, d: str) -> DataFrame:
    return embedding.rescaled(points_2d(spark, d)).select("id", tidy(F.col("x")).alias("x"), tidy(F.col("y")).alias("y"))


@query("WITH a AS (SELECT vec_id AS id, (vec_id % 2147483648 * 1103515245 + 12345) % 2147483648 AS u FROM embeddings) SELECT id, u / 2147483648.0::DOUBLE AS x, ((u * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS y FROM a")
def random_init(spark: SparkSession, d: str) -> DataFrame:
    return embedding.random_start(points_2d(spark, d).select("id"))


@query(f"WITH {P2} SELECT id, round(least(greatest(x, -0.1), 0.1), 6) AS x FROM p2")
def clamp_values(spark: SparkSession, d: str) -> DataFrame:
    return points_2d(spark, d).select("id", tidy(clamp(F.col("x"), -0.1, 0.1)).alias("x"))


# ---- exact gradients -----------------------------------------------------------------------------------------------

PAIRS = f"{SCALED}, pr AS (SELECT a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy, 1 / (1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS q FROM sc a JOIN sc b ON a.id <> b.id)"
NEG = f"{PAIRS}, z AS (SELECT sum(q) AS z FROM pr), neg AS (SELECT i, -4 * sum(q * q * dx) / any_value(z) AS gx, -4 * sum(q * q * dy) / any_value(z) AS gy FROM pr, z GROUP BY i)"
POS = "pos AS (SELECT pm.i, sum(4 * 3.0 * p * dx / (1 + dx * dx + dy * dy)) AS gx, sum(4 * 3.0 * p * dy / (1 + dx * dx + dy * dy)) AS gy FROM pm JOIN (SELECT a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy FROM sc a, sc b) e USING (i, j) GROUP BY pm.i)"


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return embedding.rescaled(points_2d(spark, d))


@query(f"WITH {PAIRS} SELECT round(sum(q), 4) AS z FROM pr")
def tsne_z_exact(spark: SparkSession, d: str) -> DataFrame:
    return embedding.repulsion(_scaled(spark, d)).agg(F.round(F.sum("z"), 4).alias("z"))


@query(f"WITH {NEG} SELECT i, round(gx, 8) + 0 AS gx, round(gy, 8) + 0 AS gy FROM neg")
def tsne_repulsive(spark: SparkSession, d: str) -> DataFrame:
    return embedding.negative_exact(_scaled(spark, d)).select("i", tidy(F.col("gx"), 8).alias("gx"), tidy(F.col("gy"), 8).alias("gy"))


@query(with_(f"{PMAT}, {SCALED}, {POS}", "SELECT i, round(gx, 8) + 0 AS gx, round(gy, 8) + 0 AS gy FROM pos"))
def tsne_attractive(spark: SparkSession, d: str) -> DataFrame:
    g = embedding.attraction(_scaled(spark, d), p_matrix_of(spark, d), 3.0)
    return g.select("i", tidy(F.col("gx"), 8).alias("gx"), tidy(F.col("gy"), 8).alias("gy"))


@query(with_(f"{PMAT}, {SCALED}", "SELECT round(sum(12.0 * p * sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) / (1 + pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) / count(DISTINCT pm.i), 8) AS mean_force FROM pm JOIN sc a ON a.id = pm.i JOIN sc b ON b.id = pm.j"))
def mean_force(spark: SparkSession, d: str) -> DataFrame:
    forces = embedding.edge_forces(_scaled(spark, d), p_matrix_of(spark, d), 3.0)
    return embedding.force_magnitude(forces).select(F.round("mean_force", 8).alias("mean_force"))


_STEP = f"{PMAT}, {NEG}, {POS}, st AS (SELECT sc.id, sc.x + 100 * (neg.gx + pos.gx) AS x, sc.y + 100 * (neg.gy + pos.gy) AS y, sc.x AS px, sc.y AS py FROM sc JOIN neg ON neg.i = sc.id JOIN pos ON pos.i = sc.id)"


def _first_step(spark: SparkSession, d: str) -> DataFrame:
    start = _scaled(spark, d).select("id", "x", "y", F.col("x").alias("px"), F.col("y").alias("py"))
    return embedding.step(start, p_matrix_of(spark, d), 1)


@query(with_(_STEP, "SELECT id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM st"))
def tsne_step(spark: SparkSession, d: str) -> DataFrame:
    return _first_step(spark, d).select("id", tidy(F.col("x")).alias("x"), tidy(F.col("y")).alias("y"))


@query(with_(_STEP, "SELECT round(avg(sqrt(pow(x - px, 2) + pow(y - py, 2))), 6) AS displacement FROM st"))
def mean_displacement(spark: SparkSession, d: str) -> DataFrame:
    return embedding.displacement(_first_step(spark, d)).select(F.round("displacement", 6).alias("displacement"))


_TWO = f"""{_STEP}, e2 AS (SELECT a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy FROM st a JOIN st b ON a.id <> b.id), q2 AS (SELECT *, 1 / (1 + dx * dx + dy * dy) AS q FROM e2),
n2 AS (SELECT i, -4 * sum(q * q * dx) / (SELECT sum(q) FROM q2) AS gx, -4 * sum(q * q * dy) / (SELECT sum(q) FROM q2) AS gy FROM q2 GROUP BY i),
a2 AS (SELECT pm.i, sum(12.0 * p * dx * q) AS gx, sum(12.0 * p * dy * q) AS gy FROM pm JOIN q2 USING (i, j) GROUP BY pm.i)"""


@query(with_(_TWO, "SELECT st.id, round(st.x + 100 * (n2.gx + a2.gx) + 0.5 * (st.x - px), 5) + 0 AS x, round(st.y + 100 * (n2.gy + a2.gy) + 0.5 * (st.y - py), 5) + 0 AS y FROM st JOIN n2 ON n2.i = st.id JOIN a2 ON a2.i = st.id"))
def tsne_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """Two steps with exact gradients, the second with momentum."""
    state, _ = embedding.run(_scaled(spark, d), p_matrix_of(spark, d), 2)
    return state.select("id", tidy(F.col("x"), 5).alias("x"), tidy(F.col("y"), 5).alias("y"))


@query()
def tsne_run(spark: SparkSession, d: str) -> DataFrame:
    """Five steps from the random start, Barnes-Hut repulsion, with what moved."""
    start = embedding.random_start(points_2d(spark, d).select("id"))
    state, smooth = embedding.run(start, p_matrix_of(spark, d), 5, embedding.negative_barnes_hut)
    return state.select("id", "x", "y", F.lit(smooth[-1]).alias("smoothed"))


_DAILY = "dly AS (SELECT date_trunc('day', ts)::DATE AS day, avg(value) AS value FROM events GROUP BY 1), o AS (SELECT day, value, row_number() OVER (ORDER BY day) AS r FROM dly)"
_EMA = f"{_DAILY}, em(day, r, value, ema) AS (SELECT day, r, value, value FROM o WHERE r = 1 UNION ALL SELECT o.day, o.r, o.value, 0.9 * em.ema + 0.1 * o.value FROM em JOIN o ON o.r = em.r + 1)"


def _ema(spark: SparkSession, d: str) -> DataFrame:
    daily = spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return embedding.ema(daily, "day", "value")


@query(with_(_EMA, "SELECT day, round(value, 6) AS value, round(ema, 6) AS ema FROM em"))
def ema(spark: SparkSession, d: str) -> DataFrame:
    return _ema(spark, d).select("day", F.round("value", 6).alias("value"), F.round("ema", 6).alias("ema"))


@query(with_(_EMA, "SELECT day, ema < (SELECT avg(value) FROM dly) AS converged FROM em"))
def converged(spark: SparkSession, d: str) -> DataFrame:
    """Whether the smoothed series is under a threshold, here the overall mean."""
    return _ema(spark, d).select("day", (F.col("ema") < F.avg("value").over(Window.partitionBy())).alias("converged"))


# ---- Barnes-Hut ----------------------------------------------------------------------------------------------------

_BUCKET, _LEVELS = 20, 12
TREE = f"""{SCALED}, bx AS (SELECT (min(x) + max(x)) * 0.5 AS cx, (min(y) + max(y)) * 0.5 AS cy, greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9) AS side FROM sc),
pc_ AS (SELECT id, x, y, k AS depth, least(floor((x - (cx - side / 2)) / side * pow(2.0, k)), pow(2.0, k) - 1)::BIGINT AS ix, least(floor((y - (cy - side / 2)) / side * pow(2.0, k)), pow(2.0, k) - 1)::BIGINT AS iy FROM sc, bx, range({_LEVELS + 1}) r(k)),
ce AS (SELECT depth, ix, iy, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM pc_ GROUP BY ALL),
tree AS (SELECT c.depth::INT AS depth, c.ix, c.iy, c.n, c.mx, c.my, side / pow(2.0, c.depth) AS w, (c.n <= {_BUCKET} OR c.depth = {_LEVELS}) AS leaf
  FROM ce c JOIN bx ON true LEFT JOIN ce u ON u.depth = c.depth - 1 AND u.ix = c.ix // 2 AND u.iy = c.iy // 2 WHERE c.depth = 0 OR u.n > {_BUCKET}),
fr(i, x, y, depth, ix, iy, n, mx, my, leaf, far) AS (
  SELECT s.id, s.x, s.y, t.depth, t.ix, t.iy, t.n, t.mx, t.my, t.leaf, NOT t.leaf AND pow(t.mx - s.x, 2) + pow(t.my - s.y, 2) > 0 AND t.w * t.w < 0.36 * (pow(t.mx - s.x, 2) + pow(t.my - s.y, 2)) FROM sc s, tree t WHERE t.depth = 0
  UNION ALL SELECT f.i, f.x, f.y, t.depth, t.ix, t.iy, t.n, t.mx, t.my, t.leaf, NOT t.leaf AND pow(t.mx - f.x, 2) + pow(t.my - f.y, 2) > 0 AND t.w * t.w < 0.36 * (pow(t.mx - f.x, 2) + pow(t.my - f.y, 2))
  FROM fr f JOIN tree t ON t.depth = f.depth + 1 AND t.ix // 2 = f.ix AND t.iy // 2 = f.iy WHERE NOT f.far AND NOT f.leaf),
bh AS (SELECT i, n / (1 + pow(mx - x, 2) + pow(my - y, 2)) AS z, n * (mx - x) / pow(1 + pow(mx - x, 2) + pow(my - y, 2), 2) AS fx, n * (my - y) / pow(1 + pow(mx - x, 2) + pow(my - y, 2), 2) AS fy FROM fr WHERE far
  UNION ALL SELECT f.i, 1 / (1 + pow(p.x - f.x, 2) + pow(p.y - f.y, 2)), (p.x - f.x) / pow(1 + pow(p.x - f.x, 2) + pow(p.y - f.y, 2), 2), (p.y - f.y) / pow(1 + pow(p.x - f.x, 2) + pow(p.y - f.y, 2), 2)
  FROM fr f JOIN pc_ p ON p.depth = f.depth AND p.ix = f.ix AND p.iy = f.iy AND p.id <> f.i WHERE f.leaf)"""


@query(with_(TREE, "SELECT depth, ix, iy, n, round(mx, 6) AS mx, round(my, 6) AS my, round(w, 6) AS w, leaf FROM tree"))
def quadtree_cells(spark: SparkSession, d: str) -> DataFrame:
    t = embedding.quadtree(_scaled(spark, d), _BUCKET, _LEVELS)
    return t.select("depth", "ix", "iy", "n", *(F.round(c, 6).alias(c) for c in ("mx", "my", "w")), "leaf")


@query(with_(TREE, "SELECT t.depth, t.ix, t.iy, list(p.id ORDER BY p.id) AS members FROM tree t JOIN pc_ p USING (depth, ix, iy) WHERE leaf GROUP BY ALL"))
def quadtree_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves with the points they hold; a leaf holds a bucket at most."""
    points = _scaled(spark, d)
    box = embedding.bounding_square(points)
    leaves = embedding.quadtree(points, _BUCKET, _LEVELS).where("leaf").select("depth", "ix", "iy")
    at = lambda c: F.least(F.floor((F.col(c) - (box[f"c{c}"] - box["side"] / 2)) / box["side"] * F.pow(F.lit(2.0), "depth")), F.pow(F.lit(2.0), "depth") - 1).cast("long")
    depths = points.select("id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("depth"))
    own = depths.select("id", "depth", at("x").alias("ix"), at("y").alias("iy"))
    return own.join(leaves, ["depth", "ix", "iy"]).groupBy("depth", "ix", "iy").agg(F.array_sort(F.collect_list("id")).alias("members"))


@query(f"WITH {P2} SELECT round((min(x) + max(x)) * 0.5, 9) AS cx, round((min(y) + max(y)) * 0.5, 9) AS cy, round(greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9), 9) AS side FROM p2")
def bounding_square(spark: SparkSession, d: str) -> DataFrame:
    """Of the points as they are."""
    box = embedding.bounding_square(points_2d(spark, d))
    return spark.createDataFrame([box], "cx double, cy double, side double").select(*(F.round(c, 9).alias(c) for c in ("cx", "cy", "side")))


@query(with_(TREE, "SELECT round(sum(z), 4) AS z FROM bh"))
def bh_z(spark: SparkSession, d: str) -> DataFrame:
    return embedding.barnes_hut(_scaled(spark, d), 0.6, _BUCKET, _LEVELS).agg(F.round(F.sum("z"), 4).alias("z"))


@query(with_(TREE, "SELECT i, round(-4 * sum(fx) / (SELECT sum(z) FROM bh), 8) + 0 AS gx, round(-4 * sum(fy) / (SELECT sum(z) FROM bh), 8) + 0 AS gy FROM bh GROUP BY i"))
def bh_repulsive(spark: SparkSession, d: str) -> DataFrame:
    r = embedding.barnes_hut(_scaled(spark, d), 0.6, _BUCKET, _LEVELS)
    z = r.agg(F.sum("z").alias("total"))
    return r.crossJoin(F.broadcast(z)).select("i", *(tidy(-4 * F.col(f) / F.col("total"), 8).alias(g) for f, g in (("fx", "gx"), ("fy", "gy"))))


def _both_gradients(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The exact repulsion and that by Barnes-Hut."""
    points = _scaled(spark, d)
    r = embedding.barnes_hut(points, 0.6, _BUCKET, _LEVELS)
    z = r.agg(F.sum("z").alias("total"))
    near = r.crossJoin(F.broadcast(z)).select("i", (-4 * F.col("fx") / F.col("total")).alias("gx"), (-4 * F.col("fy") / F.col("total")).alias("gy"))
    return embedding.negative_exact(points), near


@query(with_(f"{TREE}, z AS (SELECT sum(q) AS z FROM (SELECT 1 / (1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS q FROM sc a JOIN sc b ON a.id <> b.id)), ex AS (SELECT a.id AS i, -4 * sum((b.x - a.x) / pow(1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 2)) / any_value(z) AS gx, -4 * sum((b.y - a.y) / pow(1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 2)) / any_value(z) AS gy FROM sc a JOIN sc b ON a.id <> b.id, z GROUP BY a.id), ap AS (SELECT i, -4 * sum(fx) / (SELECT sum(z) FROM bh) AS gx, -4 * sum(fy) / (SELECT sum(z) FROM bh) AS gy FROM bh GROUP BY i)", "SELECT round(avg(sqrt(pow(ex.gx - ap.gx, 2) + pow(ex.gy - ap.gy, 2))) / avg(sqrt(ex.gx * ex.gx + ex.gy * ex.gy)), 4) AS ratio FROM ex JOIN ap USING (i)"))
def gradient_compare(spark: SparkSession, d: str) -> DataFrame:
    """How far the Barnes-Hut gradient is from the exact one."""
    return embedding.compare(*_both_gradients(spark, d)).select(F.round("ratio", 4).alias("ratio"))


@query(with_(f"{TREE}, z AS (SELECT sum(q) AS z FROM (SELECT 1 / (1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS q FROM sc a JOIN sc b ON a.id <> b.id)), ex AS (SELECT a.id AS i, -4 * sum((b.x - a.x) / pow(1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 2)) / any_value(z) AS gx, -4 * sum((b.y - a.y) / pow(1 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 2)) / any_value(z) AS gy FROM sc a JOIN sc b ON a.id <> b.id, z GROUP BY a.id), ap AS (SELECT i, -4 * sum(fx) / (SELECT sum(z) FROM bh) AS gx, -4 * sum(fy) / (SELECT sum(z) FROM bh) AS gy FROM bh GROUP BY i)", "SELECT round(avg(sqrt(pow(ex.gx - ap.gx, 2) + pow(ex.gy - ap.gy, 2))) / avg(sqrt(ap.gx * ap.gx + ap.gy * ap.gy)), 4) AS ratio FROM ex JOIN ap USING (i)"))
def gradient_compare_reversed(spark: SparkSession, d: str) -> DataFrame:
    """The same with the Barnes-Hut gradient as the measure."""
    exact, near = _both_gradients(spark, d)
    return embedding.compare(near, exact).select(F.round("ratio", 4).alias("ratio"))


# ---- interpolation -------------------------------------------------------------------------------------------------

_I, _N = interpolation.INTERVALS, interpolation.NODES
_LAG = lambda c: "CASE k " + " ".join(f"WHEN {k} THEN " + " * ".join(f"({c} - {interpolation.node_positions()[j]})" for j in range(_N) if j != k) + f" / ({interpolation.denominators()[k]!r})" for k in range(_N)) + " END"
FIT = f"""{SCALED}, b AS (SELECT least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM sc),
pl AS (SELECT id, x, y, (x - lo) / (hi - lo) AS gx, (y - lo) / (hi - lo) AS gy FROM sc, b),
pi AS (SELECT *, least(greatest(floor(gx * {_I}), 0), {_I - 1})::INT AS ix, least(greatest(floor(gy * {_I}), 0), {_I - 1})::INT AS iy FROM pl),
rl AS (SELECT *, gx * {_I} - ix AS rx, gy * {_I} - iy AS ry FROM pi),
nw AS (SELECT a.id, a.x, a.y, a.nx, b.ny, a.w * b.w AS weight FROM (SELECT id, x, y, ix * {_N} + k AS nx, {_LAG('rx')} AS w FROM rl, range({_N}) r(k)) a JOIN (SELECT id, iy * {_N} + k AS ny, {_LAG('ry')} AS w FROM rl, range({_N}) r(k)) b USING (id)),
ws AS (SELECT nx, ny, sum(weight) AS w0, sum(weight * x) AS w1, sum(weight * y) AS w2, sum(weight * (x * x + y * y)) AS w3 FROM nw GROUP BY ALL),
hh AS (SELECT (hi - lo) / {_I * _N} AS h FROM b),
vs AS (SELECT a.nx, a.ny, sum(w.w0 * k) AS v0, sum(w.w1 * k) AS v1, sum(w.w2 * k) AS v2, sum(w.w3 * k) AS v3
  FROM (SELECT DISTINCT nx, ny FROM nw) a, ws w, hh, LATERAL (SELECT 1 / pow(1 + pow((a.nx - w.nx) * h, 2) + pow((a.ny - w.ny) * h, 2), 2) AS k) GROUP BY a.nx, a.ny),
po AS (SELECT id, x, y, sum(weight * v0) AS p0, sum(weight * v1) AS p1, sum(weight * v2) AS p2, sum(weight * v3) AS p3 FROM nw JOIN vs USING (nx, ny) GROUP BY id, x, y)"""


# Of the points as they are, so that the grid follows the data.
FIT_RAW = FIT.replace(SCALED, f"{P2}, sc AS (SELECT id, x, y FROM p2)")


@query(f"WITH {FIT_RAW} SELECT round(lo, 9) AS lo, round(hi, 9) AS hi FROM b")
def fit_bounds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([interpolation.bounds(points_2d(spark, d))], "lo double, hi double").select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    points = _scaled(spark, d)
    return interpolation.placed(points, *interpolation.bounds(points))


@query(f"WITH {FIT} SELECT id, round(gx, 6) AS gx, round(gy, 6) AS gy FROM pl")
def fit_rel_grid(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("id", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


@query(f"WITH {FIT} SELECT id, ix, iy FROM pi")
def fit_interval_index(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("id", "ix", "iy")


@query(f"WITH {FIT} SELECT id, round(rx, 6) + 0 AS rx, round(ry, 6) + 0 AS ry FROM rl")
def fit_rel_interval(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("id", tidy(F.col("rx")).alias("rx"), tidy(F.col("ry")).alias("ry"))


@query(f"WITH {FIT_RAW} SELECT a.k::INT AS ix, c.k::INT AS iy, round(lo + a.k * (hi - lo) / {_I}, 6) AS x, round(lo + c.k * (hi - lo) / {_I}, 6) AS y FROM b, range({_I}) a(k), range({_I}) c(k)")
def fit_lower_bounds(spark: SparkSession, d: str) -> DataFrame:
    low, high = interpolation.bounds(points_2d(spark, d))
    return interpolation.lower_bounds(spark, low, high).select("ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {FIT_RAW} SELECT k::INT AS node, round(lo + (k + 0.5) * (hi - lo) / {_I * _N}, 6) AS place FROM b, range({_I * _N}) r(k)")
def fit_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Places of the nodes along an axis."""
    low, high = interpolation.bounds(points_2d(spark, d))
    return spark.range(_I * _N).select(F.col("id").cast("int").alias("node"), F.round(low + (F.col("id") + 0.5) * ((high - low) / (_I * _N)), 6).alias("place"))


_NUM = " ".join(f"WHEN {k} THEN " + " * ".join(f"(rx - {interpolation.node_positions()[j]})" for j in range(_N) if j != k) for k in range(_N))
_DEN = " ".join(f"WHEN {k} THEN {v!r}" for k, v in enumerate(interpolation.denominators()))


@query(f"WITH {FIT} SELECT id, k::INT AS node, round(CASE k {_NUM} END, 6) + 0 AS numerator, CASE k {_DEN} END::DOUBLE AS denominator FROM rl, range({_N}) r(k)")
def lagrange_denominator(spark: SparkSession, d: str) -> DataFrame:
    """Each point's weights along the first axis as fractions: the product over the other nodes for its place, and that for the node itself."""
    weights, by = interpolation.lagrange(F.col("rx")), interpolation.denominators()
    parts = F.array(*(F.struct(F.lit(k).alias("node"), tidy(w * by[k]).alias("numerator"), F.lit(by[k]).alias("denominator")) for k, w in enumerate(weights)))
    return _placed(spark, d).select("id", F.explode(parts).alias("p")).select("id", "p.*")


@query(f"WITH {FIT} SELECT id, nx::INT AS nx, ny::INT AS ny, round(weight, 6) + 0 AS weight FROM nw")
def lagrange_weights(spark: SparkSession, d: str) -> DataFrame:
    points = _scaled(spark, d)
    return interpolation.node_weights(points, *interpolation.bounds(points)).select("id", F.col("nx").cast("int").alias("nx"), F.col("ny").cast("int").alias("ny"), tidy(F.col("weight")).alias("weight"))


@query(f"WITH {SCALED} SELECT id, [1.0::DOUBLE, round(x, 6), round(y, 6), round(x * x + y * y, 6)] AS charges FROM sc")
def fit_charges(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _scaled(spark, d).select("id", F.array(F.lit(1.0), F.round(x, 6), F.round(y, 6), F.round(x * x + y * y, 6)).alias("charges"))


@query(f"WITH {FIT} SELECT nx::INT AS nx, ny::INT AS ny, round(w0, 6) + 0 AS w0, round(w1, 6) + 0 AS w1, round(w2, 6) + 0 AS w2, round(w3, 6) + 0 AS w3 FROM ws")
def fit_w(spark: SparkSession, d: str) -> DataFrame:
    points = _scaled(spark, d)
    w = interpolation.spread(points, *interpolation.bounds(points))
    return w.select(F.col("nx").cast("int").alias("nx"), F.col("ny").cast("int").alias("ny"), *(tidy(F.col(f"w{k}")).alias(f"w{k}") for k in range(4)))


@query(f"WITH {FIT_RAW} SELECT a.k::INT AS ox, c.k::INT AS oy, round(1 / pow(1 + pow(a.k * h, 2) + pow(c.k * h, 2), 2), 6) AS k FROM hh, range({_I * _N}) a(k), range({_I * _N}) c(k)")
def fit_kernel(spark: SparkSession, d: str) -> DataFrame:
    """The kernel by offset, the part that isn't mirrored."""
    low, high = interpolation.bounds(points_2d(spark, d))
    m = _I * _N
    h = (high - low) / m
    offset = spark.range(m * m).select(F.floor(F.col("id") / m).cast("int").alias("ox"), (F.col("id") % m).cast("int").alias("oy"))
    d2 = F.pow(F.col("ox") * h, F.lit(2.0)) + F.pow(F.col("oy") * h, F.lit(2.0))
    return offset.select("ox", "oy", F.round(1 / F.pow(1 + d2, F.lit(2.0)), 6).alias("k"))


@query(f"WITH {FIT} SELECT id, round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2, round(p3, 4) AS p3 FROM po")
def fit_potentials(spark: SparkSession, d: str) -> DataFrame:
    return interpolation.potentials(_scaled(spark, d)).select("id", *(F.round(f"p{k}", 4).alias(f"p{k}") for k in range(4)))


@query(f"WITH {FIT} SELECT id, round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2, round(p3, 4) AS p3 FROM po")
def fit_potentials_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the grid transformed line by line."""
    return interpolation.potentials_by_lines(_scaled(spark, d)).select("id", *(F.round(f"p{k}", 4).alias(f"p{k}") for k in range(4)))


@query(f"WITH {FIT} SELECT round(sum((1 + x * x + y * y) * p0 - 2 * (x * p1 + y * p2) + p3 - 1), 3) AS z FROM po")
def fit_sum_q(spark: SparkSession, d: str) -> DataFrame:
    return interpolation.potentials(_scaled(spark, d)).agg(F.round(F.sum(interpolation.q_sum()), 3).alias("z"))


@query(f"WITH {FIT}, z AS (SELECT sum((1 + x * x + y * y) * p0 - 2 * (x * p1 + y * p2) + p3 - 1) AS z FROM po) SELECT id AS i, round(4 * (x * p0 - p1) / z, 8) + 0 AS gx, round(4 * (y * p0 - p2) / z, 8) + 0 AS gy FROM po, z")
def fit_repulsive(spark: SparkSession, d: str) -> DataFrame:
    g = interpolation.negative_interpolated(_scaled(spark, d), _I)
    return g.select("i", tidy(F.col("gx"), 8).alias("gx"), tidy(F.col("gy"), 8).alias("gy"))


# ---- the grid of the reference: 32 intervals a side, whose direct node sum is slow in SQL ----

_FULL = 32


@query()
def fit_w_32(spark: SparkSession, d: str) -> DataFrame:
    points = _scaled(spark, d)
    w = interpolation.spread(points, *interpolation.bounds(points), _FULL)
    return w.select(F.col("nx").cast("int").alias("nx"), F.col("ny").cast("int").alias("ny"), *(tidy(F.col(f"w{k}")).alias(f"w{k}") for k in range(4)))


@query()
def fit_potentials_32(spark: SparkSession, d: str) -> DataFrame:
    return interpolation.potentials(_scaled(spark, d), _FULL).select("id", *(F.round(f"p{k}", 4).alias(f"p{k}") for k in range(4)))


@query()
def fit_sum_q_32(spark: SparkSession, d: str) -> DataFrame:
    return interpolation.potentials(_scaled(spark, d), _FULL).agg(F.round(F.sum(interpolation.q_sum()), 3).alias("z"))


@query()
def fit_repulsive_32(spark: SparkSession, d: str) -> DataFrame:
    g = interpolation.negative_interpolated(_scaled(spark, d), _FULL)
    return g.select("i", tidy(F.col("gx"), 8).alias("gx"), tidy(F.col("gy"), 8).alias("gy"))
