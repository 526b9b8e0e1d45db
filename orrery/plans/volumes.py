"""Queries: the volume of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import tidy
from ..operators import quantiles, volumes
from .inputs import DIMS, VOX, voxels
from .neighbours import with_
from .registry import query
from .shared import materialize

_GRAD = f"""{VOX}, ga AS (SELECT x, y, z, (lead(val) OVER (PARTITION BY y, z ORDER BY x) - lag(val) OVER (PARTITION BY y, z ORDER BY x)) / 2 AS gx, (lead(val) OVER (PARTITION BY x, z ORDER BY y) - lag(val) OVER (PARTITION BY x, z ORDER BY y)) / 2 AS gy, (lead(val) OVER (PARTITION BY x, y ORDER BY z) - lag(val) OVER (PARTITION BY x, y ORDER BY z)) / 2 AS gz FROM vox),
gr AS (SELECT x, y, z, CASE WHEN ok THEN gx ELSE 0 END AS gx, CASE WHEN ok THEN gy ELSE 0 END AS gy, CASE WHEN ok THEN gz ELSE 0 END AS gz, CASE WHEN ok THEN sqrt(gx * gx + gy * gy + gz * gz) ELSE 0 END AS mag FROM (SELECT *, gx IS NOT NULL AND gy IS NOT NULL AND gz IS NOT NULL AS ok FROM ga))"""


@query(f"WITH {VOX} SELECT x, y, z, val FROM vox")
def voxel_grid(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d)


@query(f"WITH {VOX} SELECT min(val) AS low, max(val) AS high FROM vox")
def volume_minmax(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).agg(F.min("val").alias("low"), F.max("val").alias("high"))


@query(f"WITH {VOX} SELECT b AS bin, count(vox.val)::BIGINT AS n FROM (SELECT unnest(range(0, (SELECT max(val)::BIGINT + 1 FROM vox))) AS b) LEFT JOIN vox ON trunc(val)::BIGINT = b GROUP BY b")
def volume_histogram(spark: SparkSession, d: str) -> DataFrame:
    return volumes.histogram(voxels(spark, d))


_AT = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(f"WITH {VOX}, p AS (SELECT z, unnest({_AT}) AS q, unnest(quantile_cont(val, {_AT})) AS exact FROM vox GROUP BY z) SELECT z, q::DOUBLE AS q, round(exact, 6) AS exact, true AS close FROM p")
def voxel_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of each plane of the volume, and whether a sketch's are within its bound of these."""
    return quantiles.with_exact(voxels(spark, d), ["z"], "val", _AT).withColumn("exact", F.round("exact", 6))


@query(f"WITH {VOX}, h AS (SELECT trunc(val)::BIGINT AS bin, count(*) AS n FROM vox GROUP BY 1), m AS (SELECT max(n) AS m FROM h) SELECT bin, count(*)::BIGINT AS lit FROM h, m, range(64) r(y) WHERE (64 - y) < n * 64 / (1.1 * m) GROUP BY bin")
def histogram_raster(spark: SparkSession, d: str) -> DataFrame:
    """Lit pixels of each bar of a picture 64 pixels high."""
    h = volumes.histogram(voxels(spark, d))
    top = h.agg(F.max("n").alias("m"))
    rows = h.crossJoin(F.broadcast(top)).select("bin", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y"))
    return rows.where((64 - F.col("y")) < F.col("n") * 64 / (1.1 * F.col("m"))).groupBy("bin").agg(F.count(F.lit(1)).alias("lit"))


@query(f"WITH {VOX} SELECT (x + 50 * (y + 11 * z))::BIGINT AS idx, val FROM vox", name="voxel_lookup")
@query(f"WITH {VOX} SELECT (x + 50 * (y + 11 * z))::BIGINT AS idx, val FROM vox")
def voxel_lookup_whole(spark: SparkSession, d: str) -> DataFrame:
    """All voxels by their place in a flat array."""
    v = voxels(spark, d)
    flat = v.select((F.col("x") + DIMS[0] * (F.col("y") + DIMS[1] * F.col("z"))).cast("long").alias("idx"), "val")
    return flat.select("idx").join(flat, "idx")


@query(f"WITH {_GRAD} SELECT x, y, z, gx, gy, gz, round(mag, 6) AS mag FROM gr")
def gradient_volume(spark: SparkSession, d: str) -> DataFrame:
    return volumes.gradients(voxels(spark, d)).withColumn("mag", F.round("mag", 6))


@query(f"WITH {VOX}, g2 AS (SELECT x, y, z, coalesce(lead(val) OVER a, val) - coalesce(lag(val) OVER a, val) AS gx, coalesce(lead(val) OVER b, val) - coalesce(lag(val) OVER b, val) AS gy, coalesce(lead(val) OVER c, val) - coalesce(lag(val) OVER c, val) AS gz FROM vox WINDOW a AS (PARTITION BY y, z ORDER BY x), b AS (PARTITION BY x, z ORDER BY y), c AS (PARTITION BY x, y ORDER BY z)) SELECT x, y, z, gx, gy, gz, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS mag FROM g2")
def gradient_clamped(spark: SparkSession, d: str) -> DataFrame:
    return volumes.gradients(voxels(spark, d), clamped=True).withColumn("mag", F.round("mag", 6))


@query(f"WITH {_GRAD} SELECT round(min(mag), 6) AS low, round(max(mag), 6) AS high FROM gr")
def gradient_minmax(spark: SparkSession, d: str) -> DataFrame:
    return volumes.gradients(voxels(spark, d)).agg(F.round(F.min("mag"), 6).alias("low"), F.round(F.max("mag"), 6).alias("high"))


# Sampling places: one for each order, spread over the volume and a little beyond.
PLACES = "pl AS (SELECT o_orderkey AS a, (o_orderkey * 37 % 5200) / 100.0::DOUBLE - 1 AS sx, (o_custkey * 53 % 1200) / 100.0::DOUBLE - 0.5 AS sy, (o_orderkey * 29 % 1000) / 100.0::DOUBLE - 0.5 AS sz FROM orders)"
KEY = ["a"]


def _places(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, m, k, off: (F.col(c) * m % k) / 100.0 - off
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("a"), at("o_orderkey", 37, 5200, 1.0).alias("sx"), at("o_custkey", 53, 1200, 0.5).alias("sy"), at("o_orderkey", 29, 1000, 0.5).alias("sz"))


def tri_sql(points: str, key: str, table: str = "vox", values: tuple[str, ...] = ("val",)) -> str:
    """Common table expression smp: points with values between the eight voxels around."""
    sums = ", ".join(f"coalesce(sum(w * v.{c}), 0) AS {c}" for c in values)
    return f"""crn AS (SELECT p.*, floor(sx)::INT + ci AS x, floor(sy)::INT + cj AS y, floor(sz)::INT + ck AS z, (CASE WHEN ci = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE WHEN cj = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN ck = 1 THEN sz - floor(sz) ELSE 1 - sz + floor(sz) END) AS w
  FROM {points} p, range(2) r(ci), range(2) s(cj), range(2) q(ck)),
smp AS (SELECT {key}, {sums} FROM crn c LEFT JOIN {table} v ON v.x = c.x AND v.y = c.y AND v.z = c.z AND sx >= 0 AND sx < 49 AND sy >= 0 AND sy < 10 AND sz >= 0 AND sz < 8 GROUP BY {key})"""


@query(f"WITH {VOX}, {PLACES}, {tri_sql('pl', 'a')} SELECT a, round(val, 8) + 0 AS val FROM smp")
def sample_trilinear(spark: SparkSession, d: str) -> DataFrame:
    return volumes.trilinear(_places(spark, d), voxels(spark, d), DIMS, KEY).withColumn("val", tidy(F.col("val"), 8))


@query(f"""WITH {VOX}, {PLACES}, cr AS (SELECT a, least(greatest(floor(sx - 0.5)::INT + i, 0), 49) AS x, least(greatest(floor(sy - 0.5)::INT + j, 0), 10) AS y, least(greatest(floor(sz - 0.5)::INT + k, 0), 8) AS z,
 (CASE WHEN i = 1 THEN sx - 0.5 - floor(sx - 0.5) ELSE 1 - (sx - 0.5) + floor(sx - 0.5) END) * (CASE WHEN j = 1 THEN sy - 0.5 - floor(sy - 0.5) ELSE 1 - (sy - 0.5) + floor(sy - 0.5) END) * (CASE WHEN k = 1 THEN sz - 0.5 - floor(sz - 0.5) ELSE 1 - (sz - 0.5) + floor(sz - 0.5) END) AS w,
 sx BETWEEN 0 AND 50 AND sy BETWEEN 0 AND 11 AND sz BETWEEN 0 AND 9 AS ok FROM pl, range(2) r(i), range(2) s(j), range(2) t(k))
SELECT a, round(sum(CASE WHEN ok THEN w * val ELSE 0 END), 8) + 0 AS val FROM cr JOIN vox USING (x, y, z) GROUP BY a""")
def sample_trilinear_gpu(spark: SparkSession, d: str) -> DataFrame:
    """With voxel centres at one half and the border going on outwards."""
    return volumes.trilinear(_places(spark, d), voxels(spark, d), DIMS, KEY, half_voxel=True).withColumn("val", tidy(F.col("val"), 8))


@query(f"WITH {VOX}, {PLACES} SELECT a, coalesce(val, 0) AS val FROM pl LEFT JOIN vox ON x = floor(sx + 0.5) AND y = floor(sy + 0.5) AND z = floor(sz + 0.5)")
def sample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return volumes.nearest(_places(spark, d), voxels(spark, d), DIMS, KEY)


@query(f"WITH {_GRAD}, {PLACES} SELECT a, gx, gy, gz FROM (SELECT a, coalesce(gx, 0) AS gx, coalesce(gy, 0) AS gy, coalesce(gz, 0) AS gz FROM pl LEFT JOIN gr ON x = floor(sx + 0.5) AND y = floor(sy + 0.5) AND z = floor(sz + 0.5))")
def grad_nearest(spark: SparkSession, d: str) -> DataFrame:
    return volumes.nearest(_places(spark, d), volumes.gradients(voxels(spark, d)), DIMS, KEY, ["gx", "gy", "gz"])


@query(f"WITH {_GRAD}, {PLACES}, {tri_sql('pl', 'a', 'gr', ('gx', 'gy', 'gz'))} SELECT a, round(gx, 8) + 0 AS gx, round(gy, 8) + 0 AS gy, round(gz, 8) + 0 AS gz, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS mag FROM smp")
def grad_trilinear(spark: SparkSession, d: str) -> DataFrame:
    g = volumes.trilinear(_places(spark, d), volumes.gradients(voxels(spark, d)), DIMS, KEY, ["gx", "gy", "gz"])
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    return g.select(*KEY, *(tidy(F.col(c), 8).alias(c) for c in ("gx", "gy", "gz")), F.round(length, 6).alias("mag"))


@query(f"WITH {_GRAD} SELECT x, y, z, gx, gy, gz FROM gr WHERE mag > 2")
def grad_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Gradients of the voxels where they are steep."""
    g = volumes.gradients(voxels(spark, d))
    steep = g.where("mag > 2").select("x", "y", "z")
    return steep.join(g.drop("mag"), ["x", "y", "z"])


@query(f"""WITH {VOX}, {PLACES}, p AS (SELECT a, sx, sy, 4 AS z FROM pl WHERE sx >= 0 AND sx < 49 AND sy >= 0 AND sy < 10),
c AS (SELECT p.a, floor(sx)::INT + i AS x, floor(sy)::INT + j AS y, z, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) AS w FROM p, range(2) r(i), range(2) s(j))
SELECT a, round(sum(w * val), 8) + 0 AS val FROM c JOIN vox USING (x, y, z) GROUP BY a""")
def sample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    plane = _places(spark, d).where("sx >= 0 AND sx < 49 AND sy >= 0 AND sy < 10").withColumn("z", F.lit(4))
    return volumes.bilinear(plane, voxels(spark, d), KEY).withColumn("val", tidy(F.col("val"), 8))


# ---- bricks --------------------------------------------------------------------------------------------------------

_SIZE = 4
BRICKS = f"{VOX}, br AS (SELECT x // {_SIZE} AS bx, y // {_SIZE} AS by_, z // {_SIZE} AS bz, min(val) AS low, max(val) AS high FROM vox GROUP BY ALL), ac AS (SELECT *, high - low > 4 AS active FROM br)"


@query(f"WITH {BRICKS} SELECT bx, by_ AS by, bz, low, high FROM br")
def brick_minmax(spark: SparkSession, d: str) -> DataFrame:
    return volumes.bricks(voxels(spark, d), _SIZE)


def _active(spark: SparkSession, d: str) -> DataFrame:
    return volumes.active(volumes.bricks(voxels(spark, d), _SIZE), 4.0)


@query(f"WITH {BRICKS} SELECT bx, by_ AS by, bz, active FROM ac")
def brick_active(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).select("bx", "by", "bz", "active")


_SLOT = f"{BRICKS}, sl AS (SELECT bx, by_, bz, (row_number() OVER (ORDER BY bz, by_, bx) - 1)::INT AS slot FROM ac WHERE active)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    ranges = _active(spark, d)
    return volumes.brick_index(ranges, volumes.pack_dims(ranges.where("active").count(), 16))


@query(f"WITH {_SLOT} SELECT ac.bx, ac.by_ AS by, ac.bz, coalesce(slot, -1) AS slot FROM ac LEFT JOIN sl USING (bx, by_, bz)")
def brick_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("bx", "by", "bz", "slot")


@query(f"WITH {BRICKS}, n AS (SELECT count(*) AS n FROM ac WHERE active), c AS (SELECT x, y, z, n FROM range(1, 16) a(x), range(1, 16) b(y), range(1, 16) c(z), n WHERE n > 16 AND x * y * z >= n UNION ALL SELECT n, 1, 1, n FROM n WHERE n <= 16) SELECT x::INT AS nx, y::INT AS ny, z::INT AS nz FROM c ORDER BY x * y * z, z, y, x LIMIT 1")
def pack_dims(spark: SparkSession, d: str) -> DataFrame:
    dims = volumes.pack_dims(_active(spark, d).where("active").count(), 16)
    return spark.createDataFrame([dims], "nx int, ny int, nz int")


@query(f"WITH {_SLOT} SELECT slot, dx::INT AS dx, dy::INT AS dy, dz::INT AS dz, coalesce(val, 0) AS val FROM sl CROSS JOIN range(6) a(dx) CROSS JOIN range(6) b(dy) CROSS JOIN range(6) c(dz) LEFT JOIN vox ON x = bx * {_SIZE} + dx AND y = by_ * {_SIZE} + dy AND z = bz * {_SIZE} + dz")
def brick_cache(spark: SparkSession, d: str) -> DataFrame:
    return volumes.brick_cache(_index(spark, d), voxels(spark, d), _SIZE)


# ---- octree --------------------------------------------------------------------------------------------------------

_LEAST = 2
# The value whose surface the octree is for: rare enough that boxes differ in class, whatever the size of the table.
ISO_SQL = "iso AS (SELECT floor(avg(val) + 2.2 * stddev_pop(val)) + 0.5 AS iso FROM vox)"
TREE = f"""{VOX}, {ISO_SQL}, oc(path, depth, x0, y0, z0, x1, y1, z1, leaf) AS (SELECT '', 0, 0, 0, 0, 50, 11, 9, false
 UNION ALL SELECT path || k::VARCHAR, depth + 1, nx0, ny0, nz0, nx1, ny1, nz1, nx1 - nx0 <= {_LEAST} OR ny1 - ny0 <= {_LEAST} OR nz1 - nz0 <= {_LEAST} FROM
 (SELECT path, depth, k, CASE WHEN k & 1 = 1 THEN (x0 + x1) // 2 ELSE x0 END AS nx0, CASE WHEN k & 1 = 1 THEN x1 ELSE (x0 + x1) // 2 END AS nx1, CASE WHEN k & 2 = 2 THEN (y0 + y1) // 2 ELSE y0 END AS ny0, CASE WHEN k & 2 = 2 THEN y1 ELSE (y0 + y1) // 2 END AS ny1,
  CASE WHEN k & 4 = 4 THEN (z0 + z1) // 2 ELSE z0 END AS nz0, CASE WHEN k & 4 = 4 THEN z1 ELSE (z0 + z1) // 2 END AS nz1 FROM oc, range(8) r(k) WHERE NOT leaf)),
lf AS (SELECT path, min(val) <= any_value(iso) AND max(val) >= any_value(iso) AS full_ FROM oc JOIN vox ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1, iso WHERE leaf GROUP BY path),
cl AS (SELECT oc.*, n_empty, n_full, CASE WHEN n_empty > n_full THEN 0 ELSE 1 END AS class FROM oc JOIN (SELECT o.path, count(*) FILTER (NOT full_) AS n_empty, count(*) FILTER (full_) AS n_full FROM oc o JOIN lf ON starts_with(lf.path, o.path) GROUP BY o.path) USING (path))"""


def _boxes(spark: SparkSession) -> DataFrame:
    return volumes.octree(spark, DIMS, _LEAST)


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    v = materialize(voxels(spark, d))
    iso = v.agg(F.floor(F.avg("val") + 2.2 * F.stddev_pop("val")) + 0.5).first()[0]
    return volumes.occupied_leaves(_boxes(spark), v, DIMS, _LEAST, (F.min("val") <= iso) & (F.max("val") >= iso))


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return volumes.occupancy(_boxes(spark), _leaves(spark, d))


@query(with_(TREE, "SELECT path, depth::INT AS depth, x0::INT AS x0, y0::INT AS y0, z0::INT AS z0, x1::INT AS x1, y1::INT AS y1, z1::INT AS z1, leaf, count(val)::BIGINT AS n, sum(val) AS total FROM oc JOIN vox ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1 GROUP BY ALL"))
def octree_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with the number and sum of their voxels: those of the leaves, rolled up."""
    leaves = voxels(spark, d).groupBy(volumes.leaf_path(DIMS, _LEAST).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))
    rolled = leaves.select(F.explode(volumes.prefixes(F.col("path"))).alias("path"), "n", "total").groupBy("path").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return _boxes(spark).join(rolled, "path")


@query(with_(TREE, "SELECT path, full_ AS full FROM lf"))
def occ_leaf(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that the surface of a value may cross."""
    return _leaves(spark, d).select("path", "full")


@query(with_(TREE, "SELECT path, n_empty::BIGINT AS n_empty, n_full::BIGINT AS n_full FROM cl"))
def occ_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _classed(spark, d).select("path", "n_empty", "n_full")


@query(with_(TREE, "SELECT path, class::INT AS class FROM cl"))
def occ_class(spark: SparkSession, d: str) -> DataFrame:
    return _classed(spark, d).select("path", "class")


@query(with_(TREE, "SELECT path, (row_number() OVER (PARTITION BY substr(path, 1, length(path) - 1) ORDER BY pow((x0 + x1) / 2.0 - 10, 2) + pow((y0 + y1) / 2.0 - 20, 2) + pow((z0 + z1) / 2.0 - 30, 2) DESC, path))::BIGINT AS place, n_empty::BIGINT AS n_empty, n_full::BIGINT AS n_full, class::INT AS class FROM cl WHERE path <> ''"))
def occ_sort(spark: SparkSession, d: str) -> DataFrame:
    """Of each box, all eight children with what they hold, the farthest from an eye first, full or not."""
    centre = lambda a: (F.col(f"{a}0") + F.col(f"{a}1")) / 2.0
    far = F.pow(centre("x") - 10, 2) + F.pow(centre("y") - 20, 2) + F.pow(centre("z") - 30, 2)
    boxes = _classed(spark, d).where("path <> ''").withColumn("parent", F.expr("substr(path, 1, length(path) - 1)"))
    return boxes.select("path", F.row_number().over(Window.partitionBy("parent").orderBy(far.desc(), "path")).cast("long").alias("place"), "n_empty", "n_full", "class")


@query(with_(TREE, """SELECT (row_number() OVER (ORDER BY CASE WHEN front = 0 THEN path ELSE path || '~' END))::BIGINT AS seq, path, front::INT AS front, class::INT AS class
FROM (SELECT c.path, c.class FROM cl c LEFT JOIN cl p ON c.path <> '' AND p.path = substr(c.path, 1, length(c.path) - 1) WHERE p.path IS NULL OR p.class <> c.class) CROSS JOIN (VALUES (0), (1)) f(front)"""))
def octree_emit(spark: SparkSession, d: str) -> DataFrame:
    return volumes.emitted(materialize(_classed(spark, d))).select("seq", "path", "front", "class")


@query(with_(TREE, """SELECT path, e::INT AS edge, (CASE WHEN a = 0 THEN x0 WHEN a = 1 THEN CASE WHEN u = 0 THEN x0 ELSE x1 END ELSE CASE WHEN u = 0 THEN x0 ELSE x1 END END)::INT AS ax,
(CASE WHEN a = 1 THEN y0 WHEN a = 0 THEN CASE WHEN u = 0 THEN y0 ELSE y1 END ELSE CASE WHEN w = 0 THEN y0 ELSE y1 END END)::INT AS ay, (CASE WHEN a = 2 THEN z0 ELSE CASE WHEN w = 0 THEN z0 ELSE z1 END END)::INT AS az,
(CASE WHEN a = 0 THEN x1 ELSE CASE WHEN u = 0 THEN x0 ELSE x1 END END)::INT AS bx, (CASE WHEN a = 1 THEN y1 WHEN a = 0 THEN CASE WHEN u = 0 THEN y0 ELSE y1 END ELSE CASE WHEN w = 0 THEN y0 ELSE y1 END END)::INT AS "by", (CASE WHEN a = 2 THEN z1 ELSE CASE WHEN w = 0 THEN z0 ELSE z1 END END)::INT AS bz
FROM (SELECT c.*, e, e // 4 AS a, e & 1 AS u, (e >> 1) & 1 AS w FROM cl c LEFT JOIN cl p ON c.path <> '' AND p.path = substr(c.path, 1, length(c.path) - 1) CROSS JOIN range(12) r(e) WHERE p.path IS NULL OR p.class <> c.class)"""))
def box_edges(spark: SparkSession, d: str) -> DataFrame:
    """The twelve edges of each emitted box, with their end points a and b: four along each axis."""
    return volumes.edges(volumes.emitted(materialize(_classed(spark, d))).where("front = 0"))
