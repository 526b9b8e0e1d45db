"""Queries: rays through the volume of line items, transfer functions, shading."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import tidy, with_phong
from ..operators import bricked, transfer, volumes
from ..operators import rays as ops
from ..operators.rays import Camera
from .inputs import DIMS, VOX, voxels
from .neighbours import with_
from .registry import query
from .shared import materialize
from .volumes import _GRAD, _LEAST, TREE, _boxes, _classed, tri_sql

CAMERA = Camera(eye=(24.5, 5.0, -30.0), width=24, height=24)
LOW, HIGH, STEP, ISO = (0.0, 0.0, 0.0), tuple(float(n - 1) for n in DIMS), 0.75, 11.0
_H = math.tan(CAMERA.fovy / 2)

RAYS = f"""ry AS (SELECT px, py, cx / sqrt(cx * cx + cy * cy + 1) AS dx, cy / sqrt(cx * cx + cy * cy + 1) AS dy, 1 / sqrt(cx * cx + cy * cy + 1) AS dz, 24.5::DOUBLE AS ox, 5.0::DOUBLE AS oy, -30.0::DOUBLE AS oz
  FROM (SELECT a.i::INT AS px, b.i::INT AS py, (a.i / 24.0::DOUBLE * 2 - 1) * {_H!r} AS cx, (b.i / 24.0::DOUBLE * 2 - 1) * {_H!r} AS cy FROM range(24) a(i), range(24) b(i))),
bx_ AS (SELECT *, CASE WHEN dx = 0 THEN -1e30 ELSE least(-ox / dx, (49 - ox) / dx) END AS ax, CASE WHEN dx = 0 THEN 1e30 ELSE greatest(-ox / dx, (49 - ox) / dx) END AS bx, CASE WHEN dy = 0 THEN -1e30 ELSE least(-oy / dy, (10 - oy) / dy) END AS ay, CASE WHEN dy = 0 THEN 1e30 ELSE greatest(-oy / dy, (10 - oy) / dy) END AS by_, least(-oz / dz, (8 - oz) / dz) AS az, greatest(-oz / dz, (8 - oz) / dz) AS bz FROM ry),
cp AS (SELECT *, greatest(ax, ay, az) AS tmin, least(bx, by_, bz) AS tmax FROM bx_ WHERE greatest(ax, ay, az) <= least(bx, by_, bz)),
st AS (SELECT px, py, i, t, ox + t * dx AS sx, oy + t * dy AS sy, oz + t * dz AS sz FROM (SELECT *, unnest(range(floor((tmax - tmin) / {STEP})::INT + 1)) AS i FROM cp), LATERAL (SELECT tmin + i * {STEP} AS t))"""
SAMPLED = f"{VOX}, {RAYS}, {tri_sql('st', 'px, py, i')}, sv AS (SELECT px, py, i, t, val FROM smp JOIN st USING (px, py, i)), mx AS (SELECT max(val) AS most FROM vox)"


def _rays(spark: SparkSession) -> DataFrame:
    return ops.rays(spark, CAMERA)


def _clipped(spark: SparkSession) -> DataFrame:
    return ops.clip(_rays(spark), LOW, HIGH)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return ops.samples(_clipped(spark), voxels(spark, d), DIMS, STEP)


def _with_most(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return df.crossJoin(F.broadcast(voxels(spark, d).agg(F.max("val").alias("most"))))


_ORBIT = ops.OrbitCamera((0.0, 0.0, 0.0), 40.0, 0.3, 0.5)
_TURNED = [[f"({row[0]!r}) * cx / q + ({row[1]!r}) * cy / q + ({row[2]!r}) / q" for row in _ORBIT.rotation()]][0]


@query(f"""WITH {VOX}, c AS (SELECT {', '.join(f"sum({a} * val) / sum(val) - 40.0::DOUBLE * ({row[2]!r})::DOUBLE AS o{a}" for a, row in zip("xyz", _ORBIT.rotation(), strict=True))} FROM vox),
l AS (SELECT px, py, cx, cy, sqrt(cx * cx + cy * cy + 1) AS q FROM (SELECT a.i::INT AS px, b.i::INT AS py, (a.i / 24.0::DOUBLE * 2 - 1) * {_H!r} AS cx, (b.i / 24.0::DOUBLE * 2 - 1) * {_H!r} AS cy FROM range(24) a(i), range(24) b(i)))
SELECT px, py, {', '.join(f"round(o{a}, 6) + 0 AS o{a}" for a in "xyz")}, {', '.join(f"round({t}, 6) + 0 AS d{a}" for a, t in zip("xyz", _TURNED, strict=True))} FROM l, c""")
def rays(spark: SparkSession, d: str) -> DataFrame:
    """Rays of a camera that orbits the centre of mass of the volume."""
    v = voxels(spark, d)
    centre = v.agg(*(F.sum(F.col(a) * F.col("val")) / F.sum("val") for a in "xyz")).first()
    orbit = ops.OrbitCamera(tuple(centre), _ORBIT.distance, _ORBIT.pitch, _ORBIT.yaw)
    found = ops.rays(spark, Camera(orbit.eye(), CAMERA.width, CAMERA.height), orbit.rotation())
    return found.select("px", "py", *(tidy(F.col(f"{k}{a}")).alias(f"{k}{a}") for k in "od" for a in "xyz"))


@query(f"WITH {SAMPLED} SELECT px, py, round(min(t), 6) AS tmin, round(max(t), 6) AS tmax, count(*)::BIGINT AS n, sum((val > 0)::INT)::BIGINT AS hit FROM sv GROUP BY px, py")
def ray_aabb(spark: SparkSession, d: str) -> DataFrame:
    """Where rays enter and leave the volume, and how many samples there aren't empty."""
    return _samples(spark, d).groupBy("px", "py").agg(F.round(F.min("t"), 6).alias("tmin"), F.round(F.max("t"), 6).alias("tmax"), F.count(F.lit(1)).alias("n"), F.sum((F.col("val") > 0).cast("long")).alias("hit"))


@query(f"WITH {SAMPLED} SELECT px, py, round(max(val) / any_value(most), 6) AS v FROM sv, mx GROUP BY px, py")
def render_mip(spark: SparkSession, d: str) -> DataFrame:
    s = _with_most(_samples(spark, d), spark, d)
    return ops.mip(s, F.first("most")).withColumn("v", F.round("v", 6))


_SIDE = 6


@query(f"WITH {SAMPLED} SELECT px, py, round(max(val) / any_value(most), 6) AS v FROM sv, mx GROUP BY px, py")
def render_mip_bricks(spark: SparkSession, d: str) -> DataFrame:
    """The picture of render_mip, from bricks that may hold a ray's maximum."""
    v = materialize(voxels(spark, d))
    most = v.agg(F.max("val")).first()[0]
    return bricked.mip(_clipped(spark), v, DIMS, STEP, _SIDE, F.lit(most)).withColumn("v", F.round("v", 6))


@query(f"WITH {SAMPLED} SELECT count(*)::BIGINT AS samples, round(sum(val), 3) AS total FROM sv")
def sample_count(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("val"), 3).alias("total"))


_CROSS = f"{SAMPLED}, lg AS (SELECT *, lag(val) OVER w AS v0, lag(t) OVER w AS t0 FROM sv WINDOW w AS (PARTITION BY px, py ORDER BY i))"


@query(f"WITH {_CROSS} SELECT px, py, round(arg_min(t, i), 6) AS t FROM lg WHERE v0 < {ISO} AND val >= {ISO} GROUP BY px, py")
def render_iso(spark: SparkSession, d: str) -> DataFrame:
    return ops.first_crossing(_samples(spark, d), ISO).select("px", "py", F.round("t1", 6).alias("t"))


@query(f"WITH {_CROSS}, f AS (SELECT px, py, min(i) AS i FROM lg WHERE v0 < {ISO} AND val >= {ISO} OR v0 > {ISO} AND val <= {ISO} GROUP BY px, py) SELECT px, py, round(t0 + ({ISO} - v0) / (val - v0) * (t - t0), 4) AS t FROM lg JOIN f USING (px, py, i)")
def render_iso_bidir(spark: SparkSession, d: str) -> DataFrame:
    """The first crossing either way, placed linearly within its step."""
    h = ops.first_crossing(_samples(spark, d), ISO, rising_only=False)
    return h.select("px", "py", F.round(F.col("t0") + (ISO - F.col("v0")) / (F.col("v1") - F.col("v0")) * (F.col("t1") - F.col("t0")), 4).alias("t"))


_AT = lambda i, j, k: f"vv[1 + floor(sx)::INT + {i} + 50 * (floor(sy)::INT + {j} + 11 * (floor(sz)::INT + {k}))]"
_W = lambda a, c: f"(s{a} - floor(s{a}))" if c else f"(1 - s{a} + floor(s{a}))"
_TRI = " + ".join(f"{_W('x', i)} * {_W('y', j)} * {_W('z', k)} * {_AT(i, j, k)}" for i in (0, 1) for j in (0, 1) for k in (0, 1))


@query(with_(f"""{_CROSS}, fc AS (SELECT px, py, arg_min(t0, i) AS a, arg_min(t, i) AS b FROM lg WHERE v0 < {ISO} AND val >= {ISO} GROUP BY px, py), fl AS (SELECT list(val ORDER BY z, y, x) AS vv FROM vox),
bi(px, py, a, b, t, n) AS (SELECT px, py, a, b, NULL::DOUBLE, 0 FROM fc UNION ALL
SELECT px, py, CASE WHEN t IS NULL AND v <= {ISO} THEN m ELSE a END, CASE WHEN t IS NULL AND v > {ISO} THEN m ELSE b END, CASE WHEN t IS NULL AND abs(v - {ISO}) < 0.01 THEN m ELSE t END, n + 1
FROM (SELECT px, py, a, b, t, n, m, CASE WHEN sx >= 0 AND sx < 49 AND sy >= 0 AND sy < 10 AND sz >= 0 AND sz < 8 THEN {_TRI} ELSE 0 END AS v FROM (SELECT bi.*, (a + b) / 2 AS m, ox + (a + b) / 2 * dx AS sx, oy + (a + b) / 2 * dy AS sy, oz + (a + b) / 2 * dz AS sz FROM bi JOIN ry USING (px, py)), fl WHERE n < 6))""", "SELECT px, py, round(coalesce(t, (a + b) / 2), 4) AS t FROM bi WHERE n = 6"))
def iso_bisection(spark: SparkSession, d: str) -> DataFrame:
    """Crossings made precise by six halvings."""
    clipped, v = _clipped(spark), materialize(voxels(spark, d))
    crossing = materialize(ops.first_crossing(ops.samples(clipped, v, DIMS, STEP), ISO))
    return ops.bisect(crossing, clipped, v, DIMS, ISO, rounds=6).select("px", "py", F.round("t", 4).alias("t"))


@query(f"WITH {VOX}, {RAYS}, pl AS (SELECT px, py, ox + t * dx AS sx, oy + t * dy AS sy, oz + t * dz AS sz FROM cp, LATERAL (SELECT (4.5 - oz) / dz AS t)), {tri_sql('pl', 'px, py')}, mx AS (SELECT max(val) AS most FROM vox) SELECT px, py, round(val / most, 6) + 0 AS v FROM smp, mx")
def render_slice(spark: SparkSession, d: str) -> DataFrame:
    most = voxels(spark, d).agg(F.max("val")).first()[0]
    return ops.slice_plane(_clipped(spark), voxels(spark, d), DIMS, F.lit(most)).withColumn("v", tidy(F.col("v")))


# ---- transfer functions --------------------------------------------------------------------------------------------

_POINTS = "tp(pos, r, g, b, a) AS (VALUES " + ", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in p) + ")" for p in transfer.DEFAULT) + ")"
TABLE = f"""{_POINTS}, sp AS (SELECT *, lead(pos) OVER w AS pos2, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2, lead(a) OVER w AS a2 FROM tp WINDOW w AS (ORDER BY pos)),
tb AS (SELECT i::INT AS bin, r * (1 - f) + r2 * f AS r, g * (1 - f) + g2 * f AS g, b * (1 - f) + b2 * f AS b, a * (1 - f) + a2 * f AS a FROM range(256) q(i) JOIN sp ON (i / 256.0::DOUBLE > pos AND i / 256.0::DOUBLE <= pos2) OR (i = 0 AND pos = 0), LATERAL (SELECT (i / 256.0::DOUBLE - pos) / (pos2 - pos) AS f))"""


def _table(spark: SparkSession) -> DataFrame:
    return transfer.colour_table(transfer.control_points(spark))


@query(f"WITH {VOX}, {TABLE}, u AS (SELECT least(floor(val / (SELECT max(val) FROM vox) * 256), 255)::INT AS bin, count(*)::BIGINT AS n FROM vox GROUP BY 1) SELECT tb.bin, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a, coalesce(n, 0) AS n FROM tb LEFT JOIN u USING (bin)")
def tf_colormap(spark: SparkSession, d: str) -> DataFrame:
    """The colour table, with the number of voxels of each entry."""
    v = _with_most(voxels(spark, d), spark, d).groupBy(ops.transfer_bin(F.col("val"), F.col("most")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _table(spark).join(v, "bin", "left").select("bin", *(F.round(c, 6).alias(c) for c in "rgba"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {VOX}, {TABLE}, m AS (SELECT max(val) AS m FROM vox) SELECT x, y, z, bin, round(r, 6) AS r, round(a, 6) AS a FROM (SELECT x, y, z, least(floor(val / m * 256), 255)::INT AS bin FROM vox, m) JOIN tb USING (bin)")
def tf_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Colours of the voxels."""
    v = _with_most(voxels(spark, d), spark, d).withColumn("bin", ops.transfer_bin(F.col("val"), F.col("most")))
    return v.join(F.broadcast(_table(spark)), "bin").select("x", "y", "z", "bin", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


_SHOWN = f"""{VOX}, {TABLE}, m AS (SELECT max(val) AS m FROM vox), os AS (SELECT bin, sum(a) OVER (ORDER BY bin) AS total, a FROM tb),
rg AS (SELECT x // 4 AS bx, y // 4 AS by_, z // 4 AS bz, least(floor(min(val) / any_value(m) * 256), 255)::INT AS f, least(floor(max(val) / any_value(m) * 256), 255)::INT AS t FROM vox, m GROUP BY ALL)"""


@query(f"WITH {_SHOWN} SELECT bx, by_ AS by, bz, round(h.total - l.total + 1e-7, 4) + 0 AS opacity, h.total - l.total > 1 AS active, (SELECT max(a) FROM tb WHERE bin BETWEEN f AND t) > 0 AS visible FROM rg JOIN os l ON l.bin = f JOIN os h ON h.bin = t")
def brick_active_composite(spark: SparkSession, d: str) -> DataFrame:
    """Bricks by the opacity that the table gives to their range of values."""
    v = voxels(spark, d)
    most = v.agg(F.max("val")).first()[0]
    return transfer.shown(volumes.bricks(v, 4), _table(spark), F.lit(most)).select("bx", "by", "bz", tidy(F.col("opacity") + 1e-7, 4).alias("opacity"), "active", "visible")


@query(with_(f"{TREE}, {TABLE}, m AS (SELECT max(val) AS m FROM vox), va AS (SELECT x, y, z, a FROM (SELECT x, y, z, least(floor(val / m * 256), 255)::INT AS bin FROM vox, m) JOIN tb USING (bin))", "SELECT path, max(a) > 0.01 AS full FROM oc JOIN va ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1 WHERE leaf GROUP BY path"))
def occ_leaf_composite(spark: SparkSession, d: str) -> DataFrame:
    """Leaves with a voxel that the table shows."""
    v = _with_most(voxels(spark, d), spark, d).withColumn("bin", ops.transfer_bin(F.col("val"), F.col("most"))).join(F.broadcast(_table(spark).select("bin", "a")), "bin")
    return volumes.occupied_leaves(_boxes(spark), v, DIMS, _LEAST, F.max("a") > 0.01).select("path", "full")


@query(f"WITH {VOX}, {_POINTS}, p AS (SELECT round(avg(val) / max(val), 6) AS p FROM vox), sp AS (SELECT *, lead(pos) OVER w AS pos2, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2 FROM tp WINDOW w AS (ORDER BY pos)), nw AS (SELECT p AS pos, r * (1 - q) + r2 * q AS r, g * (1 - q) + g2 * q AS g, b * (1 - q) + b2 * q AS b, 0.5::DOUBLE AS a FROM sp, p, LATERAL (SELECT ((pos2 - pos) - p) / (pos2 - pos) AS q) WHERE pos <= p AND pos2 > p) SELECT pos, round(r, 6) + 0 AS r, round(g, 6) + 0 AS g, round(b, 6) + 0 AS b, a FROM (SELECT * FROM tp UNION ALL SELECT * FROM nw)")
def tf_insert(spark: SparkSession, d: str) -> DataFrame:
    """A control point at the mean value."""
    pos = voxels(spark, d).agg(F.round(F.avg("val") / F.max("val"), 6)).first()[0]
    return transfer.insert_point(transfer.control_points(spark), pos, 0.5).select("pos", *(tidy(F.col(c)).alias(c) for c in "rgb"), "a")


_FOLD = f"""{SAMPLED}, {TABLE}, co AS (SELECT px, py, i, r, g, b, a FROM (SELECT px, py, i, least(floor(val / most * 256), 255)::INT AS bin FROM sv, mx) JOIN tb USING (bin)),
tr AS (SELECT *, coalesce(product(1 - a) OVER (PARTITION BY px, py ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS t FROM co)"""


@query(f"WITH {_FOLD} SELECT px, py, round(sum(t * a * r), 6) AS r, round(sum(t * a * g), 6) AS g, round(sum(t * a * b), 6) AS b, round(sum(t * a), 6) AS a FROM tr WHERE t > 0.01 GROUP BY px, py")
def render_composite(spark: SparkSession, d: str) -> DataFrame:
    s = _with_most(_samples(spark, d), spark, d)
    return ops.composite(s, _table(spark), F.col("most")).select("px", "py", *(F.round(c, 6).alias(c) for c in "rgba"))


@query(f"WITH {_FOLD} SELECT px, py, round(sum(t * a * r), 6) AS r, round(sum(t * a * g), 6) AS g, round(sum(t * a * b), 6) AS b, round(sum(t * a), 6) AS a FROM tr WHERE t > 0.01 GROUP BY px, py")
def render_composite_bricks(spark: SparkSession, d: str) -> DataFrame:
    """The picture of render_composite, from bricks of which something shows."""
    v = materialize(voxels(spark, d))
    most = v.agg(F.max("val")).first()[0]
    return bricked.composite(_clipped(spark), v, DIMS, STEP, _SIDE, _table(spark), most).select("px", "py", *(F.round(c, 6).alias(c) for c in "rgba"))


@query(f"WITH {SAMPLED}, im AS (SELECT px, py, round(max(val) / any_value(most), 6) AS v FROM sv, mx GROUP BY px, py) SELECT (a.i + 24 * b.i)::BIGINT AS idx, coalesce(v, 0) AS v FROM range(24) a(i) CROSS JOIN range(24) b(i) LEFT JOIN im ON im.px = a.i AND im.py = b.i")
def framebuffer(spark: SparkSession, d: str) -> DataFrame:
    """The picture as a flat array; rays that miss leave 0."""
    pixels = _rays(spark).select("px", "py")
    image = pixels.join(render_mip(spark, d), ["px", "py"], "left")
    return image.select((F.col("px") + CAMERA.width * F.col("py")).cast("long").alias("idx"), F.coalesce("v", F.lit(0.0)).alias("v"))


_FULL = f"""{_FOLD}, lg AS (SELECT *, lag(val) OVER w AS v0, lag(t) OVER w AS t0 FROM sv WINDOW w AS (PARTITION BY px, py ORDER BY i)),
mi AS (SELECT px, py, max(val) / any_value(most) AS v FROM sv, mx GROUP BY px, py), fi AS (SELECT px, py, 1.0::DOUBLE AS v FROM lg WHERE v0 < {ISO} AND val >= {ISO} GROUP BY px, py),
co2 AS (SELECT px, py, sum(tr.t * a * r) AS r, sum(tr.t * a * g) AS g, sum(tr.t * a * b) AS b, sum(tr.t * a) AS a FROM tr WHERE tr.t > 0.01 GROUP BY px, py),
modes AS (SELECT 'maximum' AS mode, px, py, v AS r, v AS g, v AS b, 1.0::DOUBLE AS a FROM mi UNION ALL SELECT 'surface', px, py, v * 0.8, v * 0.8, v * 0.2, v FROM fi UNION ALL SELECT 'composite', px, py, r, g, b, a FROM co2)"""


@query(f"WITH {_FULL} SELECT m.mode, (a.i + 24 * b.i)::BIGINT AS idx, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in 'rgba')} FROM (VALUES ('maximum'), ('surface'), ('composite')) m(mode) CROSS JOIN range(24) a(i) CROSS JOIN range(24) b(i) LEFT JOIN modes ON modes.mode = m.mode AND px = a.i AND py = b.i")
def render_full(spark: SparkSession, d: str) -> DataFrame:
    """Whole pictures in the three modes, from one set of samples: mode, place in the frame, colour; black where a ray meets nothing."""
    s = materialize(_with_most(_samples(spark, d), spark, d))
    colour = lambda df, mode, r, g, b, a: df.select(F.lit(mode).alias("mode"), "px", "py", *(c.alias(n) for n, c in zip("rgba", (r, g, b, a), strict=True)))
    v, one = F.col("v"), F.lit(1.0)
    modes = colour(ops.mip(s, F.first("most")), "maximum", v, v, v, one)
    modes = modes.unionByName(colour(ops.first_crossing(s, ISO), "surface", F.lit(0.8), F.lit(0.8), F.lit(0.2), one))
    modes = modes.unionByName(colour(ops.composite(s, _table(spark), F.col("most")), "composite", *(F.col(c) for c in "rgba")))
    frame = _rays(spark).select("px", "py", F.explode(F.array(*map(F.lit, ("maximum", "surface", "composite")))).alias("mode"))
    found = frame.join(modes, ["mode", "px", "py"], "left")
    return found.select("mode", (F.col("px") + CAMERA.width * F.col("py")).cast("long").alias("idx"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in "rgba"))


# ---- shading -------------------------------------------------------------------------------------------------------

_COLOUR = [0.8, 0.8, 0.2]
_CPU = {"ambient": 0.1, "diffuse": 0.7, "specular": 0.2, "power": 25}
_GPU = {"ambient": 0.1, "diffuse": 0.6, "specular": 0.5, "power": 32, "tinted": True, "dark": 0.0}


def _phong_sql(m: dict) -> str:
    cos, s = "(nx * lx + ny * ly + nz * lz)", "CASE WHEN (nx * lx + ny * ly + nz * lz) < 0 THEN -1 ELSE 1 END"
    channel = lambda c: f"round(CASE WHEN mag < 1e-6 THEN {m.get('dark', m['ambient'] * c)} ELSE least(greatest({m['ambient'] * c!r} + {m['diffuse'] * c!r} * cs + {m['specular'] * (c if m.get('tinted') else 1.0)!r} * hi, 0), 1) END, 6)"
    return f"""gv AS (SELECT x, y, z, gx, gy, gz, mag, gx / mag AS nx, gy / mag AS ny, gz / mag AS nz, (24.5 - x) / q AS lx, (5.0 - y) / q AS ly, (-30.0 - z) / q AS lz FROM gr, LATERAL (SELECT sqrt(pow(24.5 - x, 2) + pow(5.0 - y, 2) + pow(-30.0 - z, 2)) AS q)),
ph AS (SELECT *, greatest({cos} * ({s}), 0) AS cs, pow(greatest(2 * {cos} * {cos} - (lx * lx + ly * ly + lz * lz), 0), {m['power']}) AS hi FROM gv)
SELECT x, y, z, {channel(0.8)} AS r, {channel(0.2)} AS b FROM ph"""


def _shaded(spark: SparkSession, d: str, model: dict) -> DataFrame:
    g = volumes.gradients(voxels(spark, d))
    to_eye = [F.lit(e) - F.col(a) for a, e in zip("xyz", CAMERA.eye, strict=True)]
    shaded = with_phong(g, _COLOUR, [F.col(f"g{a}") for a in "xyz"], to_eye, to_eye, **model)
    return shaded.select("x", "y", "z", F.round("r", 6).alias("r"), F.round("b", 6).alias("b"))


@query(f"WITH {_GRAD}, {_phong_sql(_CPU)}")
def phong_voxels(spark: SparkSession, d: str) -> DataFrame:
    """All voxels shaded by their gradients, two-sided, with a white highlight."""
    return _shaded(spark, d, _CPU)


@query(f"WITH {_GRAD}, {_phong_sql(_GPU)}")
def phong_gpu(spark: SparkSession, d: str) -> DataFrame:
    """The other set of constants, with a coloured highlight; no gradient is black."""
    return _shaded(spark, d, _GPU)


# ---- boxes along rays ----------------------------------------------------------------------------------------------

_EMIT = f"""{TREE}, em AS (SELECT (row_number() OVER (ORDER BY CASE WHEN front = 0 THEN path ELSE path || '~' END))::BIGINT AS seq, * FROM (SELECT c.path, c.class, c.x0, c.y0, c.z0, c.x1, c.y1, c.z1 FROM cl c LEFT JOIN cl p ON c.path <> '' AND p.path = substr(c.path, 1, length(c.path) - 1) WHERE p.path IS NULL OR p.class <> c.class) CROSS JOIN (VALUES (0), (1)) f(front)),
{RAYS}, ev AS (SELECT px, py, seq, CASE WHEN front = 1 THEN greatest(a, 0) ELSE b END AS t, front AS entry, class FROM (SELECT px, py, seq, front, class,
  greatest(coalesce(least((x0 - ox) / nullif(dx, 0), (x1 - ox) / nullif(dx, 0)), -1e30), coalesce(least((y0 - oy) / nullif(dy, 0), (y1 - oy) / nullif(dy, 0)), -1e30), least((z0 - oz) / dz, (z1 - oz) / dz)) AS a,
  least(coalesce(greatest((x0 - ox) / nullif(dx, 0), (x1 - ox) / nullif(dx, 0)), 1e30), coalesce(greatest((y0 - oy) / nullif(dy, 0), (y1 - oy) / nullif(dy, 0)), 1e30), greatest((z0 - oz) / dz, (z1 - oz) / dz)) AS b FROM ry, em) WHERE b >= greatest(a, 0))"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ops.box_events(_rays(spark), materialize(volumes.emitted(materialize(_classed(spark, d)))), DIMS, _LEAST)


@query(with_(_EMIT, "SELECT px, py, seq, round(t, 6) AS t, entry::INT AS entry, class::INT AS class FROM ev"))
def ray_box_events(spark: SparkSession, d: str) -> DataFrame:
    """Where rays pass the faces of the emitted boxes."""
    return _events(spark, d).withColumn("t", F.round("t", 6))


@query(with_(_EMIT, "SELECT px, py, seq, place::BIGINT AS place, round(t, 6) AS t, round(nx, 6) AS next, entry::INT AS entry, class::INT AS class FROM (SELECT *, lead(t) OVER w AS nx, row_number() OVER w AS place FROM ev WINDOW w AS (PARTITION BY px, py ORDER BY seq DESC))"))
def ray_events_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Each ray's events as a list that grows at its head."""
    return ops.ordered_events(_events(spark, d)).withColumns({"t": F.round("t", 6), "next": F.round("next", 6)})


@query(with_(_EMIT, "SELECT px, py, seq, place::BIGINT AS place, round(t, 6) AS t, round(nx, 6) AS next, entry::INT AS entry FROM (SELECT *, lead(t) OVER w AS nx, row_number() OVER w AS place FROM ev WINDOW w AS (PARTITION BY px, py ORDER BY t, seq))"))
def ray_events_by_t(spark: SparkSession, d: str) -> DataFrame:
    """Each ray's events by distance."""
    return ops.events_by_distance(_events(spark, d)).select("px", "py", "seq", "place", F.round("t", 6).alias("t"), F.round("next", 6).alias("next"), "entry")


@query(with_(f"""{_EMIT}, iv AS (SELECT px, py, least(t, nx) AS t0, greatest(t, nx) AS t1 FROM (SELECT *, lead(t) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY px, py ORDER BY seq DESC)) WHERE entry = 1 AND class = 1 AND nx IS NOT NULL)""",
"SELECT st.px, st.py, i::INT AS i, count(*)::BIGINT AS n FROM st JOIN iv ON st.px = iv.px AND st.py = iv.py AND st.t BETWEEN t0 AND t1 GROUP BY st.px, st.py, i"))
def ray_samples_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each ray that lie in stretches, with the number of these."""
    return ops.samples_in_stretches(ops.along(_clipped(spark), STEP), ops.intervals(_events(spark, d)), 4 * STEP).select("px", "py", "i", "n")


@query(with_(_EMIT, "SELECT px, py, place::BIGINT AS place, round(least(t, nx), 6) AS t0, round(greatest(t, nx), 6) AS t1 FROM (SELECT *, lead(t) OVER w AS nx, row_number() OVER w AS place FROM ev WINDOW w AS (PARTITION BY px, py ORDER BY seq DESC)) WHERE entry = 1 AND class = 1 AND nx IS NOT NULL"))
def ray_intervals(spark: SparkSession, d: str) -> DataFrame:
    return ops.intervals(_events(spark, d)).select("px", "py", "place", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query(f"WITH {VOX}, {RAYS}, h AS (SELECT max(val) AS h FROM vox), q AS (SELECT px, py, ox + t * dx AS x, oy + t * dy AS y, oz + t * dz AS z, h FROM ry, h, LATERAL (SELECT (0 - oz) / dz AS t)) SELECT px, py, x >= -1e-9 AND x <= h + 1e-9 AND y >= -1e-9 AND y <= 10 + 1e-9 AS hit, round(least(greatest(x, 0), h), 6) AS qx, round(least(greatest(y, 0), 10), 6) AS qy FROM q")
def ray_rect(spark: SparkSession, d: str) -> DataFrame:
    """Rays against a rectangle in the plane z = 0, as wide as the largest value."""
    most = voxels(spark, d).agg(F.max("val")).first()[0]
    return ops.hit_rectangle(_rays(spark), (0.0, 0.0, 0.0), (most, 10.0, 0.0), (0.0, 0.0, 1.0)).select("px", "py", "hit", F.round("qx", 6).alias("qx"), F.round("qy", 6).alias("qy"))


@query(f"WITH {VOX}, n AS (SELECT (max(x) + 1.0) / (max(y) + 1.0) AS r FROM vox WHERE val > 0), g2 AS (SELECT a.i::INT AS px, b.i::INT AS py, 2 * r * a.i / 24.0::DOUBLE - r AS x, 2 * b.i / 24.0::DOUBLE - 1 AS y, {-1.0 / _H!r} AS z FROM range(24) a(i), range(24) b(i), n) SELECT px, py, round(x / sqrt(x * x + y * y + z * z), 6) + 0 AS dx, round(y / sqrt(x * x + y * y + z * z), 6) + 0 AS dy, round(z / sqrt(x * x + y * y + z * z), 6) AS dz FROM g2")
def rays_gpu(spark: SparkSession, d: str) -> DataFrame:
    """Directions by field of view and aspect; the picture is as wide for its height as what the volume holds."""
    r = voxels(spark, d).where("val > 0").agg((F.max("x") + 1.0) / (F.max("y") + 1.0)).first()[0]
    camera = Camera(CAMERA.eye, CAMERA.width, CAMERA.height, aspect=float(r))
    return ops.rays_by_aspect(spark, camera).select("px", "py", *(tidy(F.col(c)).alias(c) for c in ("dx", "dy", "dz")))


_IV = f"""{_EMIT}, iv AS (SELECT px, py, place::BIGINT AS place, least(t, nx) AS t0, greatest(t, nx) AS t1 FROM (SELECT *, lead(t) OVER w AS nx, row_number() OVER w AS place FROM ev WINDOW w AS (PARTITION BY px, py ORDER BY seq DESC)) WHERE entry = 1 AND class = 1 AND nx IS NOT NULL),
is_ AS (SELECT px, py, place, i, t, ox + t * dx AS sx, oy + t * dy AS sy, oz + t * dz AS sz FROM (SELECT *, unnest(range(floor((t1 - t0) / {STEP})::INT + 1)) AS i FROM iv) JOIN ry USING (px, py), LATERAL (SELECT t0 + i * {STEP} AS t)),
{tri_sql('is_', 'px, py, place, i')}, lv AS (SELECT s.px, s.py, s.place, s.i, is_.t, s.val, lag(s.val) OVER (PARTITION BY s.px, s.py, s.place ORDER BY s.i) AS v0 FROM smp s JOIN is_ USING (px, py, place, i))"""


@query(with_(_IV, f"SELECT px, py, arg_min(place, (place, i)) AS place, round(arg_min(t, (place, i)), 6) AS t FROM lv WHERE v0 < {ISO} AND val >= {ISO} OR v0 > {ISO} AND val <= {ISO} GROUP BY px, py"))
def ray_intervals_iso(spark: SparkSession, d: str) -> DataFrame:
    """The first stretch between faces in which the surface is met."""
    stretches = ops.intervals(_events(spark, d))
    return ops.first_crossing_in_intervals(stretches, _rays(spark), voxels(spark, d), DIMS, ISO, STEP).select("px", "py", "place", F.round("t", 6).alias("t"))
