"""Queries: the given tables in the formats of the sources, written to files and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import binary, formats, matrices
from .inputs import DIMS, P2, VOX, points_2d, voxels
from .registry import query
from .shared import new_path

#: Rows of the table an IDX file.
FILE_ROWS = 256


def _bytes(n: Column, width: int, little: bool = False) -> Column:
    """A number as hexadecimal digits of so many bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2)) if little else digits


@query("SELECT [vec_id::DOUBLE] || embedding::DOUBLE[] AS features FROM embeddings")
def src_csv_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Ids and vectors as a matrix with a header and commas."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    width = len(e.select("embedding").first()[0])
    path = new_path(spark, "files")
    e.select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"c{k}") for k in range(width))).write.csv(path, header=True)
    return matrices.read_matrix(spark, path, width + 1)


@query(f"WITH {P2} SELECT [id::DOUBLE, x, y, NULL] AS features FROM p2")
def src_ssv_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Ids and places parted by blanks, without a header; a column more is read than there is."""
    path = new_path(spark, "files")
    points_2d(spark, d).select("id", "x", "y").write.csv(path, sep=" ")
    return matrices.read_matrix(spark, path, 4, " ", False)


@query("SELECT event_id::DOUBLE AS event_id, value, user_id::DOUBLE AS user_id, NULL::DOUBLE AS event_type FROM events")
def src_csv_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns named by a header; what isn't a number is null."""
    path = new_path(spark, "files")
    spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", "user_id", "event_type").write.csv(path, header=True)
    return matrices.read_columns(spark, path)


_LABELS = """WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, event_type AS label FROM events), k AS (SELECT * FROM l WHERE line % {0} = 0),
c AS (SELECT label, row_number() OVER (ORDER BY min(line)) - 1 AS code FROM k GROUP BY label) SELECT line, label, code::INT AS code FROM k JOIN c USING (label)"""


def _labels(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "files")
    spark.read.parquet(f"{d}/events.parquet").orderBy("event_id").select("event_type").write.text(path)
    return path


@query(_LABELS.format(1))
def src_labels(spark: SparkSession, d: str) -> DataFrame:
    """Event types, one a line in the order of events, numbered by first appearance."""
    return matrices.read_labels(spark, _labels(spark, d))


@query(_LABELS.format(20))
def src_labels_every_20(spark: SparkSession, d: str) -> DataFrame:
    return matrices.read_labels(spark, _labels(spark, d), 20)


#: Bytes of a file that a task reads here, so that files of the small tables are several tasks.
SPLIT = 4096


def _read_back(files: DataFrame, kind: str) -> DataFrame:
    """(path, content) -> files of these names, read as a format: its rows, with path the name without its ending."""
    spark, path = formats.register(files.sparkSession), new_path(files.sparkSession, "files")
    files.write.format("blobs").mode("overwrite").save(path)
    return spark.read.format(kind).option("splitBytes", SPLIT).load(path).withColumn("path", F.regexp_extract("path", r"([^/.]+)[^/]*$", 1))


def _idx(spark: SparkSession, d: str, magic: int, item: Column, sizes: str) -> DataFrame:
    """Rows of embeddings as IDX content, FILE_ROWS ids a file."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / FILE_ROWS).alias("file"), item.alias("item"))
    packed = e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("vec_id", "item"))).alias("rows"))
    head = F.concat(F.lit(f"{magic:08x}"), _bytes(F.size("rows"), 4), F.lit(sizes))
    return packed.select(F.col("file").cast("string").alias("path"), F.unhex(F.concat(head, F.array_join(F.transform("rows", lambda r: r["item"]), ""))).alias("content"))


@query(f"""SELECT (vec_id // {FILE_ROWS})::VARCHAR AS path, row_number() OVER (PARTITION BY vec_id // {FILE_ROWS} ORDER BY vec_id) - 1 AS id, list_transform(embedding, lambda x: round(floor((x::DOUBLE + 1) * 127.5) / 255.0, 5)) AS features FROM embeddings""")
def src_idx_images(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as images of 8 x 8 bytes."""
    pixels = F.array_join(F.transform("embedding", lambda x: _bytes(F.floor((x.cast("double") + 1) * 127.5), 1)), "")
    found = _read_back(_idx(spark, d, binary.IDX_IMAGES, pixels, f"{8:08x}{8:08x}"), "idx")
    return found.select("path", "id", F.transform("features", lambda x: F.round(x.cast("double"), 5)).alias("features"))


@query(f"SELECT (vec_id // {FILE_ROWS})::VARCHAR AS path, row_number() OVER (PARTITION BY vec_id // {FILE_ROWS} ORDER BY vec_id) - 1 AS id, label::INT AS label FROM embeddings")
def src_idx_labels(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_idx(spark, d, binary.IDX_LABELS, _bytes(F.col("label"), 1), ""), "idx")


def _planes(spark: SparkSession, d: str, width: int) -> DataFrame:
    """z, and a plane's voxels as hexadecimal digits, x fastest."""
    v = voxels(spark, d).select("z", "y", "x", F.least(F.col("val"), F.lit(256.0**width - 1)).alias("val"))
    return v.groupBy("z").agg(F.array_sort(F.collect_list(F.struct("y", "x", "val"))).alias("rows")).select("z", F.array_join(F.transform("rows", lambda r: _bytes(r["val"], width, width == 2)), "").alias("voxels"))


@query(f"WITH {VOX} SELECT z::VARCHAR AS path, x, y, 0 AS z, least(val, 65535) AS val FROM vox")
def src_volume_dat(spark: SparkSession, d: str) -> DataFrame:
    """Planes of the volume as files of sixteen-bit voxels."""
    head = "".join(n.to_bytes(2, "little").hex() for n in (DIMS[0], DIMS[1], 1))
    files = _planes(spark, d, 2).select(F.col("z").cast("string").alias("path"), F.unhex(F.concat(F.lit(head), F.col("voxels"))).alias("content"))
    return _read_back(files.withColumn("path", F.concat("path", F.lit(".dat"))), "voxels")


@query(f"WITH {VOX} SELECT z::VARCHAR AS path, x, y, 0 AS z, least(val, 255) AS val FROM vox")
def src_volume_fld(spark: SparkSession, d: str) -> DataFrame:
    """Planes of the volume as files with a text header and bytes."""
    head = f"# planes\nndim=3\ndim1={DIMS[0]}\ndim2={DIMS[1]}\ndim3=1\ndata=byte\n\f\f".encode().hex()
    files = _planes(spark, d, 1).select(F.col("z").cast("string").alias("path"), F.unhex(F.concat(F.lit(head), F.col("voxels"))).alias("content"))
    return _read_back(files.withColumn("path", F.concat("path", F.lit(".fld"))), "voxels")
