"""Queries: nearest neighbours, affinities and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import tidy
from ..operators import affinity, descent, embedding, neighbours, regions
from .inputs import BETA, HD, K, KNN, P2, PCOND, PERPLEXITY, PMAT, PSYM, orders_3d, points_2d, points_hd, vectors
from .registry import query
from .shared import discard, materialize

with_ = lambda ctes, select: f"WITH RECURSIVE {ctes} {select}"


def _knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn(vectors(spark, d), K)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return affinity.conditional(_knn(spark, d), PERPLEXITY)


@query(with_(KNN, "SELECT i, rank, j, round(d2, 6) AS d2 FROM knn"))
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d).withColumn("d2", tidy(F.col("d2")))


@query()
def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within the nearest cells. The given vectors hardly cluster, so that three cells of four are looked at for nine neighbours of ten."""
    return neighbours.knn_cells(vectors(spark, d), K, 64, 48).withColumn("d2", tidy(F.col("d2")))


@query()
def knn_descent(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by descent on a graph."""
    return descent.knn_descent(points_hd(spark, d), K)[0].withColumn("d2", tidy(F.col("d2")))


@query()
def order_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten orders most alike in price, date and customer, exactly, by regions."""
    return regions.knn_regions(orders_3d(spark, d), 10).withColumn("d2", tidy(F.col("d2"), 9))


@query(with_(KNN, "SELECT i, list(j ORDER BY rank) AS js FROM knn GROUP BY i"))
def knn_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours as a list a row, sorted by distance."""
    near = _knn(spark, d).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j"))).alias("near"))
    return near.select("i", F.transform("near", lambda x: x["j"]).alias("js"))


_EVAL = f"""{HD}, dist AS (SELECT a.id AS i, b.id AS j, pow(list_distance(a.v, b.v), 2) AS d2 FROM pts a JOIN pts b ON a.id <> b.id),
hi AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM dist WHERE d2 > 0) WHERE rank <= 30)"""


@query(with_(_EVAL, "SELECT i, rank, j FROM hi"))
def knn_eval(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn(vectors(spark, d), 30, ties="low", skip_equal=True).drop("d2")


@query(with_(f"""{_EVAL}, {P2}, d2 AS (SELECT a.id AS i, b.id AS j, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM p2 a JOIN p2 b ON a.id <> b.id),
lo AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM d2 WHERE d2 > 0) WHERE rank <= 30)""", "SELECT round(count(lo.j) / 30.0 / count(DISTINCT hi.i), 6) AS accuracy FROM hi LEFT JOIN lo USING (i, j)"))
def neighbourhood_preservation(spark: SparkSession, d: str) -> DataFrame:
    """How much of the neighbourhoods the first two coordinates keep."""
    high = neighbours.knn(vectors(spark, d), 30, ties="low", skip_equal=True)
    low = neighbours.knn(points_2d(spark, d).select("id", F.array("x", "y").alias("v")), 30, ties="low", skip_equal=True)
    return neighbours.overlap(high, low, 30).select(F.round("accuracy", 6).alias("accuracy"))


@query(with_(BETA, "SELECT i, round(beta, 4) AS beta FROM beta"))
def perplexity_beta(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d).where("rank = 1").select("i", F.round("beta", 4).alias("beta"))


@query(with_(PCOND, "SELECT i, rank, j, round(p, 6) AS p FROM pc"))
def p_conditional(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d).select("i", "rank", "j", tidy(F.col("p")).alias("p"))


@query(with_(PSYM, "SELECT i, rank, j, round(p, 6) AS p FROM ps"))
def p_symmetrized(spark: SparkSession, d: str) -> DataFrame:
    return affinity.symmetrized(materialize(_p(spark, d))).withColumn("p", tidy(F.col("p")))


@query(with_(PMAT, "SELECT i, rank, j, round(p, 8) AS p FROM pm"))
def p_normalized(spark: SparkSession, d: str) -> DataFrame:
    return p_matrix_of(spark, d).withColumn("p", tidy(F.col("p"), 8))


def p_matrix_of(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours, calibration, symmetry and normalisation: (i, rank, j, p). What is read more than once is a table, so that neighbours are searched for once."""
    conditional = materialize(_p(spark, d))
    symmetric = materialize(affinity.symmetrized(conditional))
    discard(conditional)
    return affinity.normalized(symmetric)


@query(with_(PMAT, "SELECT i, count(*)::BIGINT AS n, round(sum(p), 8) AS total, arg_max(j, struct_pack(p := p, j := j)) AS strongest FROM pm GROUP BY i"))
def p_matrix(spark: SparkSession, d: str) -> DataFrame:
    return p_matrix_of(spark, d).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 8).alias("total"), F.max_by("j", F.struct("p", "j")).alias("strongest"))


@query(with_(PMAT, "SELECT i, list(round(coalesce(p, 0), 6) ORDER BY j) AS row FROM (SELECT a.i, b.j, pm.p FROM range(100) a(i) CROSS JOIN range(100) b(j) LEFT JOIN pm ON pm.i = a.i AND pm.j = b.j) GROUP BY i"))
def p_dense_100(spark: SparkSession, d: str) -> DataFrame:
    """The leading 100 x 100 part of the matrix, dense."""
    p = p_matrix_of(spark, d).where("i < 100 AND j < 100").groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "p"))).alias("m"))
    ids = spark.range(100).select(F.col("id").alias("i"))
    cell = lambda j: F.round(F.coalesce(F.try_element_at("m", j), F.lit(0.0)), 6)
    return ids.join(p, "i", "left").select("i", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long")), cell).alias("row"))


@query(with_(PMAT, """SELECT e.vec_id AS id, e.label, c.code, s.u / 2147483648.0::DOUBLE AS x, ((s.u * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS y, q.n, q.strongest FROM embeddings e
JOIN (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS code FROM embeddings GROUP BY label) c USING (label)
JOIN (SELECT vec_id, (vec_id % 2147483648 * 1103515245 + 12345) % 2147483648 AS u FROM embeddings) s USING (vec_id)
JOIN (SELECT i, count(*)::BIGINT AS n, arg_max(j, struct_pack(p := p, j := j)) AS strongest FROM pm GROUP BY i) q ON q.i = e.vec_id"""))
def tsne_dataset(spark: SparkSession, d: str) -> DataFrame:
    """From the table to what the optimiser starts with: labels with their codes, neighbours and affinities of each point, and its start."""
    labelled = encode_labels(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label"), "id", "label")
    start = embedding.random_start(points_2d(spark, d).select("id"))
    near = p_matrix_of(spark, d).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max_by("j", F.struct("p", "j")).alias("strongest"))
    return labelled.join(start, "id").join(near, F.col("id") == F.col("i")).select("id", "label", "code", "x", "y", "n", "strongest")


@query("""WITH f AS (SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::BIGINT AS code FROM events GROUP BY event_type)
SELECT event_id, code FROM events JOIN f USING (event_type)""")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    """Labels as numbers in the order of first appearance."""
    return encode_labels(spark.read.parquet(f"{d}/events.parquet"), "event_id", "event_type").select("event_id", "code")


def encode_labels(df: DataFrame, order: str, label: str) -> DataFrame:
    """Adds code: 0 for the label that appears first, and so on. The dictionary has a row a label."""
    firsts = df.groupBy(label).agg(F.min(order).alias("first"))
    codes = firsts.select(label, (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("code"))
    return df.join(codes, label)


@query("SELECT event_id, event_type FROM events WHERE event_id % 20 = 0")
def sample_every_k(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").where("event_id % 20 = 0").select("event_id", "event_type")


@query("SELECT vec_id, label, label % 20 AS slot, 'hsl(' || ((label % 20) * 18)::VARCHAR || ',70%,50%)' AS colour FROM embeddings")
def label_palette(spark: SparkSession, d: str) -> DataFrame:
    """A colour of a wheel of 20 for each label."""
    slot = F.pmod("label", F.lit(20))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", slot.alias("slot"), F.concat(F.lit("hsl("), (slot * 18).cast("string"), F.lit(",70%,50%)")).alias("colour"))
