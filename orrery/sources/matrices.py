"""Text matrices and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import materialize, numbered


def read_matrix(spark: SparkSession, path: str, columns: int, sep: str = ",", header: bool = True) -> DataFrame:
    """features array<double>, a row a line. A cell that is no number is null. Short lines are padded with nulls, further cells ignored."""
    schema = ", ".join(f"c{k} string" for k in range(columns))
    rows = spark.read.csv(path, sep=sep, header=header, schema=schema, enforceSchema=True, mode="PERMISSIVE")
    return rows.select(F.array(*(F.expr(f"try_cast(trim(c{k}) AS double)") for k in range(columns))).alias("features"))


def read_columns(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Columns named by the header, all double; cells that are no numbers are null."""
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="PERMISSIVE")
    return rows.select(*(F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c) for c in rows.columns))


def read_labels(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """line, label, code: one label a line, numbered by first appearance; every k-th line only. Several files count on in the order of their names."""
    text = spark.read.text(path)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    # a table, so that the numbers of one scan are the ones that are counted
    lines = materialize(text.select(block, F.monotonically_increasing_id().alias("at"), F.trim("value").alias("label")))
    lines = numbered(lines, "block", ["at"], "line").where(F.col("line") % every == 0).select("line", "label")
    firsts = lines.groupBy("label").agg(F.min("line").alias("first"))
    codes = firsts.select("label", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("code"))  # a row a label
    return lines.join(codes, "label").select("line", "label", "code")
