"""Tables on the way: cutting lineage between rounds, numbering rows in order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, kind: str = "tables") -> str:
    """A path in the shared folder that nothing stands at."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. orrery.llm has a function of its own for this, as neither imports the other."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tables/" in f.rsplit("/", 1)[0]}


def discard(df: DataFrame, *kept: DataFrame) -> None:
    """Delete the materialized tables that df reads, but for those that kept ones read too. No later plan may read them."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in _folders(df) - set().union(*map(_folders, kept)):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, shard: str, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with name: each row's number in the order of (shard, order...), counted from start.

    Rows are numbered within their shards, and only the shards' sizes stand in order in one task; shard is a column whose values follow the order.
    """
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("rows__"))
    before = sizes.select(F.col(shard).alias("of__"), (F.sum("rows__").over(Window.orderBy(shard)) - F.col("rows__")).alias("before__"))
    within = df.withColumn("place__", F.row_number().over(Window.partitionBy(shard).orderBy(*order)))
    found = within.join(before, F.col(shard).eqNullSafe(F.col("of__")))
    return found.select(*df.columns, (F.col("before__") + F.col("place__") + (start - 1)).cast("long").alias(name))
