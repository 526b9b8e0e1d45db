"""From raw documents to a training mix: quality, boilerplate lines, near-duplicates, benchmark leaks, source weights.

Each stage takes and gives the columns of documents (the last one adds the copy's number). A null or empty text has a quality score like any other, no lines, no class but its
own, no benchmark words and size 0: if it passes the classifier it stays until mixing, where rows of size 0 count for nothing. Rows that repeat count each, but
for the near-duplicate stage, which keeps one. An empty table gives an empty table. Texts of any length pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontamination, line_dedup, mixing, near_dedup, quality
from orrery.llm.common import discard, documents, materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, unchanged. Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sites share; n_chars follows the text.

    Documents of which nothing is left go: each of their lines stays in an earlier document of this stage's input. Blank ones that lost nothing stay.
    """
    cleaned = line_dedup.remove_boilerplate(docs).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    cleaned = cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return near_dedup.keep_first(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, unchanged."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of each copy."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("mixing", weighted_mix),
]

#: SQL can't express the classifier or the signatures; tests hold run() against plain versions of all stages but the classifier's verdicts, which are taken as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again. A stage's table goes once the next one's is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
