"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, fill_middle, filter_audit, language, line_dedup, mixing, near_dedup, pii, quality, substring_dedup, toxicity, webp
from .common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(documents(spark, sf_dir)))


def _labels(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(which).alias("label"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), _labels(spark, sf_dir, "toxic"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digest(webp.read_media(webp.store_texts(documents(spark, sf_dir))))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.report(decontamination.search(documents(spark, sf_dir), items))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_entities(documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *(number(k) for k in pii.TYPES), "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), _labels(spark, sf_dir, "quality"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), reject=None)  # "und" is for texts without letters here; rejected says the rest


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(documents(spark, sf_dir)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_middle": op12_fill_middle,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.LINES_SQL.replace("{documents}", "documents"),
    "op6_decontamination": decontamination.REPORT_SQL.replace("{documents}", "documents"),
    "op9_mixing": mixing.MIX_SQL.replace("{documents}", "documents"),
    "op11_filter_audit": filter_audit.AUDIT_SQL.replace("{documents}", "documents"),
    "op12_fill_middle": fill_middle.FILL_SQL.replace("{documents}", "documents"),
    "op13_embedding_dedup": embedding_dedup.PAIRS_SQL.replace("{embeddings}", "embeddings"),
}
