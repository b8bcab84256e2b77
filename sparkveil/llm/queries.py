"""The operators as queries over the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, lm_score, mixing, near_dedup, packing, pii, quality, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents")).where("accepted").drop("accepted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).where("accepted").drop("accepted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), alike=near_dedup.ALIKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_mixing, op3_quality, op4_exact_dedup, op5_pii, op6_lm_score, op7_packing, op8_warc, op9_sharding, op10_near_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": "WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) SELECT doc_id, dup_of, copies FROM g WHERE doc_id <> dup_of",
        "op8_warc": "SELECT page_id, url, html FROM pages",
        "op9_sharding": sharding.assign_sql(),
    }
