"""A training-data pipeline over ``documents``: five stages, each an operator of ``sparkveil.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder
and reads again as the next stage's docs. All but the last return the columns of documents. What a stage
needs to know of the corpus it learns from docs, so from all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import common, exact_dedup, language_id, mixing, near_dedup, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language_id.keep_languages(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as its rate says, so that sources meet their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(shard, bin, offset, doc_id, start, tokens) of every piece; a repeated document is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages of language ID, near duplicates, mixing and packing are beyond SQL; tests/llm holds run()
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
