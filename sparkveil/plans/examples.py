"""Rules tried on their own examples, all in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as E
from ..functions.sql import column
from ..operators.resolve import resolved
from ..sources.files import describe
from ..spec.model import Rule
from .scan import CANDIDATE, ScanConfig, candidate_arrays


def example_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule_id, idx, path, text, contains_secret, match)."""
    rows = [(i * 1000 + k, r.id, k + 1, e.file_name, e.text, e.contains_secret, e.match) for i, r in enumerate(rules) for k, e in enumerate(r.examples)]
    return spark.createDataFrame(rows, "doc_id long, rule_id string, idx int, path string, text string, contains_secret boolean, match string")


def outcomes(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, idx, contains_secret, found, ok): a positive example is right if a finding is exactly its match
    (or there is one, if it names none), a negative one if there is no finding. Only the example's own rule
    is active: candidates of others neither count nor take part in resolution."""
    table = example_table(spark, rules)
    arrays = candidate_arrays(describe(table, F.col("text")), rules, ScanConfig(auto_test_detection=False)).join(table.select("doc_id", F.col("rule_id").alias("by")), "doc_id")
    won = resolved(E.filter(E.col("candidates"), lambda c: c["rule_id"] == E.col("by")), CANDIDATE)
    found = arrays.select("doc_id", "by", F.explode(column(won)).alias("c")).select("doc_id", "by", F.md5("c.text").alias("secret_md5"))
    own = table.join(found, "doc_id", "left")
    by = own.groupBy("rule_id", "idx", "contains_secret", "match").agg(F.count("by").alias("found"), F.max(F.coalesce(F.col("secret_md5") == F.md5("match"), F.lit(False))).alias("exact"))
    right = F.when(F.col("contains_secret"), (F.col("found") > 0) & (F.col("match").isNull() | F.col("exact"))).otherwise(F.col("found") == 0)
    return by.select("rule_id", "idx", "contains_secret", "found", right.alias("ok"))
