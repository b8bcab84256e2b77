"""A scan is a function of each row alone, so it runs on a stream as it is, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.scan import ScanConfig, issues
from ..sources.files import from_documents
from ..sources.shared import shared_folder
from ..spec.model import Rule


def document_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Files of documents in the order they appear in a folder; a single file is a folder of one."""
    pattern = f"{folder[:-1]}[{folder[-1]}]"  # a stream takes one file only as what a pattern finds
    return from_documents(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern))


def start(files: DataFrame, rules: list[Rule], out: str, checkpoint: str, config: ScanConfig = ScanConfig(), available_now: bool = True) -> StreamingQuery:
    """Append findings to a Parquet table, each exactly once."""
    writer = issues(files, rules, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scanned(spark: SparkSession, folder: str, rules: list[Rule], config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of a stream over all documents that are in a folder now, once it has read them."""
    out = shared_folder(spark, "stream")
    stream = document_stream(spark, folder, spark.read.parquet(folder).schema)
    start(stream, rules, f"{out}/issues", f"{out}/checkpoint", config).awaitTermination()
    return spark.read.schema(issues(from_documents(spark.read.parquet(folder)), rules, config).schema).parquet(f"{out}/issues")
