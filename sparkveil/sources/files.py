"""Tables of files: (doc_id, path, filename, language, file_type, is_hidden, content)."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import col, column
from ..functions.text import has_non_text, normalize_newlines


def with_content(files: DataFrame, text: Column) -> DataFrame:
    """Content with normalized line ends; that of files of no known language that holds control characters
    becomes empty, as it is no text."""
    plain = files.withColumn("content", F.coalesce(text, F.lit(""))).withColumn("content", column(normalize_newlines(col("content"))))
    return plain.withColumn("content", F.when(F.col("language").isNull() & column(has_non_text(col("content"))), F.lit("")).otherwise(F.col("content")))


def hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.[^/]")


def _unlisted(folder: str, glob: str) -> list[str]:
    """Files that Spark's own reader passes over: those that are empty, or with a name on their path that begins
    with a dot or underscore. Git's own are left out."""
    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    base = base.rstrip("/")
    names = [(x.path, x.size, x.path[len(base) + 1 :].split("/")) for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File]
    prefix = folder[: -len(base)] if folder.rstrip("/").endswith(base) and "://" in folder else ""
    return [prefix + p for p, size, way in names if (not size or any(n[0] in "._" for n in way)) and ".git" not in way and fnmatch.fnmatch(way[-1], glob)]


def from_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Every file under a folder as one row, its path relative to the folder. Executors read them, those that
    Spark's reader passes over by their names."""
    folder = folder.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_input_file(own) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    if others := _unlisted(folder, glob):
        named = spark.createDataFrame([(p,) for p in others], "path string").repartition(min(len(others), 1000))
        raw = raw.unionByName(named.mapInArrow(read, "path string, content binary"))
    base = F.lit(folder.removeprefix("file://").removeprefix("file:") + "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    own = raw.select(F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return describe(own.withColumn("doc_id", F.xxhash64("path")), F.col("text"))


def describe(rows: DataFrame, text: Column, language: Column | None = None, file_type: Column | None = None) -> DataFrame:
    """Rows with doc_id and path as files, of the language and type given, by default none and main."""
    own = rows.withColumn("language", language if language is not None else F.lit(None).cast("string"))
    own = own.withColumns({"filename": F.substring_index("path", "/", -1), "file_type": file_type if file_type is not None else F.lit("MAIN"), "is_hidden": hidden(F.col("path"))})
    return with_content(own, text).select("doc_id", "path", "filename", "language", "file_type", "is_hidden", "content")


def from_documents(documents: DataFrame) -> DataFrame:
    """The table of documents as files named by source and id."""
    path = F.concat(F.lit("docs-"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return describe(documents.select("doc_id", "source", "text").withColumn("path", path), F.col("text"))
