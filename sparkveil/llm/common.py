"""What the operators share: tables in the shared folder, joins of checked size, Arrow text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of the filter that keeps rows without a partner out of a join. Its table has at most
#: FILTER_BITS / 32768 rows of 4 KiB, so 16 MiB, whatever the number of keys.
FILTER_BITS = 1 << 27


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir of the session).

    Only where the setting is missing, as in tests on one machine, a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows for Python workers, unless the session has a number of its own: 10,000 documents, of
    which a worker holds some copies and the JVM another, are too many for a small executor."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":  # Spark's default
        spark.conf.set(setting, "1000")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends there, so that losing an
    executor later costs nothing that is already done. The job's shuffle files go when it ends, as nothing
    else reads them."""
    spark = df.sparkSession
    small_batches(spark)
    path, setting = shared_dir(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def heavy(df: DataFrame, key: str, parts: int = 1000) -> list:
    """The values of a column that more than one in ``parts`` of all rows have, so fewer than ``parts`` values."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    least = df.count() // parts
    return [r[key] for r in counts.where(F.col("count") > least).select(key).collect()]


def _may_match(left: DataFrame, on: list[Column], right: DataFrame) -> tuple[DataFrame, str]:
    """left with a boolean column, whose name is returned: false for rows that have no partner in right."""
    tag = uuid.uuid4().hex[:8]
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))
    bucket, bits = f"bucket_{tag}", f"bits_{tag}"
    keys = right.select(place([right[c] for c in right.columns]).alias("p")).select(F.shiftright("p", 15).alias(bucket), F.col("p").bitwiseAND(32767).alias("bit"))
    table = materialize(keys.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(bits)), "filter")
    found = left.withColumns({f"place_{tag}": place(on)}).withColumns({bucket: F.shiftright(f"place_{tag}", 15)}).join(F.broadcast(table), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, int(shiftright(place_{tag} & 32767, 3)) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr(f"int(place_{tag} & 7)")
    may = F.coalesce(F.call_function("shiftright", byte, hit).bitwiseAND(1) == 1, F.lit(False))
    for c in on:
        may = may & c.isNotNull()
    return found.select(*[left[c] for c in left.columns], may.alias(f"may_{tag}")), f"may_{tag}"


def matching(left: DataFrame, on: list[Column], right: DataFrame) -> DataFrame:
    """The rows of left whose keys (columns of left) are among the rows of right, of as many columns.

    Rows that can't match are left out before the shuffle by a filter of fixed size over right's keys, so
    that it is the same plan at every size; right is read twice and should be a table.
    """
    marked, may = _may_match(left, on, right)
    names = [f"{may}_{k}" for k in range(len(on))]
    keyed = marked.where(may).withColumns(dict(zip(names, on)))
    return keyed.join(right.toDF(*names), names, "left_semi").select(*left.columns)


def without(left: DataFrame, on: list[Column], right: DataFrame) -> DataFrame:
    """The rows of left whose keys are not among the rows of right; null keys stay. As matching(), but rows that
    can't match are not moved at all."""
    marked, may = _may_match(left, on, right)
    names = [f"{may}_{k}" for k in range(len(on))]
    keyed = marked.where(may).withColumns(dict(zip(names, on)))
    rest = keyed.join(right.toDF(*names), names, "left_anti").select(*left.columns)
    return marked.where(~F.col(may)).select(*left.columns).unionByName(rest)


def join_unique(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join on a column that is (but for collisions of a hash) unique in few. Values that more than a thousandth of
    many have are joined by broadcast: they are fewer than a thousand."""
    hot = heavy(many, key)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = many.where(~is_hot).join(few.where(~is_hot), key)
    return out.unionByName(many.where(is_hot).join(F.broadcast(few.where(is_hot)), key)) if hot else out


def clean_text(column: pa.Array, lower: bool = False) -> pa.Array:
    """Text as large_string without nulls (these become empty); bytes that are no UTF-8 become U+FFFD."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    try:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        return pc.utf8_lower(column) if lower else column
    except pa.ArrowInvalid:
        texts = [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
        return pa.array([t.lower() if lower else t for t in texts], pa.large_string())


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string column and the offset at which each row starts, with the end."""
    n, at = len(column), column.offset
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, at * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about so many bytes each; a row is never cut."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers (as in splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
