"""Exact deduplication with an extendible-hash index on shared files.

Every text has a 64-bit hash, and equal hashes are counted before anything else, so that the index has one
record (hash, smallest doc_id, rows) for each. Leading bits of the hash address a directory that starts with
one bucket; a bucket with more than ``BUCKET_RECORDS`` records is split, and the directory doubles when the
bucket already uses all its bits. Records are written to the shared folder by the owner of their bucket, each
owner having a contiguous range of keys, which it sorts.

Where a hash has several rows, their texts are read again and go to the same owners, having been combined
by (hash, text) in ``SALTS`` salted groups: of any number of copies that many rows reach the owner. The owner
goes through its range in order, chains the rows of a hash and compares their bytes; each distinct text of
a chain is a group of copies.

Rows are moved only if they repeat: a filter of fixed size over the repeated hashes goes before each join
with texts (``common.matching``), and the groups that are more than a thousandth of all rows, fewer than a
thousand of them, are joined by broadcast, so that no task gets all copies of one text.

Defined cases: rows with null text or null doc_id are no copies of anything and stay; empty texts
are copies of each other; of a group the smallest doc_id stays; a row repeated with the same
doc_id and text is a copy of itself, reported as (doc_id, doc_id), of which one row stays; a very long text is
hashed and compared whole; an empty table has no copies; extra columns pass through the filter untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, matching, materialize, without

BUCKET_RECORDS = 10_000
#: Leading bits that the directory uses at most, so that it has at most 65,536 entries; a bucket of all these
#: bits keeps an overflow chain in its owner's sorted file.
MAX_DEPTH = 16
#: Groups in which copies of a text are combined before they go to its owner.
SALTS = 16


class Directory:
    """Extendible-hash directory over the leading bits of a hash, built from counts by slot.

    counts: records for each value of the leading max_depth bits. A bucket that can't be split
    further, as all its hashes start alike, keeps an overflow chain.
    """

    def __init__(self, counts: np.ndarray, capacity: int, max_depth: int = MAX_DEPTH):
        self.max_depth, self.global_depth, self.doublings = max_depth, 0, 0
        total = np.concatenate([[0], np.cumsum(counts)])
        self.pointers = [(0, 0)]  # (prefix, local depth) of the bucket of each slot
        todo = [(0, 0)]
        while todo:
            prefix, depth = todo.pop()
            width = 1 << (max_depth - depth)
            if depth < max_depth and total[(prefix + 1) * width] - total[prefix * width] > capacity:
                if depth == self.global_depth:
                    self.pointers = [b for b in self.pointers for _ in range(2)]
                    self.global_depth += 1
                    self.doublings += 1
                span = 1 << (self.global_depth - depth)
                for half in (0, 1):
                    child = (prefix * 2 + half, depth + 1)
                    at = prefix * span + half * span // 2
                    self.pointers[at : at + span // 2] = [child] * (span // 2)
                    todo.append(child)
        self.buckets = list(dict.fromkeys(self.pointers))
        number = {b: i for i, b in enumerate(self.buckets)}
        self.bucket_of_slot = [number[b] for b in self.pointers]
        self.records = [int(total[(p + 1) << (max_depth - d)] - total[p << (max_depth - d)]) for p, d in self.buckets]

    def owners(self, tasks: int) -> list[int]:
        """Owner of each slot: contiguous ranges of buckets with about as many records each."""
        share, out, seen = max(1.0, sum(self.records) / tasks), [], 0
        for n in self.records:
            out.append(min(tasks - 1, int((seen + n / 2) / share)))
            seen += n
        return [out[b] for b in self.bucket_of_slot]


def _hash(bits: int):
    h = F.xxhash64("text")
    return h if bits == 64 else F.shiftleft(h, 64 - bits)


def build_index(docs: DataFrame, capacity: int = BUCKET_RECORDS, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> tuple[DataFrame, Directory]:
    """The index's files (owner, bucket, h, doc_id, rows), sorted by key for each owner, and its directory."""
    spark = docs.sparkSession
    own = docs.where("text is not null and doc_id is not null").select("doc_id", _hash(hash_bits).alias("h"))
    records = materialize(own.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "records")
    # some bits more than buckets of even size would need, as sizes are uneven
    depth = min(max_depth, max(1, records.count() // capacity).bit_length() + 3)
    counts = np.zeros(1 << depth, np.int64)
    for r in records.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("slot")).count().collect():  # at most 2 ** depth
        counts[r["slot"]] = r["count"]
    directory = Directory(counts, capacity, depth)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = owned(records, directory, tasks).sortWithinPartitions("bucket", "h")
    return materialize(index, "index"), directory


def owned(rows: DataFrame, directory: Directory, tasks: int) -> DataFrame:
    """Rows with a hash h, at the partition of their owner, with the numbers of owner and bucket."""
    slots = range(len(directory.pointers))  # 2 ** MAX_DEPTH at most
    table = rows.sparkSession.createDataFrame([*zip(slots, directory.owners(tasks), directory.bucket_of_slot)], "slot int, owner int, bucket int")
    slot = F.shiftrightunsigned("h", 64 - directory.global_depth).cast("int") if directory.global_depth else F.lit(0)
    found = rows.withColumn("slot", slot).join(F.broadcast(table), "slot").drop("slot")
    return found.select("owner", "bucket", *rows.columns).repartitionById(tasks, F.col("owner"))


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, text, doc_id, rows) in the order of h -> (h, text_number, dup_of, copies): of the chain of a hash,
    the distinct texts by comparison of bytes, numbered in the order of their smallest doc_id."""
    out: list[tuple[int, int, int, int]] = []
    chain: dict[bytes, list[int]] = {}
    last = None

    def end() -> None:
        out.extend((last, k, d, n) for k, (d, n) in enumerate(sorted(chain.values())))
        chain.clear()

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["h", "text_number", "dup_of", "copies"])

    for b in batches:
        texts = b.column(1).cast(pa.binary())
        for h, text, d, n in zip(b.column(0).to_pylist(), texts.to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if h != last:
                end()
                last = h
            group = chain.setdefault(text, [d, 0])  # a dictionary's equality is that of all bytes
            group[0] = min(group[0], d)
            group[1] += n
        yield rows()
    end()
    yield rows()


def _found(docs: DataFrame, capacity: int, max_depth: int, hash_bits: int) -> DataFrame:
    """(doc_id, dup_of, copies, h) of rows that have copies, once for each doc_id and text."""
    docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    index, directory = build_index(docs, capacity, max_depth, hash_bits)
    chains = materialize(index.where("rows > 1").select("h"), "chains")
    texts = matching(docs.withColumn("h", _hash(hash_bits)), [F.col("h")], chains)
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    combined = salted.groupBy("h", "text", "salt").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")).select("h", "text", "doc_id", "rows")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_owner = owned(combined, directory, tasks).sortWithinPartitions("bucket", "h").select("h", "text", "doc_id", "rows")
    groups = materialize(at_owner.mapInArrow(compare, "h long, text_number long, dup_of long, copies long"), "groups")
    # a chain with one text needs its bytes no more: hash and doc_id say which rows are its copies
    several = materialize(groups.where("text_number > 0").select("h").distinct(), "collided")
    heads = groups.where("copies > 1").join(several, "h", "left_anti").select("h", "dup_of", "copies")
    rows = matching(docs.select("doc_id", _hash(hash_bits).alias("h")), [F.col("h")], chains)
    rows = materialize(rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")), "rows")
    plain = join_unique(rows, heads, "h")
    out = plain.select("doc_id", "dup_of", "copies", F.col("h").alias("h"), "n")
    if not several.isEmpty():
        own = matching(docs.withColumn("h", _hash(hash_bits)), [F.col("h")], several).groupBy("h", "text", "doc_id").agg(F.count("*").alias("n"))
        keys = own.groupBy("h", "text").agg(F.min("doc_id").alias("dup_of"), F.sum("n").alias("copies")).where("copies > 1")
        both = own.join(keys, ["h", "text"])
        out = out.unionByName(both.select("doc_id", "dup_of", "copies", F.xxhash64("text").alias("h"), "n"))
    return out.where("doc_id <> dup_of or n > 1").select("doc_id", "dup_of", "copies", "h")


def duplicates(docs: DataFrame, capacity: int = BUCKET_RECORDS, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> DataFrame:
    """(doc_id, dup_of, copies) for each document that is a copy of dup_of, which stays; copies: rows of
    the whole group. hash_bits below 64 is for tests of collisions."""
    return _found(docs, capacity, max_depth, hash_bits).select("doc_id", "dup_of", "copies")


def drop_duplicates(docs: DataFrame, capacity: int = BUCKET_RECORDS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """docs with one row of each group of equal texts."""
    found = materialize(_found(docs, capacity, max_depth, 64), "copies")
    on = [docs["doc_id"].cast("long"), F.xxhash64(docs["text"])]
    kept = without(docs, on, found.where("doc_id <> dup_of").select("doc_id", "h"))
    again = materialize(found.where("doc_id = dup_of").select("doc_id", "h"), "again")
    if again.isEmpty():
        return kept
    return without(kept, on, again).unionByName(matching(kept, on, again).dropDuplicates(["doc_id", "text"]))
