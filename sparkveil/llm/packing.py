"""Packing documents into sequences of fixed length: bounded-space online best-fit.

Documents come one by one. A document longer than a sequence fills whole sequences first; what is left
is put into the open bin in which it leaves least space. A bitset has a bit for each amount of free
space of which there is an open bin, so that the best fit is the lowest set bit at or above the size.
At most ``OPEN`` bins are open; when a new one is needed beyond that, the fullest closes.

Documents are packed in independent shards of about ``SHARD_DOCS`` documents, assigned and ordered by
hash of doc_id: each shard is a stream that one task packs with memory for its open bins alone. Rows alike in
doc_id and tokens are counted first and go to shards by hash of their number too, so that neither copies nor
rows without doc_id make a shard larger. Only (doc_id, tokens) is shuffled.

Defined cases: null, empty or white text has no tokens and is put nowhere; null doc_id is packed like
any other; repeated rows are all packed; a very long text fills as many sequences as it needs; ties in free space go to the bin opened first; an empty
table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .mixing import token_count

LENGTH = 2048
OPEN = 64
SHARD_DOCS = 20_000


def best_fit(sizes: Iterator[int], length: int = LENGTH, most_open: int = OPEN) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, bin, offset in the bin, start in the document, tokens) of each piece; bins count from 0."""
    free_bits, bins, opened, last = 0, {}, 0, -1
    for item, size in enumerate(sizes):
        start = 0
        while size - start > length:
            last += 1
            yield item, last, 0, start, length
            start += length
        need = size - start
        if need <= 0:
            continue
        above = free_bits >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            own = bins[free].popleft()
            if not bins[free]:
                del bins[free]
                free_bits &= ~(1 << free)
        else:
            if opened >= most_open:
                fullest = (free_bits & -free_bits).bit_length() - 1
                bins[fullest].popleft()
                opened -= 1
                if not bins[fullest]:
                    del bins[fullest]
                    free_bits &= ~(1 << fullest)
            last += 1
            own, free = last, length
            opened += 1
        yield item, own, length - free, start, need
        if free == need:
            opened -= 1
        else:
            bins.setdefault(free - need, deque()).append(own)
            free_bits |= 1 << (free - need)


def pack(docs: DataFrame, length: int = LENGTH, most_open: int = OPEN, shard_docs: int = SHARD_DOCS, tokens: Callable[[], Column] = token_count) -> DataFrame:
    """(shard, bin, offset, doc_id, start, tokens) of each piece of each document."""
    sized = materialize(docs.select("doc_id", tokens().alias("tokens")).where("tokens > 0"), "sizes")
    shards = max(1, -(-sized.count() // shard_docs))
    alike = sized.groupBy("doc_id", "tokens").agg(F.count("*").alias("n")).select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    own = F.when((F.col("k") > 1) | F.col("doc_id").isNull(), F.xxhash64(F.lit("pack"), "doc_id", "tokens", "k")).otherwise(F.col("at"))
    shuffled = alike.withColumn("at", F.xxhash64(F.lit("pack"), "doc_id")).withColumn("shard", F.pmod(own, F.lit(shards)).cast("long")).drop("k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "doc_id", "tokens"], kind="stable", na_position="last")
        rows = pd.DataFrame(best_fit(iter(pdf["tokens"].tolist()), length, most_open), columns=["item", "bin", "offset", "start", "tokens"], dtype="int64")
        own = pdf["doc_id"].astype("Int64").reset_index(drop=True)
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "bin": rows["bin"], "offset": rows["offset"], "doc_id": own.take(rows["item"]).to_numpy(dtype=object, na_value=None) if own.isna().any() else own.to_numpy(dtype="int64")[rows["item"]], "start": rows["start"], "tokens": rows["tokens"]})

    return shuffled.groupBy("shard").applyInPandas(run, "shard long, bin long, offset long, doc_id long, start long, tokens long")
