"""Best-fit packing against a list-based version."""

import random
from collections import Counter

import pytest

from sparkveil.llm import packing


def brute(sizes, length, most_open):
    """Open bins in a list, searched one by one."""
    bins, last, out = [], -1, []  # (opened, bin, free)
    for item, size in enumerate(sizes):
        start = 0
        while size - start > length:
            last += 1
            out.append((item, last, 0, start, length))
            start += length
        need = size - start
        if need <= 0:
            continue
        fits = [b for b in bins if b[2] >= need]
        if fits:
            b = min(fits, key=lambda b: (b[2], b[0]))
            bins.remove(b)
        else:
            if len(bins) >= most_open:
                bins.remove(min(bins, key=lambda b: (b[2], b[0])))
            last += 1
            b = (0, last, length)
        out.append((item, b[1], length - b[2], start, need))
        if b[2] > need:
            bins.append((len(out), b[1], b[2] - need))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    length, most_open = r.choice([(64, 5), (100, 1), (32, 200)])
    sizes = [r.choice([r.randint(0, length), r.randint(1, 8), r.randint(length, 4 * length)]) for _ in range(3000)]
    assert list(packing.best_fit(iter(sizes), length, most_open)) == brute(sizes, length, most_open)


def whole(pieces, sizes, length):
    """All tokens are there once, and no sequence holds more than fits, without overlap."""
    bins, docs = {}, {}
    for r in pieces:
        bins.setdefault((r["shard"], r["bin"]), []).append((r["offset"], r["tokens"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], r["tokens"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    for d, own in docs.items():
        assert sum(n for _, n in own) == sizes[d]


def test_query_packs_all_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = {r["doc_id"]: r["t"] for r in docs.select("doc_id", packing.token_count().alias("t")).collect()}
    pieces = packing.pack(docs, 512, 16, shard_docs=300).collect()
    whole(pieces, sizes, 512)
    assert len({r["shard"] for r in pieces}) > 1
    assert sum(sizes.values()) / (512 * len({(r["shard"], r["bin"]) for r in pieces})) > 0.9


def test_defined_cases(spark):
    rows = [(1, "a b c", 1), (2, None, 2), (3, "", 3), (4, " \n\t", 4), (None, "x y", 5), (None, "z", 5), (1, "a b c", 1), (7, "w " * 50000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin int")
    out = packing.pack(docs, 1000).collect()
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
    assert total == {1: 6, None: 3, 7: 50000}
    assert packing.pack(docs.limit(0)).count() == 0


def test_neither_null_ids_nor_copies_make_a_shard_large(spark):
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end as doc_id", "'a b c' as text")
    pieces = packing.pack(docs, 512, 16, shard_docs=300).collect()
    assert sum(r["tokens"] for r in pieces) == 9000
    sizes = Counter(r["shard"] for r in pieces)
    assert len(sizes) == 10 and max(sizes.values()) < 450
