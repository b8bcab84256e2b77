"""Exact dedup against a dictionary of texts; the directory against its invariants."""

import random
from collections import Counter

import numpy as np
import pytest

from sparkveil.llm import exact_dedup as ed

from ..conftest import SF


def brute(rows):
    groups = {}
    for d, t in rows:
        if d is not None and t is not None:
            groups.setdefault(t, []).append(d)
    out = {}
    for own in groups.values():
        for d in own:
            if d != min(own) or own.count(d) > 1:
                out[d] = (min(own), len(own))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_directory(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 9, 1 << 6) * r.integers(0, 2, 1 << 6) ** 3
    d = ed.Directory(counts, 20, 6)
    assert len(d.pointers) == 1 << d.global_depth == 1 << d.doublings
    assert sum(d.records) == counts.sum()
    for slot, (prefix, depth) in enumerate(d.pointers):  # a slot's leading bits are its bucket's
        assert slot >> (d.global_depth - depth) == prefix
    for (prefix, depth), n in zip(d.buckets, d.records):
        width = 1 << (6 - depth)
        assert n == counts[prefix * width : (prefix + 1) * width].sum()
        assert n <= 20 or depth == 6
    owners = d.owners(5)
    assert owners == sorted(owners) and max(owners) < 5


@pytest.mark.parametrize("bits", [64, 6])
def test_equals_brute_force(spark, bits):
    r = random.Random(bits)
    rows = [(i, f"text {r.randint(0, 150)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ed.duplicates(docs, capacity=20, max_depth=5, hash_bits=bits).collect()
    assert {r["doc_id"]: (r["dup_of"], r["copies"]) for r in found} == brute(rows)
    assert len(found) == len({r["doc_id"] for r in found})


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["dup_of"], r["copies"]) for r in ed.duplicates(docs).collect()} == brute(rows)
    kept = ed.drop_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({min(d for d, t in rows if t == x) for _, x in rows})


def test_defined_cases(spark):
    long = "long " * 100000
    rows = [(1, "a", 1, 1), (2, "a", 2, 2), (1, "a", 3, 3), (3, None, 4, 4), (4, None, 5, 5), (None, "a", 6, 6), (None, "a", 7, 7), (5, "", 8, 8), (6, "", 9, 9), (7, long, 1, 1), (8, long, 2, 2), (1, "b", 3, 3), (9, "b", 3, 3), (10, "é", 1, 1), (11, "é", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, dup_of int")
    kept = ed.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, "a"), (3, None), (4, None), (None, "a"), (None, "a"), (5, ""), (7, long), (1, "b"), (10, "é"), (11, "é")])
    found = {(r["doc_id"], r["dup_of"], r["copies"]) for r in ed.duplicates(docs).collect()}
    assert found == {(1, 1, 3), (2, 1, 3), (6, 5, 2), (8, 7, 2), (9, 1, 2)}
    assert ed.duplicates(docs.limit(0)).count() == 0 and ed.drop_duplicates(docs.limit(0)).count() == 0


def test_directory_doubles_and_owners_share(spark):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(1000)], "doc_id long, text string")
    index, directory = ed.build_index(docs, capacity=20)
    assert directory.doublings > 3 and len(directory.buckets) >= 15 and max(directory.records) <= 20
    rows = index.collect()
    assert len({r["owner"] for r in rows}) == 4 and len(rows) == 300 and sum(r["rows"] for r in rows) == 1000
    for a, b in ((a, b) for a in rows for b in rows if a["owner"] < b["owner"]):
        assert a["h"] % (1 << 64) < b["h"] % (1 << 64)


def test_a_hot_text_is_split(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r["doc_id"]: (r["dup_of"], r["copies"]) for r in ed.duplicates(docs).collect()} == brute(rows)
