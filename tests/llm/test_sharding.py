"""The hash tree against a version in plain Python, shares, and movement on a change of weights."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from sparkveil.llm import sharding

from ..conftest import SF


def brute(doc_id, tree):
    key, node, out = "null" if doc_id is None else str(doc_id), "", []
    for level in sharding.levels(tree):
        draws = []
        for c, w in level[node].items():
            if w > 0:
                full = f"{node}/{c}" if node else c
                h = int(hashlib.md5(f"{key}|{full}".encode()).hexdigest()[:8], 16)
                draws.append((-math.log((h + 0.5) / 4294967296.0) / w, c))
        out.append(min(draws)[1])
        node = f"{node}/{out[-1]}" if node else out[-1]
    return tuple(out)


def placed(spark, ids, tree=None):
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.assign(docs, tree).collect()}


def test_equals_brute_force(spark):
    ids = [*range(3000), None, -5]
    assert placed(spark, ids) == {i: brute(i, sharding.TREE) for i in ids}


def test_shares_follow_weights(spark):
    n = 20000
    seen = Counter(placed(spark, range(n)).values())
    for r, (wr, racks) in sharding.TREE.items():
        for k, (wk, shards) in racks.items():
            for s, ws in shards.items():
                p = wr / 6 * wk / sum(w for w, _ in racks.values()) * ws / sum(shards.values())
                assert abs(seen[r, k, s] - n * p) < 5 * math.sqrt(n * p)


def test_movement_stays_in_the_subtree(spark):
    tree = {r: (w, {k: (v, dict(s)) for k, (v, s) in racks.items()}) for r, (w, racks) in sharding.TREE.items()}
    tree["east"][1]["e1"][1]["s2"] = 3.0
    old, new = placed(spark, range(4000)), placed(spark, range(4000), tree)
    moved = {i for i in old if old[i] != new[i]}
    assert moved and all(old[i][:2] == ("east", "e1") and new[i] == ("east", "e1", "s2") for i in moved)
    tree["west"] = (2.0, tree["west"][1])  # a heavier region only draws documents
    newer = placed(spark, range(4000), tree)
    assert all(newer[i][0] == "west" for i in new if newer[i] != new[i])


def test_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, sharding.assign(docs).collect())) == sorted(c.sql(sharding.assign_sql()).fetchall())


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, region string")
    out = sharding.assign(docs)
    assert out.columns == ["doc_id", "region", "rack", "shard"]
    assert len({tuple(r) for r in out.where("doc_id = 1").collect()}) == 1
    assert sharding.assign(docs.limit(0)).count() == 0
    only = {"a": (1.0, {"k": (1.0, {"s": 1.0, "t": 0.0})}), "b": (0.0, {"k": (1.0, {"s": 1.0})})}
    assert {tuple(r)[1:] for r in sharding.assign(docs, only).collect()} == {("a", "k", "s")}
    with pytest.raises(ValueError):
        sharding.assign(docs, {"a": (1.0, {"k": (1.0, {"s": 0.0})})})
    with pytest.raises(ValueError):
        sharding.assign(docs, {})
