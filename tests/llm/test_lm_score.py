"""Compression scores: sizes against zstandard itself, dictionaries against counts, held-out separation."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkveil.llm import lm_score

from ..conftest import SF

GOOD = "river stone water mountain forest valley meadow glacier canyon plateau".split()
BAD = "invoice payment account refund discount billing purchase checkout shipping warranty".split()


def corpus(n=240):
    r = random.Random(9)
    make = lambda words: " ".join(r.choice(words) + " " + r.choice(["of", "the", "and", "near"]) for _ in range(r.randint(30, 80)))
    return [(i, make(GOOD if i % 2 else BAD)) for i in range(n)]


def tables(spark, rows, labelled):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in labelled], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = tables(spark, corpus(), range(120))
    rows = [r for r in lm_score.score(docs, labels, 4096).collect() if r["doc_id"] >= 120]
    good, bad = ([r["score"] for r in rows if r["doc_id"] % 2 == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def flat(texts):
    return lm_score.buffer_of(pa.array(texts, pa.large_string()))


def test_sizes_are_those_of_zstandard():
    texts = [t for _, t in corpus(20)]
    dictionaries = b"river of stone and water near " * 20, b"invoice the payment of account " * 20
    for text, own in zip(texts, lm_score.sizes(*flat(texts), *dictionaries)):
        for d, n in zip(dictionaries, own):
            data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=lm_score.LEVEL)
            assert n == len(zstandard.ZstdCompressor(level=lm_score.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode()))


@pytest.mark.parametrize("piece", [1 << 20, 512])
def test_dictionary_holds_what_repeats(monkeypatch, piece):
    monkeypatch.setattr(lm_score, "PIECE", piece)
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 2000))) for _ in range(30)]
    texts[7] = texts[7][:300] + passage
    texts[19] = passage + texts[19]
    texts += ["", "x" * 10]
    data, off = flat(texts)
    got = lm_score.dictionary(data, off, np.ones(len(texts), bool), 1 << 20)
    # every window that occurs twice is in the dictionary, but for those at the edges of segments
    w = lm_score.WINDOW
    seen = Counter(t[i : i + w] for t in map(str.encode, texts) for i in range(len(t) - w + 1))
    twice = [x for x, n in seen.items() if n > 1]
    assert len(twice) > 800 and sum(x in got for x in twice) > 0.8 * len(twice)
    assert len(got) < 3000
    assert lm_score.dictionary(data, off, np.arange(len(texts)) != 7, 1 << 20) == b""
    assert len(lm_score.dictionary(data, off, np.ones(len(texts), bool), 300)) <= 300


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_keys_are_the_least_hash_of_a_texts_windows(monkeypatch, piece):
    monkeypatch.setattr(lm_score, "PIECE", piece)
    r = random.Random(5)
    texts = ["".join(r.choice("abc é") for _ in range(r.choice([0, 5, 31, 32, 33, 100, 1000]))) for _ in range(60)]
    for t, key in zip(texts, lm_score.keys_of(pa.array(texts, pa.large_string()))):
        h = lm_score.windows(np.frombuffer(t.encode(), np.uint8))
        assert not len(h) or key == lm_score.mix64(h.min().reshape(1)).view(np.int64)[0]
    assert len(set(lm_score.keys_of(pa.array([t for t in {*texts} if len(t.encode()) < 32], pa.large_string())))) == len({t for t in texts if len(t.encode()) < 32})


def test_scores_do_not_depend_on_partitions_and_shelves_follow_the_corpus(spark):
    docs, labels = tables(spark, corpus(), range(120))
    key = lambda rows: sorted(map(tuple, rows.collect()))
    a = key(lm_score.score(docs, labels, 4096, shelf=20_000))
    assert a == key(lm_score.score(docs.repartition(7), labels, 4096, shelf=20_000))
    assert a != key(lm_score.score(docs, labels, 4096))


def test_documents_that_occur_twice_are_scored_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_score.score(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).join(docs.select("doc_id", "text"), "doc_id").where("n_bytes > 200").collect()
    seen = Counter(r["text"] for r in rows)
    once = sorted(r["general_bits"] for r in rows if seen[r["text"]] == 1)
    twice = [r["general_bits"] for r in rows if seen[r["text"]] == 2]
    assert np.mean([x < once[len(once) // 10] for x in twice]) > 0.5


def test_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = lm_score.score(docs, labels)
    assert rows.count() == docs.count()
    assert rows.where(F.col("score").isNull()).count() == docs.where("text is null or text = ''").count()


def test_defined_cases(spark):
    rows = [(1, "some words in a row", "x"), (2, None, "x"), (3, "", "x"), (None, "no id here at all", "x"), (1, "some words in a row", "x"), (5, "long text " * 100000, "x"), (6, "ab", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, None), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in lm_score.in_domain(docs, labels).collect()) == [1, 6]
    out = lm_score.score(docs, labels).collect()
    assert len(out) == len(rows)
    assert all((r["score"] is None) == (r["doc_id"] in (2, 3)) for r in out)
    assert len({(r["score"], r["in_bits"]) for r in out if r["doc_id"] == 1}) == 1
    assert lm_score.score(docs.limit(0), labels).count() == 0
    assert all(r["score"] is not None for r in lm_score.score(docs, labels.limit(0)).where("n_bytes > 0").collect())


def test_domain_dictionary_comes_from_all_good_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "RANGE", 1 << 20)
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [letters(400) for _ in range(3)]
    texts = [letters(60) for _ in range(6000)]
    for n, p in enumerate(passages):  # in 40, 20 and 10 of more texts than a sample of 4,000 holds, and in a copy of one
        for i in r.sample(range(6000), 40 >> n):
            texts[i] = texts[i][:20] + p + texts[i][20:]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000 + i, passages[2] + " copied") for i in range(200)], "doc_id long, text string").repartition(8)
    some = docs.withColumns({"h": F.xxhash64("text"), "bytes": F.octet_length("text").cast("long")})
    n_bytes = sum(map(len, texts))
    tables = lm_score.recurring(docs.select("text").distinct(), n_bytes, n_bytes, 1 << 20)
    assert len(tables) == 8
    seen = Counter(w for t in {r["text"] for r in docs.collect()} for w in set(lm_score.windows(np.frombuffer(t.encode(), np.uint8)).view(np.int64).tolist()))
    assert {x["w"]: x["n"] for t in tables for x in t.collect()} == {w: n for w, n in seen.items() if n > 1}
    got = lm_score.domain_dictionary(some, some, docs.select("doc_id").distinct(), n_bytes, 2048).decode()
    inside = [sum(p[i : i + 32] in got for i in range(len(p) - 31)) / (len(p) - 31) for p in passages]
    assert inside[0] > 0.9 and len(got) <= 2048 and inside[0] >= inside[1] >= inside[2]
    assert got == lm_score.domain_dictionary(some.repartition(3), some, docs.select("doc_id").distinct(), n_bytes, 2048).decode()


def test_most_frequent_windows_are_those_of_the_whole(spark):
    r = np.random.default_rng(1)
    w, n = r.integers(-(1 << 63), 1 << 63, 5000), r.integers(2, 6, 5000)
    tie = lm_score.mix64(w.view(np.uint64)).view(np.int64)
    counts = spark.createDataFrame([tuple(map(int, x)) for x in zip(w, n, tie)], "w long, n long, tie long")
    for most in (0, 1, 700, 3000, 6000):
        top, own = lm_score.most_frequent(counts, most)
        best = np.lexsort((tie, n))[::-1][:most]
        assert sorted(zip(w[best].view(np.uint64).tolist(), n[best].tolist())) == list(zip(top.tolist(), own.tolist()))
