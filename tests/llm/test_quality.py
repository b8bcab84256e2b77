"""Robust outliers: planted junk against clean text, an in-memory estimate, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkveil.llm import quality

SYLLABLES = "the of an ter wa ho li smal ri sto gar mor un der be win sum ro fi ta pa lo mi ke".split()


def prose(r, n):
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 1, 2, 2, 3, 4])))
    return " ".join(" ".join(word() for _ in range(r.randint(5, 14))).capitalize() + "." for _ in range(n))


def corpus():
    r = random.Random(4)
    rows = [(i, "en", "a" if i % 2 else "b", prose(r, int(r.lognormvariate(3, 0.8)) + 2)) for i in range(600)]
    junk = ["#$%&/()=?!|@" * 200, "BUY NOW CLICK HERE!!! " * 80, "spam " * 900, "x" * 3000, "{};[]<>== 0x1f " * 150]
    return rows + [(1000 + i, "en", "a" if i % 2 else "b", x) for i, x in enumerate(junk)]


def test_junk_goes_and_clean_text_stays(spark):
    rows = quality.judged(spark.createDataFrame(corpus(), "doc_id long, lang string, source string, text string")).collect()
    assert not any(r["accepted"] for r in rows if r["doc_id"] >= 1000)
    assert np.mean([r["accepted"] for r in rows if r["doc_id"] < 1000]) > 0.95


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs).join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert np.mean([r["accepted"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([not r["accepted"] for r in rows if r["quality"] == 0]) > 0.98


def concentrate(x, support, steps):
    """The same steps in memory, with exact order statistics in place of bins."""
    mid = np.median(x, 0)
    mad = (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
    tanh = np.tanh((x - mid) / mad)
    best = None
    for cov in (np.diag(mad**2), np.outer(mad, mad) * np.corrcoef(tanh.T)):
        mean = mid
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d, kind="stable")[: int(np.ceil(support * len(x)))]]
            mean, cov = own.mean(0), np.cov(own.T, bias=True)
        if best is None or np.linalg.slogdet(cov)[1] < np.linalg.slogdet(best[1])[1]:
            best = mean, cov
    return best


def test_estimate_equals_one_in_memory(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 6))
    x = rng.normal(size=(4000, 6)) @ a.T + 3
    x[:400] = rng.normal(size=(400, 6)) * 0.1 + 60  # a tight cluster far off
    table = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, " + ", ".join(f"x{k} double" for k in range(6)))
    n, centre, factor = quality.mcd(table)["g"]
    mean, cov = concentrate(x, quality.SUPPORT, quality.STEPS)
    assert n == 4000
    own = quality.distances(x, centre, factor)
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov * quality.CONSISTENCY), x - mean)
    assert np.abs(np.log(own[400:] / want[400:])).max() < 0.15
    assert (own[:400] > quality.CUTOFF).all() and (own[400:] < quality.CUTOFF).mean() > 0.999


def test_statistics_count_what_they_say():
    x = quality.statistics(pa.array(["Ab cd, ef!", "", None, "  "]))
    assert np.isnan(x[1:]).all()
    assert x[0, 0] == pytest.approx(np.log((2 + 2.5) / (6 + 50))) and x[0, 1] == pytest.approx(np.log((1 + 2.5) / (5 + 50)))
    assert x[0, 2] == pytest.approx(np.log(56 / 13)) and x[0, 3] == x[0, 4] == pytest.approx(np.log(13)) and x[0, 5] == pytest.approx(np.log(13 / 2.5))


def test_defined_cases(spark):
    schema = "doc_id long, lang string, source string, text string, x0 int, g string"
    rows = [(*r, 1, "z") for r in corpus()[:200]] + [(900, None, None, "a few plain words here", 1, ""), (901, "en", "a", None, 1, ""), (902, "en", "a", "", 1, ""), (903, "en", "a", " \n ", 1, ""), (None, "en", "a", prose(random.Random(1), 9), 1, ""), (905, "en", "a", prose(random.Random(2), 20000), 1, "")]
    docs = spark.createDataFrame(rows, schema)
    out = quality.judged(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert not any(by[i]["accepted"] or by[i]["d2"] is not None for i in (901, 902, 903))
    assert by[None]["accepted"] and by[900]["d2"] is not None and by[905]["d2"] is not None
    assert quality.judged(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "en", "a", "the same words", 1, "") for i in range(80)], schema)
    assert all(r["accepted"] and r["d2"] is None for r in quality.judged(same).collect())  # singular: all stay


def test_small_groups_are_drawn_towards_the_whole():
    rng = np.random.default_rng(1)
    whole, own = np.diag(rng.random(6) + 0.5), np.diag(rng.random(6) * 100 + 50)
    zero, one = np.zeros(6), np.ones(6)
    for n, w in ((0, 0), (quality.PRIOR, 0.5), (10**9, 1)):
        centre, factor = quality.shrunk(n, one, own, zero, whole)
        assert centre == pytest.approx(w * one, abs=1e-6)
        assert np.linalg.inv(factor.T @ factor).diagonal() == pytest.approx(own.diagonal() ** w * whole.diagonal() ** (1 - w), rel=1e-5)
    assert np.allclose(quality.shrunk(5, None, None, one, whole)[1], quality.factor_of(whole))
    assert quality.shrunk(5, None, None, None, None) == (None, None)
