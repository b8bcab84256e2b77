"""Entropy balancing: constraints met, the tilted form, an independent solver, defined cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkveil.llm import mixing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def corpus():
    r = random.Random(2)
    return [(i, r.choice(["web", "web", "web", "books", "code"]), r.choice(["en", "en", "de"]), " ".join(["w"] * r.randint(1, 60))) for i in range(800)]


def test_targets_are_met_and_rates_are_tilted(spark):
    rows = mixing.rates(table(spark, corpus())).collect()
    tokens = defaultdict(float)
    for r in rows:
        tokens[r["source"], r["lang"]] += r["tokens"]
    goal_s, goal_g = mixing.targets(dict(tokens), mixing.ALPHA)
    for key, goal in (("source", goal_s), ("lang", goal_g)):
        for k, want in goal.items():
            assert sum(r["rate"] * r["tokens"] for r in rows if r[key] == k) == pytest.approx(want, rel=1e-5)
    slopes = defaultdict(set)
    for r in rows:
        slopes[r["source"], r["lang"]].add(round(math.log(r["rate"]) / r["tokens"], 5))
    assert all(max(v) - min(v) < 1e-4 for v in slopes.values())
    # additive in source and language
    l = {k: np.mean(list(v)) for k, v in slopes.items()}
    assert l["web", "en"] - l["web", "de"] == pytest.approx(l["code", "en"] - l["code", "de"], abs=1e-4)


def test_equals_iterative_scaling(spark):
    """The same solution by coordinate-wise bisection instead of Newton's iterations."""
    rows = corpus()
    cells = Counter((s, g, len(t.split())) for _, s, g, t in rows)
    tokens = defaultdict(float)
    for (s, g, t), n in cells.items():
        tokens[s, g] += t * n
    goal_s, goal_g = mixing.targets(dict(tokens), mixing.ALPHA)
    ls, lg = dict.fromkeys(goal_s, 0.0), dict.fromkeys(goal_g, 0.0)
    for _ in range(300):
        for own, goal, at in ((ls, goal_s, 0), (lg, goal_g, 1)):
            for k in own:
                lo, hi = -1.0, 1.0
                for _ in range(60):
                    own[k] = (lo + hi) / 2
                    total = sum(n * t * math.exp((ls[s] + lg[g]) * t) for (s, g, t), n in cells.items() if (s, g)[at] == k)
                    lo, hi = (own[k], hi) if total < goal[k] else (lo, own[k])
    for r in mixing.rates(table(spark, rows)).collect():
        assert r["rate"] == pytest.approx(math.exp((ls[r["source"]] + lg[r["lang"]]) * r["tokens"]), rel=1e-3)


def test_copies_round_the_rates(spark):
    docs = table(spark, corpus())
    rows = mixing.rates(docs).collect()
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)
    assert abs(sum(r["copies"] - r["rate"] for r in rows)) < 4 * math.sqrt(len(rows))
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_defined_cases(spark):
    rows = [(1, "a", "en", "one two three", 1), (2, None, "en", "one two", 2), (3, "a", None, "one", 3), (4, "b", "en", None, 4), (5, "b", "en", "", 5), (6, "b", "de", " \n", 6), (None, "b", "en", "x y", 7), (1, "a", "en", "one two three", 1), (8, "a", "en", "word " * 200000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, _copy int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r for r in mixing.rates(docs).collect()}
    assert len(mixing.rates(docs).collect()) == len(rows)
    assert all(found[i]["rate"] == 1 and found[i]["copies"] == 1 for i in (4, 5, 6))
    assert found[8]["tokens"] == 200000
    assert {r["copies"] for r in mixing.rates(docs).where("doc_id = 1").collect()} == {found[1]["copies"]}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id in (4, 5, 6)")).count() == 3
    assert mixing.mix(docs.where("source = 'a' and lang = 'en'")).count() == 3  # one source, one language


def test_targets_that_conflict(spark):
    """Each source has one language, so that languages can't keep their shares."""
    r = random.Random(7)
    rows = [(i, "a" if i % 10 else "b", "en" if i % 10 else "fr", " ".join(["w"] * r.randint(1, 20))) for i in range(100)]
    found = mixing.rates(table(spark, rows)).collect()
    tokens = Counter()
    for x in found:
        tokens[x["source"], x["lang"]] += x["tokens"]
    goal_s, goal_g = mixing.targets(dict(tokens), mixing.ALPHA)
    assert goal_g["en"] == pytest.approx(goal_s["a"]) and goal_g["fr"] == pytest.approx(goal_s["b"])
    for k, want in goal_s.items():
        assert sum(x["rate"] * x["tokens"] for x in found if x["source"] == k) == pytest.approx(want, rel=1e-4)
    # sources that share a language leave it room
    goal_s, goal_g = mixing.targets({("a", "en"): 900.0, ("b", "fr"): 80.0, ("b", "en"): 20.0}, mixing.ALPHA)
    assert sum(goal_s.values()) == pytest.approx(sum(goal_g.values())) and goal_g["fr"] < goal_s["b"]


def test_targets_out_of_reach_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "targets", lambda tokens, alpha: ({"a": 500.0, "b": 100.0}, {"en": 100.0, "fr": 500.0}))
    rows = [(i, "ab"[i % 2], ["en", "fr"][i % 2], "some words") for i in range(20)]
    with pytest.raises(ArithmeticError):
        mixing.rates(table(spark, rows))
