"""Skip-chain CRF: exact marginals on small graphs, held-out sentences, consistency, defined cases."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from sparkveil.llm import pii

from ..conftest import SF


@pytest.fixture(scope="module")
def model():
    return pii.train(1500, steps=120)


def exact(u, chain, skip, link, same):
    """Marginals by a sum over all labellings."""
    out = np.zeros_like(u)
    alike = pii.alike()
    for y in itertools.product(range(u.shape[1]), repeat=len(u)):
        w = sum(u[i, k] for i, k in enumerate(y)) + sum(link[y[a], y[b]] for a, b in chain) + sum(same * alike[y[a], y[b]] for a, b in skip)
        for i, k in enumerate(y):
            out[i, k] += np.exp(w)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("chain,skip,close", [([(0, 1)], [], 1e-6), ([], [(0, 1)], 1e-6), ([(0, 1)], [(1, 2)], 1e-6), ([], [(0, 1), (0, 2)], 1e-6), ([(0, 1), (1, 2)], [(0, 2)], 0.1)])
def test_marginals(chain, skip, close):
    rng = np.random.default_rng(len(chain) + 3 * len(skip))
    u, link = rng.normal(size=(3, pii.L)), rng.normal(size=(pii.L, pii.L))
    edges = lambda e: np.array(e, int).reshape(-1, 2)
    found = pii.marginals(u, edges(chain), edges(skip), link, 1.0, rounds=60)
    assert np.abs(found - exact(u, chain, skip, link, 1.0)).max() < close


def test_held_out_sentences(model):
    texts, spans = pii.made_up(600, seed=99)
    nodes = list(pii.tokens(pa.array(texts, pa.large_string())))
    found = {(r, k, texts[r].encode()[s:e].decode()) for r, k, s, e in pii.decode(nodes, model, pii.Features())}
    want = {(r, k, texts[r][a:b].strip(pii._EDGE)) for r, own in enumerate(spans) for a, b, k in own}
    assert len(found & want) / len(want) > 0.9 and len(found & want) / len(found) > 0.9


def test_repeated_tokens_share_their_label(model):
    """A number that context names once is found where nothing names it, however far."""
    value = "4485275742308327"
    text = f"credit card {value} was charged.\n" + "plain words " * 3000 + f"\n{value} again"
    nodes = list(pii.tokens(pa.array([text], pa.large_string())))
    _, _, skip = pii.graph(nodes, pii.Features())
    assert skip.tolist() == [[0, 1]]
    assert [k for _, k, _, _ in pii.decode(nodes, model, pii.Features())] == ["CARD", "CARD"]


def test_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find_pii(docs, model).collect()
    assert rows and all(text[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in rows)
    import re

    mails = {(i, m[0]) for i, t in text.items() for m in re.finditer(r"[\w.+-]+@[\w-]+\.[\w.-]*\w", t or "")}
    assert mails <= {(r["doc_id"], r["value"]) for r in rows if r["type"] == "EMAIL"}


def test_defined_cases(spark, model):
    rows = [(1, "write to ann.lee@example.com now", "x"), (2, None, "x"), (3, "", "x"), (None, "call +1 (394) 555-4006", "x"), (1, "write to ann.lee@example.com now", "x"), (5, "word " * 100000 + "bob@example.org", "x"), (6, "no personal data in 2024, page 7", "x"), (7, "é\U0001f600 ann@example.com", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    out = pii.find_pii(docs, model).collect()
    assert [(r["start"], r["value"]) for r in out if r["doc_id"] == 1] == [(9, "ann.lee@example.com")] * 2
    assert {r["doc_id"] for r in out} == {1, None, 5, 7}
    assert next(r["start"] for r in out if r["doc_id"] == 5) == 500000 and next(r["start"] for r in out if r["doc_id"] == 7) == 3
    assert pii.find_pii(docs.limit(0), model).count() == 0
