"""SimHash near-dedup against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import near_dedup as nd
from sparkveil.llm.common import materialize

WORDS = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "omega", "kappa", "zeta", "eta", "theta", "iota", "mu", "nu", "xi", "pi", "phi", "chi", "psi"]


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 200)) for _ in range(n))


def corpus():
    r = random.Random(5)
    rows = [(i, text(r, r.randint(20, 120))) for i in range(300)]
    for i in range(120):  # near copies: some words replaced
        words = rows[i % 40][1].split()
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = text(r, 1)
        rows.append((1000 + i, " ".join(words)))
    return rows


def brute_pairs(rows, threshold, check):
    bits, some = nd.fingerprints_of(pa.array([t.lower() for _, t in rows], pa.large_string()))
    b = np.unpackbits(bits.view(np.uint8), axis=1).astype(int)
    d128 = (b[:, None, :128] != b[None, :, :128]).sum(2)
    d256 = (b[:, None, :] != b[None, :, :]).sum(2)
    return {(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in zip(*np.nonzero((d128 <= threshold) & (d256 <= check))) if i < j and some[i] and some[j]}


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("threshold,check", [(17, 44), (8, 30), (3, 256)])
def test_pairs_equal_brute_force(spark, threshold, check):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = nd.classes(materialize(nd.fingerprints(docs), "fingerprints"))
    kept = {r["node"] for r in nodes.collect()}
    found = [(r["a"], r["b"]) for r in nd.pairs(nodes, threshold, check).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {p for p in brute_pairs(rows, threshold, check) if set(p) <= kept}
    assert threshold < 17 or len(found) > 20


@pytest.mark.parametrize("ts", [[0] * 4, [1] * 4, [2] * 4, [2, 1, 0, -1]])
def test_every_close_pair_meets_once_in_a_partition(ts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (200, 128), dtype=np.uint8)
    other = base ^ (rng.random((200, 128)) < 0.06).astype(np.uint8)
    parts = [(p, t) for p, t in zip(np.array_split(rng.permutation(128), 4), ts) if t >= 0]
    (ka, ma, na), (kb, mb, nb) = nd.keys_of(base, parts), nd.keys_of(other, parts)
    ea, eb = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
    for i in range(200):
        for number, (part, t) in enumerate(parts):
            meets = [(x, y) for k, x in zip(ka[ea[i] : ea[i + 1]], ma[ea[i] : ea[i + 1]]) for q, y in zip(kb[eb[i] : eb[i + 1]], mb[eb[i] : eb[i + 1]]) if k == q and k >> 44 == number and (x == 0 or y > x)]
            distance = int((base[i, part] != other[i, part]).sum())
            assert len(meets) == (distance <= t), (t, distance)


def test_groups_and_distance(spark):
    rows = corpus()
    found = {r["doc_id"]: r["dup_of"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {x: r for x, r in roots(brute_pairs(rows, nd.THRESHOLD, nd.CHECK)).items() if x != r}
    assert found == want


def test_allocate_is_least():
    costs = np.random.default_rng(1).random((5, 4)) * 10
    costs[:, 0] = 0
    best, ts = nd.allocate(costs, 7)
    assert sum(t + 1 for t in ts) == 7 and abs(sum(costs[i, t + 1] for i, t in enumerate(ts)) - best) < 1e-9
    import itertools

    assert best == pytest.approx(min(sum(costs[i, u] for i, u in enumerate(us)) for us in itertools.product(range(4), repeat=5) if sum(us) == 7))


def test_defined_cases(spark):
    schema = "doc_id long, text string, dup_of string, node int, f0 string, key long"
    rows = [(1, "one two three four five", "a", 1, "q", 1), (2, "One, two; three four FIVE!", "b", 1, None, 2), (3, None, None, None, None, None), (None, "one two three four five", "c", 2, "", 3), (4, "", "", 0, "", 0), (5, "...", "", 0, "", 0), (6, "  \n", "", 0, "", 0), (1, "one two three four five", "a", 1, "q", 1), (7, "word " * 50000, "long", 7, "", 9), (8, "word " * 50000 + "x", "long", 7, "", 9)]
    docs = spark.createDataFrame(rows, schema)
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 1, 3, 4, 5, 6, 7, None]
    assert nd.near_duplicates(docs.limit(0)).count() == 0
    assert nd.drop_near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a.split(), b.split()))
    return len(a & b) / max(1, len(a | b))


def test_short_near_copies_are_found_by_similarity(spark):
    r, rows = random.Random(6), []
    for i in range(300):
        n = r.choice([12, 25, 40, 80, 150, 1500])
        a = text(r, n).split()
        b, at, k = list(a), r.randrange(n * 3 // 4), max(1, n // r.choice([5, 6, 8, 12]))
        b[at : at + k] = text(r, min(k, n - at)).split()
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {i for i in range(300) if jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.5}
    short = {i for i in near if len(rows[2 * i][1].split()) < 100}
    found = {x["doc_id"]: x["dup_of"] for x in nd.near_duplicates(docs, alike=nd.ALIKE).collect()}
    assert len(short) > 80
    assert sum(found.get(2 * i + 1) == 2 * i for i in near) >= 0.98 * len(near)
    assert sum(found.get(2 * i + 1) == 2 * i for i in short) >= 0.98 * len(short)
    assert all(x // 2 == y // 2 for x, y in found.items())
    kept = {x["doc_id"] for x in nd.drop_near_duplicates(docs).collect()}
    assert kept == {x for x, _ in rows} - set(found)


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_long_words_cross_blocks(block):
    r = random.Random(block)
    data = np.frombuffer("".join(r.choice("abc é.,  \n") for _ in range(500)).encode() + b"x" * 40, np.uint8)
    assert (nd.long_words(data, block) == nd.words_of(data)[2]).all()


def test_links_are_those_of_brute_force(spark):
    rows = corpus()
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    degree = {}
    for a, b in brute_pairs(rows, nd.THRESHOLD, nd.CHECK):
        degree.setdefault(a, set()).add(dict(rows)[b])
        degree.setdefault(b, set()).add(dict(rows)[a])
    texts = dict(rows)
    assert all(r["links"] == len(degree[r["doc_id"]] - {texts[r["doc_id"]]}) for r in found)


def test_texts_of_one_doc_id_are_judged_apart(spark):
    r = random.Random(3)
    a, b = text(r, 60), text(r, 60)
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (3, a.upper()), (4, text(r, 60))]
    kept = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["text"]) for x in kept) == sorted([rows[0], rows[2], rows[5]])


def test_a_hot_text_is_split(spark):
    r = random.Random(2)
    hot = text(r, 40)
    rows = [(i, hot if i % 3 == 0 else text(r, 40)) for i in range(1500)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), alike=nd.ALIKE).collect()
    assert {x["doc_id"]: x["dup_of"] for x in found} == {i: 0 for i in range(3, 1500, 3)}


def test_passes_hold_few_keys_and_lose_no_pair(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = nd.classes(materialize(nd.fingerprints(docs), "fingerprints"))
    n = nodes.count()
    once = sorted(map(tuple, nd.pairs(nodes).collect()))
    met = sorted(map(tuple, nd.alike_pairs(docs, nodes, nd.pairs(nodes), nd.ALIKE).collect()))
    monkeypatch.setattr(nd, "LEAST_PASS", 0)
    monkeypatch.setattr(nd, "PASS", 9)
    partitions = nd.plan(nodes, nd.THRESHOLD)
    all_keys = sum(nd.keys_of(np.stack([nd.unpack(b)[0] for b in nodes.toArrow().to_batches(1)]), partitions)[2])
    found = nd.passes(partitions, n)
    assert len(found) >= all_keys / n / 9 > 2
    assert all(sum((1, 1 + len(part) / 2, 1 + len(part))[t] for part, t in own) / of <= 9 for own, _, of in found)
    assert sorted(map(tuple, nd.pairs(nodes).collect())) == once
    assert len(once) > 20 and set(once) == {p for p in brute_pairs(rows, nd.THRESHOLD, nd.CHECK) if set(p) <= {r["node"] for r in nodes.collect()}}
    assert sorted(map(tuple, nd.alike_pairs(docs, nodes, nd.pairs(nodes), nd.ALIKE).collect())) == met


def test_words_are_multiplied_for_their_own_rows(monkeypatch):
    """The work grows with the words, not with rows times different words, and the fingerprints are those of each row alone."""
    rng, signs, work = np.random.default_rng(5), nd.signs, []
    doc = np.sort(rng.integers(0, 300, 30_000))
    h = rng.integers(0, 1 << 16, 30_000, dtype=np.uint64)

    class Seen(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kw):
            if ufunc is np.matmul:
                work.append(inputs[0].size)
            return getattr(ufunc, method)(*map(np.asarray, inputs), **kw)

    monkeypatch.setattr(nd, "signs", lambda x: signs(x).view(Seen))
    own = nd.vectors_of(doc, h, 301)
    assert 0 < sum(work) < 50 * len(h)
    for r in (0, 7, 299):
        words, n = np.unique(h[doc == r], return_counts=True)
        total = (signs(words) * np.rint(4 * np.sqrt(n))[:, None]).sum(0)
        assert (np.packbits(total > 0).view(np.int64) == own[r]).all()
    assert not own[300].any()
    row, s = nd.shingles_of(doc, h)
    assert (np.lexsort((s, row)) == np.arange(len(row))).all() and len(np.unique(np.stack([row, s], 1), axis=0)) == len(row)
    assert len(nd.shingles_of(np.arange(9), h[:9])[0]) == 0
