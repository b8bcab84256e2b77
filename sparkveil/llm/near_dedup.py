"""Near-duplicate detection: SimHash fingerprints searched by the generalised pigeonhole principle.

A document's features are its distinct lower-cased words, weighted by the square root of their
number, in whole quarters; 256 bits are the signs of the sum of the words' random vectors. Two documents are near
duplicates if their first 128 bits differ in at most ``threshold`` places and all 256 in at most
``check``. Groups are connected components; the smallest doc_id stays.

Search: equal fingerprints are one node, so that thousands of copies are compared once. The 128 bits
are arranged in partitions that keep correlated bits together (correlations over all nodes). With
thresholds t_i whose sum of (t_i + 1) is threshold + 1, any pair within the threshold is within t_i
in some partition (generalised pigeonhole), so that the search is exact. Dynamic programming chooses
the thresholds, unequal where that is cheaper, from the keys that each needs and the candidate pairs
that it is estimated to raise, the latter from the distances of pseudo-random pairs of all nodes; the
number of partitions is the one of least cost. Candidates are probed by joining on key: for t = 0
the partition's bits; for t = 1 these and those with one set bit cleared (pairs meet at the common
bits); for t = 2 all keys within one bit (pairs meet halfway). Every candidate is verified. Keys are joined in
passes, by partition and by hash of the key, so that only those of one pass are on disk at a time; so are bands, below.

The fingerprints of short texts move far by a few words. Pairs whose sets of 3-word shingles have a Jaccard
similarity of ``alike`` are therefore near duplicates too, at any length. Candidates meet in one of 32 bands
of three MinHash values (at 0.5, 98.6 % of pairs do, at 0.6, 99.9 %), are left out if their numbers of shingles
alone exclude the similarity, and are verified on 32 bits of their shingles' hashes: on all if both texts have
at most 1,024, else on the least hashes of each. Their distance can be above ``threshold``.

Texts with equal fingerprints and equal sets of shingles are one class: candidates, links and groups are found
between classes, and documents join their class at the end.

Defined cases: rows with null doc_id or text, and texts without words, are like nothing and stay;
rows that repeat a doc_id are one document if their class is equal, else each is judged by its own text;
texts of fewer than three words have no shingles; a very long text is read whole, in blocks; of equal
distances and candidates none is preferred, all count; an empty table has no groups; extra columns pass
through the filter untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, clean_text, discard, join_unique, matching, materialize, mix64, pieces, without

THRESHOLD = 17
CHECK = 44
BITS = 128
#: Least Jaccard similarity of shingles.
ALIKE = 0.5
SHINGLE, BANDS, BAND_ROWS, SKETCH = 3, 32, 3, 1024
#: Bytes of text, and rows, that are worked on at once.
PIECE, ROWS = 400_000, 500
#: Cost of a candidate pair in rows of keys written, sorted and joined.
PAIR_COST = 0.1
PARTITIONS = range(3, 11)
#: Keys of a node that one pass of the search joins, about, and keys of all nodes that a pass may have in any case.
PASS, LEAST_PASS = 16, 2_000_000

_CHAR = np.zeros(256, np.uint8)  # bytes of words: letters, digits and all of other scripts
_CHAR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


_BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
    return out[0], out[1]


def _raw_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polynomial of each word of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _CHAR[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(1 << len(data).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        return start, end, (total[end] - total[start]) * inverse[start]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of lower-cased bytes."""
    start, end, raw = _raw_words(data)
    with np.errstate(over="ignore"):
        return start, end, mix64(raw)


def long_words(data: np.ndarray, block: int = PIECE) -> np.ndarray:
    """The hashes of words_of(), of bytes of any number read block by block; words may cross blocks."""
    out, held, size = [], 0, 0  # the polynomial and length of a word so far
    most = (1 << 64) - 1
    for at in range(0, len(data), block):
        own = data[at : at + block]
        start, end, raw = _raw_words(own)
        raw = raw.copy()
        if size:
            if len(start) and start[0] == 0:
                raw[0] = (held + int(raw[0]) * pow(_BASE, size, 1 << 64)) & most
                size += int(end[0])
            else:
                out.append(np.array([held], np.uint64))
                size = 0
        if len(end) and end[-1] == len(own):
            held, size = int(raw[-1]), size if len(end) == 1 and start[0] == 0 and size else int(end[-1] - start[-1])
            raw = raw[:-1]
        else:
            size = 0
        out.append(raw)
    if size:
        out.append(np.array([held], np.uint64))
    with np.errstate(over="ignore"):
        return mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def words_by_row(texts: pa.Array, most: int = PIECE, rows: int = ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, row from lo, hash) of the words in ranges of lower-cased texts of about so many bytes and rows."""
    for start, stop in pieces(buffer_of(texts)[1], most):
        for lo in range(start, stop, rows):
            hi = min(stop, lo + rows)
            data, off = buffer_of(texts.slice(lo, hi - lo))
            if hi - lo == 1:
                h = long_words(data, most)
                yield lo, hi, np.zeros(len(h), np.int64), h
                continue
            # a separator after each text, so that no word crosses into the next
            spaced = np.full(len(data) + hi - lo, 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.arange(hi - lo), np.diff(off))] = data
            at, _, h = words_of(spaced)
            yield lo, hi, np.searchsorted(off + np.arange(len(off)), at, "right") - 1, h


def signs(h: np.ndarray) -> np.ndarray:
    """256 values of +1 or -1 for each hash."""
    with np.errstate(over="ignore"):
        w = np.stack([mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(1, 5)], 1)
    return np.unpackbits(w.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def shingles_of(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of words (row, hash), ordered by both; words are ordered by row. Texts of
    fewer words have none."""
    if len(h) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = mix64((h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]).view(np.int64)
    inside = doc[2:] == doc[:-2]
    doc, s = doc[2:][inside], s[inside]
    if len(s) == 0:
        return doc, s
    for own in np.split(s, np.flatnonzero(doc[1:] != doc[:-1]) + 1):  # parts of s, sorted in place
        own.sort()
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], s[first]


def bands_of(row: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and a key for each band."""
    rows, at = np.unique(row, return_index=True)
    keys = np.zeros((len(rows), BANDS), np.uint64)
    if len(rows):
        salts = mix64(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64)).reshape(BANDS, BAND_ROWS, 2)
        with np.errstate(over="ignore"):
            for k in range(BANDS):
                for a, b in salts[k]:
                    keys[:, k] = mix64(keys[:, k] + np.minimum.reduceat(s.view(np.uint64) * (a | np.uint64(1)) ^ b, at))
                keys[:, k] += np.uint64(k)
    return rows, keys.view(np.int64)


def vectors_of(doc: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprints of so many rows from their words (row, hash) in any order: four 64-bit words each."""
    vocabulary, at = np.unique(h, return_inverse=True)
    key, n = np.unique(doc * max(1, len(vocabulary)) + at, return_counts=True)
    doc, own = key // max(1, len(vocabulary)), vocabulary[key % max(1, len(vocabulary))] if len(vocabulary) else h
    weight = np.rint(4 * np.sqrt(n)).astype(np.float32)  # whole numbers add up alike in any order
    v = np.zeros((rows, 256), np.float32)
    # words come by row, so that so many of them belong to few rows
    for g in range(0, len(key), 2048):
        first, last = doc[g], doc[min(g + 2048, len(key)) - 1]
        m = np.zeros((last - first + 1, min(2048, len(key) - g)), np.float32)
        m[doc[g : g + 2048] - first, np.arange(m.shape[1])] = weight[g : g + 2048]
        v[first : last + 1] += m @ signs(own[g : g + 2048])
    return np.packbits(v > 0, axis=1).view(np.int64)


def fingerprints_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four 64-bit words for each lower-cased text, and whether it has any words."""
    bits, some = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), bool)
    for lo, hi, doc, h in words_by_row(texts):
        bits[lo:hi] = vectors_of(doc, h, hi - lo)
        some[lo + np.unique(doc)] = True
    return bits, some


WORDS = ["f0", "f1", "f2", "f3"]


def set_hashes(row: np.ndarray, s: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each row's set of shingles; 0 for none."""
    with np.errstate(over="ignore"):
        total = np.zeros(rows, np.uint64)
        np.add.at(total, row, mix64(s.view(np.uint64)))
    return total.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, f0, f1, f2, f3, sh, keys) of the documents that have words: the hash of the text, the
    fingerprint, the hash of the set of shingles and the keys of its bands."""
    names = ["doc_id", "h", *WORDS, "sh", "keys"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, h in words_by_row(clean_text(b.column(2), True)):
                bits = vectors_of(doc, h, hi - lo)
                row, s = shingles_of(doc, h)
                sh = set_hashes(row, s, hi - lo)
                rows, keys = bands_of(row, s)
                ends = np.zeros(hi - lo + 1, np.int32)
                ends[rows + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.reshape(-1)))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *(pa.array(bits[:, k]) for k in range(4)), pa.array(sh), lists], names)
                yield out.take(pa.array(np.unique(doc)))

    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return own.mapInArrow(scan, "doc_id long, h long, f0 long, f1 long, f2 long, f3 long, sh long, keys array<long>")


def classes(fps: DataFrame) -> DataFrame:
    """(node, doc_id, f0, f1, f2, f3, sh, keys) of the classes, numbered by their smallest doc_id, or by a hash
    where that heads several."""
    found = fps.groupBy(*WORDS, "sh").agg(F.min(F.struct("doc_id", "keys")).alias("m")).select("m.doc_id", *WORDS, "sh", "m.keys")
    found = materialize(found, "classes")
    several = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        return found.select(F.col("doc_id").alias("node"), "*")
    apart = matching(found, [F.col("doc_id")], several).select(F.xxhash64(F.lit("class"), "doc_id", *WORDS, "sh").alias("node"), "*")
    nodes = materialize(without(found, [F.col("doc_id")], several).select(F.col("doc_id").alias("node"), "*").unionByName(apart), "nodes")
    discard(found, several)
    return nodes


def alike_pairs(docs: DataFrame, nodes: DataFrame, known: DataFrame, alike: float) -> DataFrame:
    """(a, b), a < b, of nodes whose texts' shingles are alike and that are not among the known pairs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, h in words_by_row(clean_text(b.column(1), True)):
                row, s = shingles_of(doc, h)
                rows, at, n = np.unique(row, return_index=True, return_counts=True)
                # ordered by the leading 32 bits, which are what is kept
                least = np.arange(len(row)) - np.repeat(at, n) < SKETCH
                ends = np.concatenate([[0], np.cumsum(np.minimum(n, SKETCH))]).astype(np.int32)
                sh = set_hashes(row, s, hi - lo)[rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(sh), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array((s[least] >> 32).astype(np.int32)))], ["doc_id", "sh", "n", "s"])

    def meet(lo: int, n: int) -> DataFrame:
        keyed = nodes.select("node", F.explode(F.slice("keys", lo + 1, n)).alias("key"))
        x, y = keyed.alias("x"), keyed.alias("y")
        return x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(known, ["a", "b"], "left_anti")

    step = BANDS if nodes.count() * BANDS <= LEAST_PASS else max(1, PASS // 2)  # a band's row has half the bytes of a key's
    met = together([meet(lo, step) for lo in range(0, BANDS, step)], "met")
    ids = materialize(met.select(F.col("a").alias("node")).union(met.select("b")).distinct().join(nodes, "node").select("node", "doc_id", "sh"), "met-ids")
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = matching(own, [F.col("doc_id")], ids.select("doc_id")).mapInArrow(sets, "doc_id long, sh long, n long, s array<int>")
    held = materialize(held.join(ids, ["doc_id", "sh"]).dropDuplicates(["node"]).select("node", "n", "s"), "shingles")
    size = lambda k: held.select(F.col("node").alias(k), F.col("n").alias("n" + k))
    fit = met.join(size("a"), "a").join(size("b"), "b").where(F.least("na", "nb") >= F.lit(alike) * F.greatest("na", "nb"))
    side = lambda k: held.select(F.col("node").alias(k), F.col("s").alias("s" + k))
    both = fit.join(side("a"), "a").join(side("b"), "b")
    # hashes up to the last that both sketches hold are a sample of the union
    both = both.withColumn("last", F.least(*(F.when(F.col("n" + k) > SKETCH, F.element_at("s" + k, -1)) for k in "ab"), F.lit((1 << 31) - 1)))
    upto = lambda k: F.size(F.filter(k, lambda v: v <= F.col("last")))
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (upto("sa") + upto("sb")).alias("n"))
    found = materialize(both.where(F.col("i") >= F.lit(alike) * (F.col("n") - F.col("i"))).select("a", "b").distinct(), "alike")
    discard(met, ids, held)
    return found


def unpack(b: pa.RecordBatch) -> np.ndarray:
    words = np.stack([b.column(b.schema.get_field_index(k)).to_numpy() for k in WORDS[:2]], 1)
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)


def _sums(nodes: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all batches of a matrix that partial() makes of their bits, added up by matrix row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += partial(unpack(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array([*total], pa.list_(pa.float64()))], ["r", "v"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table([t["r"].slice(0, 1), pa.array([np.stack(t["v"].to_numpy(zero_copy_only=False)).sum(0)], pa.list_(pa.float64()))], ["r", "v"])

    out = np.zeros(shape)
    for r in nodes.mapInArrow(each, "r long, v array<double>").groupBy("r").applyInArrow(add, "r long, v array<double>").collect():
        out[r["r"]] = r["v"]
    return out


def arrange(moments: np.ndarray, m: int) -> list[np.ndarray]:
    """m partitions of the bits, as even as can be, each grown from a bit by adding the most correlated ones.

    moments: of the bits with a constant 1 as the last, summed over all nodes.
    """
    n = max(moments[-1, -1], 1)
    mean = moments[:-1, -1] / n
    cov = moments[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(cov.diagonal(), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = [*range(BITS)], []
    for k in range(m):
        width = len(left) // (m - k)
        own = [left[int(corr[np.ix_(left, left)].sum(1).argmax())]]
        left.remove(own[0])
        while len(own) < width:
            own.append(left[int(corr[np.ix_(left, own)].sum(1).argmax())])
            left.remove(own[-1])
        out.append(np.array(own))
    return out


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """The thresholds of least cost: costs[i, t + 1] is that of threshold t, -1 to 2, in partition i, and
    the sum of (t + 1) is total."""
    best = [(0.0, ())] + [(np.inf, ())] * total
    for own in costs:
        best = [min(((best[s - u][0] + own[u], best[s - u][1] + (u - 1,)) for u in range(min(s, len(own) - 1) + 1)), key=lambda x: x[0]) for s in range(total + 1)]
    return best[total][0], [*best[total][1]]


def plan(nodes: DataFrame, threshold: int) -> list[tuple[np.ndarray, int]]:
    """Partitions and their thresholds, as the module's docstring says."""

    def moments(bits: np.ndarray) -> np.ndarray:
        x = np.concatenate([bits, np.ones((len(bits), 1), np.uint8)], 1).astype(np.float32)
        return (x.T @ x).astype(float)

    sums = _sums(nodes, moments, (BITS + 1, BITS + 1))
    n = sums[-1, -1]
    tried = {m: arrange(sums, m) for m in PARTITIONS if 3 * m >= threshold + 1}
    which = np.zeros((BITS, sum(tried)), np.float32)
    for k, part in enumerate(p for parts in tried.values() for p in parts):
        which[part, k] = 1

    def distances(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((which.shape[1], 4))
        # neighbours in a table that is ordered by nothing but hash are pseudo-random pairs
        for shift in range(1, min(9, len(bits))):
            d = (bits[shift:] ^ bits[:-shift]).astype(np.float32) @ which
            for t in range(3):
                out[:, t] += (d <= t).sum(0)
            out[:, 3] += len(d)
        return out

    seen = _sums(nodes, distances, (which.shape[1], 4))
    best: tuple[float, list] = (np.inf, [])
    k = 0
    for m, parts in tried.items():
        costs = np.zeros((m, 4))
        for i, part in enumerate(parts):
            b = len(part)
            p = sums[part, -1] / max(n, 1)
            alike = 1 - 2 * p * (1 - p)  # chance that two nodes agree in a bit
            none = alike.prod()
            odds = (1 - alike) / alike
            one, two = none * odds.sum(), none * (odds.sum() ** 2 - (odds**2).sum()) / 2
            model = np.cumsum([none, one, two])
            share = np.maximum(model, seen[k, :3] / max(seen[k, 3], 1))
            meets = np.array([1, 1 + b / 8, 3])
            rows = np.array([1, 1 + b / 2, 1 + b])
            costs[i, 1:] = n * rows + PAIR_COST * n * n / 2 * share * meets
            k += 1
        cost, ts = allocate(costs, threshold + 1)
        if cost < best[0] or not best[1]:
            best = cost, [(part, t) for part, t in zip(parts, ts) if t >= 0]
    return best[1]


def keys_of(bits: np.ndarray, partitions: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all rows one after the other, how each was made, and the number of each row's keys.

    A key is the partition's number above its bits. It is made by 0 if the bits are the row's own, by the
    flipped bit, counted from 1, for threshold 2, and by -1 if a bit was cleared for threshold 1. A pair
    meets at many keys of a partition, at exactly one of which the first row's is made by 0 or by less
    than the second's, either way round being tried once (``MEET``).
    """
    columns, made, masks = [], [], []
    for i, (part, t) in enumerate(partitions):
        value = 1 << np.arange(len(part), dtype=np.int64)
        own = bits[:, part].astype(np.int64)
        key = own @ value
        top = np.int64(i) << np.int64(44)
        columns.append((key | top)[:, None])
        made.append(np.zeros(1, np.int8))
        masks.append(np.ones((len(bits), 1), bool))
        if t:
            columns.append((key[:, None] ^ value[None, :]) | top)
            made.append(np.full(len(part), -1, np.int8) if t == 1 else np.arange(1, len(part) + 1, dtype=np.int8))
            masks.append(own.astype(bool) if t == 1 else np.ones(own.shape, bool))
    keys, mask = np.concatenate(columns, 1), np.concatenate(masks, 1)
    return keys[mask], np.broadcast_to(np.concatenate(made), mask.shape)[mask], mask.sum(1)


#: Within a partition a pair counts once: both keys their rows' own, or the one way of two to meet halfway.
MEET = "(x.k & 255) = 1 or (y.k & 255) > (x.k & 255)"


def passes(partitions: list[tuple[np.ndarray, int]], n: int) -> list[tuple[list[tuple[np.ndarray, int]], int, int]]:
    """(partitions, k, of) of the passes for n nodes: those of the partitions' keys whose hash is k modulo of."""
    most = max(PASS, LEAST_PASS / max(1, n))
    out, left = [], most
    for part, t in partitions:
        keys = (1, 1 + len(part) / 2, 1 + len(part))[t]
        of = int(-(-keys // most))
        if of > 1:
            out += [([(part, t)], k, of) for k in range(of)]
            left = 0
        elif out and keys <= left:
            out[-1][0].append((part, t))
            left -= keys
        else:
            out.append(([(part, t)], 0, 1))
            left = most - keys
    return out


def together(parts: list[DataFrame], name: str) -> DataFrame:
    """The distinct rows of all parts, written one after the other."""
    if len(parts) == 1:
        return materialize(parts[0], name)
    parts = [materialize(p, name + "-part") for p in parts]
    out = materialize(reduce(DataFrame.unionByName, parts).distinct(), name)
    discard(*parts)
    return out


def pairs(nodes: DataFrame, threshold: int = THRESHOLD, check: int = CHECK) -> DataFrame:
    """(a, b), a < b, of all nodes (node, f0 to f3) that are near duplicates, each pair once."""
    differ = lambda a, b, words: sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words), F.lit(0))

    def one(partitions: list[tuple[np.ndarray, int]], k: int, of: int) -> DataFrame:
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    b = whole.slice(at, 2000)
                    keys, made, n = keys_of(unpack(b), partitions)
                    ends = np.concatenate([[0], np.cumsum(n)])
                    if of > 1:
                        own = mix64(keys.view(np.uint64)) % np.uint64(of) == k
                        keys, made, ends = keys[own], made[own], np.concatenate([[0], np.cumsum(own)])[ends]
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys << np.int64(8) | (made + np.int64(1))))
                    yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(3)), lists], ["node", "f0", "f1", "keys"])

        # key and manner stay in one number until after the shuffle
        probes = nodes.select("node", "f0", "f1").mapInArrow(probe, "node long, f0 long, f1 long, keys array<long>").select("node", "f0", "f1", F.explode("keys").alias("k"))
        x, y = probes.alias("x"), probes.alias("y")
        near = x.join(y.hint("merge"), (F.shiftright("x.k", 8) == F.shiftright("y.k", 8)) & (F.col("x.node") < F.col("y.node")) & F.expr(MEET) & (differ("x", "y", WORDS[:2]) <= threshold))
        return near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    found = together([one(*p) for p in passes(plan(nodes, threshold), nodes.count())], "pairs")
    # the other 128 bits come by join, as the pairs are few beside the probes
    own = nodes.select("node", *WORDS)
    a, b = own.alias("na"), own.alias("nb")
    full = found.join(a, F.col("a") == F.col("na.node")).join(b, F.col("b") == F.col("nb.node"))
    return full.where(differ("na", "nb", WORDS) <= check).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b), root being the smallest of its component.

    Alternates large-star and small-star steps; each is a join and an aggregation, written to the
    shared folder, and the number of rounds grows with the logarithm of a component's size.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = materialize(large, "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        small = materialize(small, "small")
        state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        done = state(small) == state(edges)
        discard(large, edges)
        edges = small
        if done:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _found(docs: DataFrame, threshold: int, check: int, alike: float | None) -> DataFrame:
    """(doc_id, h, dup_of, distance, links) of rows that are not the first of their group; h is the text's hash."""
    whole = materialize(fingerprints(docs), "fingerprints")
    nodes = classes(whole)
    fps = materialize(whole.select("doc_id", "h", *WORDS, "sh"), "fingerprints")  # only classes need the keys of bands
    discard(whole)
    edges = materialize(pairs(nodes, threshold, check), "near")
    if alike is not None:
        edges = edges.union(alike_pairs(docs, nodes, edges, alike))
    links = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    of = nodes.select("node", "doc_id", *WORDS, "sh").join(components(edges), "node", "left").join(links, "node", "left")
    of = materialize(of.select("*", F.coalesce("root", "node").alias("group")).drop("root"), "groups")
    # of each group the smallest doc_id, and of its texts the first by fingerprint
    head = of.groupBy("group").agg(F.min(F.struct("doc_id", *WORDS, "sh")).alias("first"))
    with_head = join_unique(of.select("node", *WORDS, "sh", "links", "group"), head, "group")
    tag = lambda df: df.withColumn("class", F.xxhash64(*WORDS, "sh"))
    kinds = tag(with_head).select("class", *[F.col(w).alias("n" + w) for w in [*WORDS, "sh"]], "first", F.coalesce("links", F.lit(0)).alias("links"))
    rows = join_unique(tag(fps.select("doc_id", "h", *WORDS, "sh")), kinds, "class")
    same = lambda side: F.expr(" and ".join(f"{w} = {side(w)}" for w in [*WORDS, "sh"]))
    rows = rows.where(same(lambda w: "n" + w)).where((F.col("doc_id") != F.col("first.doc_id")) | ~same(lambda w: "first." + w))
    distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("first.f0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("first.f1")))
    return rows.select("doc_id", "h", F.col("first.doc_id").alias("dup_of"), distance.alias("distance"), "links")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, check: int = CHECK, alike: float | None = None) -> DataFrame:
    """(doc_id, dup_of, distance, links): each document that goes as it is near another of its group, the
    smallest doc_id of which is dup_of and stays; distance is in the first 128 bits, links the number of different
    texts near its own. Without alike, fingerprints alone decide."""
    found = _found(docs, threshold, check, alike)
    return found.groupBy("doc_id").agg(F.min(F.struct("dup_of", "distance", "links")).alias("d")).select("doc_id", "d.dup_of", "d.distance", "d.links")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, check: int = CHECK, alike: float | None = ALIKE) -> DataFrame:
    """docs with one document of each group."""
    gone = materialize(_found(docs, threshold, check, alike).select("doc_id", "h"), "near-copies")
    return without(docs, [docs["doc_id"].cast("long"), F.xxhash64(docs["text"])], gone)
