"""Language-model scoring by compression: cross-entropies under two zstandard dictionaries.

A dictionary is a cheap language model: a text like those it was made of compresses better with it.
Each document is compressed with an in-domain dictionary (made from documents labelled good) and a
general one (made from all documents); with g and i the sizes, the score is (g - i) / (g + i), above 0
for text nearer the domain.

What is learnt of the corpus grows with it: there is a pair of dictionaries for each *shelf*, a run of about
``SHELF`` bytes of texts in the order of a key, which is the least hash of a text's 32-byte windows, so that
texts that share passages lie on one shelf. Within a shelf all windows are counted; the general dictionary takes
segments by the windows that occur again and no segment taken before has. The in-domain dictionary takes them
from the shelf's documents labelled good, after those of the whole corpus's domain: a dictionary of all documents
labelled good. All their windows are counted, each once in a text (in a text above a piece, in each of its parts);
of the windows that most texts have the best segments of all texts are taken.

Shelves are cut in ranges of about ``RANGE`` bytes, to which texts go by hash of their key, so each text is moved
once. Keys that more than a thousandth of all rows have go by hash of the row instead, so that no range
holds them all. A task reads its range in order and holds one shelf.

Defined cases: null or empty text has no sizes and a null score; documents without labels count for the
general dictionary alone; without in-domain documents, or in an empty table, the dictionary in question
is empty, so that scores tend to one sign but exist; rows that repeat doc_id and text count once and are scored
alike; repeated labels count once; a document with contradicting labels is in-domain if any row says so; a very
long text is read whole, in blocks, and makes a shelf with what comes before it; segments of equal value are
taken in the order of the shelf; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, clean_text, discard, heavy, join_unique, matching, materialize, mix64, pieces, without

WINDOW = 32
SEGMENT = 256
#: Windows of a segment that must occur again for it to be taken: more than seem to by chance of their hashes.
LEAST = 16
DICTIONARY = 112 * 1024
SHELF = 1 << 20
RANGE = 32 << 20
#: Distance of segments of the domain's dictionary, so that each window lies in one.
STEP = SEGMENT - WINDOW + 1
#: Bits of the filter before the search for a window.
MAYBE = 23
LEVEL = 3
PIECE = 1 << 20


def windows(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes that start at each position."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, WINDOW, 8):
            h = (h + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


def _inside(off: np.ndarray, n: int) -> np.ndarray:
    """Which of n window starts lie with their bytes in one text."""
    ok = np.ones(n, bool)
    for k in range(1, WINDOW):
        at = off[1:] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def _blocks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about a piece, each of whole segments: (start, end); windows may reach beyond."""
    for lo, hi in pieces(off, PIECE):
        if hi - lo > 1 or off[hi] - off[lo] <= PIECE:
            yield int(off[lo]), int(off[hi])
        else:
            step = PIECE // SEGMENT * SEGMENT
            yield from ((s, min(s + step, int(off[hi]))) for s in range(int(off[lo]), int(off[hi]), step))


def keys_of(texts: pa.Array) -> np.ndarray:
    """The least hash of each text's windows, spread evenly; of a text without windows, the hash of its bytes."""
    data, off = buffer_of(texts)
    out = np.full(len(texts), (1 << 64) - 1, np.uint64)
    for s, e in _blocks(off):
        h = windows(data[s : e + WINDOW - 1])[: e - s]
        h = np.where(_inside(np.clip(off - s, 0, None), len(h)), h, np.uint64((1 << 64) - 1))
        lo, hi = int(np.searchsorted(off, s, "right")) - 1, int(np.searchsorted(off, e, "left"))
        for k in range(lo, hi) if hi - lo == 1 else [None]:
            if k is not None and len(h):
                out[k] = min(out[k], h.min())
        if hi - lo > 1 and len(h):
            at = off[lo:hi] - s
            some = (np.diff(off[lo : hi + 1]) > 0) & (at < len(h))
            out[lo:hi][some] = np.minimum(out[lo:hi][some], np.minimum.reduceat(h, at[some]))
    none = out == np.uint64((1 << 64) - 1)
    for k in np.flatnonzero(none):
        own = data[off[k] : off[k + 1]].astype(np.uint64)
        with np.errstate(over="ignore"):
            out[k] = np.bitwise_xor.reduce(mix64((own + np.uint64(1)) * mix64(np.arange(1, len(own) + 1, dtype=np.uint64)))) if len(own) else 0
    return mix64(out).view(np.int64)


def dictionary(data: np.ndarray, off: np.ndarray, wanted: np.ndarray, size: int) -> bytes:
    """Segments of the wanted texts by the number of their windows that occur again in wanted texts and are in no
    segment taken before, the first at the end."""
    bits = min(23, max(16, len(data).bit_length() + 4))
    # a window occurs again if both its places in two tables say so
    again = np.zeros((2, 1 << bits), bool)
    flags = np.repeat(wanted, np.diff(off))

    def places(s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        h = windows(data[s : e + WINDOW - 1])[: e - s]
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    if len(data) <= 4 * PIECE:
        h = windows(data)
        h = np.sort(h[_inside(off, len(h)) & flags[: len(h)]])
        twice = h[1:][h[1:] == h[:-1]]
        again[0, twice >> np.uint64(64 - bits)] = again[1, twice & np.uint64((1 << bits) - 1)] = True
    else:
        count = np.zeros((2, 1 << bits), np.int64)
        for s, e in _blocks(off):
            both = places(s, e)
            ok = _inside(np.clip(off - s, 0, None), len(both[0])) & flags[s : s + len(both[0])]
            for k, w in enumerate(both):
                count[k] += np.bincount(w[ok], minlength=1 << bits)
        again = count > 1
        del count
    starts, ends, values = [], [], []
    for s, e in _blocks(off):
        w, v = places(s, e)
        ok = _inside(np.clip(off - s, 0, None), len(w)) & flags[s : s + len(w)]
        total = np.concatenate([[0], np.cumsum(ok & again[0][w] & again[1][v]), np.zeros(e - s - len(w), np.int64)])
        total[len(w) + 1 :] = total[len(w)]
        lo, hi = int(np.searchsorted(off, s, "right")) - 1, int(np.searchsorted(off, e, "left"))
        first, last = np.maximum(off[lo:hi], s), np.minimum(off[lo + 1 : hi + 1], e)
        n = -(-(last - first) // SEGMENT) * wanted[lo:hi]
        own = np.repeat(np.arange(hi - lo), n)
        a = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
        b = np.minimum(a + SEGMENT, last[own])
        starts.append(a)
        ends.append(b)
        values.append(total[b - s] - total[a - s])
    if not starts:
        return b""
    starts, ends, values = map(np.concatenate, (starts, ends, values))
    covered, out, used = np.zeros(1 << bits, bool), [], 0
    for k in np.argsort(-values, kind="stable"):
        if values[k] < LEAST or used >= size:
            break
        s, e = int(starts[k]), int(ends[k])
        w, v = places(s, e)
        w = w[again[0][w] & again[1][v]]
        if 2 * np.count_nonzero(~covered[w]) < values[k]:
            continue
        covered[w] = True
        out.append(data[s:e].tobytes())
        used += e - s
    return b"".join(reversed(out))[-size:]


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**options)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=data, **options)


def sizes(data: np.ndarray, off: np.ndarray, general: bytes, domain: bytes, level: int = LEVEL) -> np.ndarray:
    """Compressed sizes of each text under the general and the in-domain dictionary."""
    g, d, raw = compressor(general, level), compressor(domain, level), memoryview(data.tobytes())
    return np.array([[len(g.compress(raw[s:e])), len(d.compress(raw[s:e]))] for s, e in zip(off[:-1].tolist(), off[1:].tolist())], float).reshape(-1, 2)


def shelf_dictionaries(data: np.ndarray, off: np.ndarray, good: np.ndarray, domain: bytes, size: int) -> tuple[bytes, bytes]:
    """The general and the in-domain dictionary of one shelf. domain: that of the whole corpus."""
    own = dictionary(data, off, good, size) if good.any() else b""
    return dictionary(data, off, np.ones(len(off) - 1, bool), size), (domain + own)[-size:]


def in_domain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The doc_ids labelled good, each once, and known to docs."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select("doc_id").where("doc_id is not null").distinct().join(good, "doc_id")


def texts_in(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text; long ones in parts of about a piece, so that each window is in one part."""
    data, off = buffer_of(texts)
    step = max(1, PIECE // STEP) * STEP
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        for s in range(lo, hi, step):
            yield data[s : min(hi, s + step + WINDOW - 1)]


def recurring(texts: DataFrame, n_bytes: int, total: int, most: int) -> list[DataFrame]:
    """Tables (w, n, tie) of windows that n > 1 of the texts have, counted over all texts. Of each range of hashes the ``most``
    windows of greatest (n, tie), so that the ``most`` of the whole are among them.

    Passes move the hashes, 8 bytes for each byte of text, so that each moves about as much as the corpus at most.
    """
    passes = max(1, -(-8 * n_bytes // max(1, total)))
    ranges = max(1, -(-8 * n_bytes // (passes * RANGE)))
    bounds = np.array([k * (1 << 64) // ranges for k in range(1, ranges)], np.uint64)
    names = ["range", "once", "more", "n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
        for b in batches:
            for held, column, kind in zip(got, b.columns[1:], (np.uint64, np.uint64, np.int64)):
                held.append(buffer_of(column.cast(pa.large_binary()))[0].copy().view(kind))
        w, n = np.unique(np.concatenate(got[0]), return_counts=True)
        more, at = np.unique(np.concatenate(got[1]), return_inverse=True)
        plus = np.bincount(at, np.concatenate(got[2]), len(more)).astype(np.int64)
        place = np.searchsorted(w, more)
        known = place < len(w)
        known[known] = w[place[known]] == more[known]
        n[place[known]] += plus[known]
        w, n = np.concatenate([w[n > 1], more[~known]]), np.concatenate([n[n > 1], plus[~known]])
        tie = mix64(w).view(np.int64)
        best = np.lexsort((tie, n))[::-1][:most]
        yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (w.view(np.int64), n, tie)], ["w", "n", "tie"])

    def one(k: int) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.zeros(0, np.uint64)]
                for part in texts_in(clean_text(b.column(0))):
                    h = windows(part)
                    h = np.sort(h[h % np.uint64(passes) == k] if passes > 1 else h)
                    found.append(h[np.diff(h, prepend=~h[:1]) != 0])
                w, n = np.unique(np.concatenate(found), return_counts=True)
                once, more, n = w[n == 1], w[n > 1], n[n > 1].astype(np.int64)
                cut = lambda x, of: np.split(x, np.searchsorted(of, bounds))
                rows = [[x.tobytes() for x in cut(y, of)] for y, of in ((once, once), (more, more), (n, more))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), *(pa.array(x, pa.binary()) for x in rows)], names)

        moved = texts.mapInArrow(count, "range int, once binary, more binary, n binary").repartitionById(ranges, F.col("range"))
        return materialize(moved.mapInArrow(add, "w long, n long, tie long"), "windows")

    return [one(k) for k in range(passes)]


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` windows of greatest (n, tie) of recurring(), in order of their hashes, and their numbers."""
    left, parts = most, []
    for n, count in sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True):
        if count > left:
            # ties are evenly spread, so that few more than are needed are ordered
            share = min(1.0, (1.1 * left + 64) / count)
            tied = counts.where((F.col("n") == n) & (F.col("tie") >= int((1 << 63) * (1 - 2 * share)) if share < 1 else F.col("n") == n))
            parts.append(tied.orderBy(F.desc("tie")).limit(left))
            break
        left, least = left - count, n
    if left < most:
        parts.append(counts.where(F.col("n") >= least))
    found = [p.select("w", "n").toArrow() for p in parts]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w, n = (np.concatenate([t[k].to_numpy() for t in found]) for k in ("w", "n"))
    w = w.view(np.uint64)
    order = np.argsort(w)
    return w[order], n[order]


def held_in(part: np.ndarray, top: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in top) of the windows among top, each once in a segment; every window is in one segment."""
    h = windows(part)
    at = np.flatnonzero(maybe[h >> np.uint64(64 - MAYBE)])
    place = np.searchsorted(top, h[at])
    ok = place < len(top)
    ok[ok] = top[place[ok]] == h[at[ok]]
    both = np.unique(at[ok] // STEP * len(top) + place[ok])
    return both // max(1, len(top)), both % max(1, len(top))


def filter_of(top: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << MAYBE, bool)
    maybe[top >> np.uint64(64 - MAYBE)] = True
    return maybe


def best_segments(texts: Iterator[pa.Array], top: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each window of top the segment, of all that hold it, whose windows have the greatest sum of n; of equal sums
    that of the greatest hash. It doesn't matter in which order, or first of which texts, segments are found."""
    maybe = filter_of(top)
    value, tie, owner = np.zeros(len(top), np.int64), np.zeros(len(top), np.uint64), np.full(len(top), -1)
    kept: list[bytes] = []
    for array in texts:
        for part in texts_in(array):
            own, place = held_in(part, top, maybe)
            if not len(own):
                continue
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sums = np.add.reduceat(n[place], starts)
            may = np.maximum.reduceat(np.repeat(sums, np.diff(starts, append=len(own))) >= value[place], starts)
            for k in np.flatnonzero(may).tolist():
                at = place[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(own)]
                s = int(own[starts[k]]) * STEP
                segment = part[s : s + SEGMENT].tobytes()
                mark = np.uint64(int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little"))
                at = at[(sums[k] > value[at]) | ((sums[k] == value[at]) & (mark > tie[at]))]
                if len(at):
                    value[at], tie[at], owner[at] = sums[k], mark, len(kept)
                    kept.append(segment)
            if len(kept) > 2 * len(top):  # forget those that have lost all their windows
                used, owner = np.unique(owner, return_inverse=True)
                if used[0] < 0:
                    used, owner = used[1:], owner - 1
                kept = [kept[k] for k in used.tolist()]
    return sorted({kept[k] for k in set(owner[owner >= 0].tolist())})


def cover(segments: list[bytes], top: np.ndarray, n: np.ndarray, size: int) -> bytes:
    """Segments by the sum of n of their windows, but those half of which is in segments taken before, the first at the end."""
    maybe, covered, out, used = filter_of(top), np.zeros(len(top), bool), [], 0
    places = [held_in(np.frombuffer(s, np.uint8), top, maybe)[1] for s in segments]
    values = [int(n[p].sum()) for p in places]
    for k in sorted(range(len(segments)), key=lambda k: (-values[k], segments[k])):
        if used >= size:
            break
        if 2 * n[places[k][~covered[places[k]]]].sum() >= values[k]:
            covered[places[k]] = True
            out.append(segments[k])
            used += len(segments[k])
    return b"".join(reversed(out))[-size:] if out else b""


def domain_dictionary(docs: DataFrame, known: DataFrame, good: DataFrame, total: int, size: int) -> bytes:
    """The dictionary of all documents labelled good, equal texts taken once: segments that hold the ``size`` windows that
    most of the texts have, as a dictionary of so many bytes can't hold more."""
    ids = known.join(good, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "bytes")).alias("d")).select("d.doc_id", "h", "d.bytes")
    ids = materialize(ids, "domain")
    n_bytes = ids.agg(F.sum("bytes")).first()[0]
    if not n_bytes:
        return b""
    texts = matching(docs, [F.col("doc_id"), F.col("h")], ids.select("doc_id", "h")).select("doc_id", "h", "text")
    texts = materialize(texts.dropDuplicates(["doc_id", "h"]).select("text"), "domain-texts")
    counts = recurring(texts, n_bytes, total, size)
    top, n = most_frequent(reduce(DataFrame.unionByName, counts), size)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = best_segments((clean_text(b.column(0)) if b.schema.names == ["text"] else b.column(0).cast(pa.large_binary()) for b in batches), top, n)
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.binary())], ["segment"])

    found = texts.mapInArrow(offer, "segment binary")
    for parts in (16, 1):  # so that no task reads what all others found
        found = found.repartition(parts).mapInArrow(offer, "segment binary")
    segments = [bytes(r["segment"]) for r in found.collect()]
    discard(texts, *counts)
    return cover(segments, top, n, size)


def score(docs: DataFrame, labels: DataFrame, size: int = DICTIONARY, level: int = LEVEL, shelf: int = SHELF) -> DataFrame:
    """doc_id, n_bytes, in_bits and general_bits per byte, and score, for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a row is known by two hashes, as doc_id may be null
    some = docs.where("octet_length(text) > 0").withColumn("h", F.xxhash64("text")).withColumn("r", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "h"))
    named = ["doc_id", "r", "h", "key", "bytes"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = clean_text(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys_of(texts)), pa.array(np.diff(buffer_of(texts)[1]))], named)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(clean_text(b.column(3)))), *b.columns], ["key", "doc_id", "r", "h", "text"])

    known = materialize(some.select("doc_id", "r", "h", "text").mapInArrow(keyed, "doc_id long, r long, h long, key long, bytes long"), "known")
    once = materialize(known.groupBy("doc_id", "r", "h", "key", "bytes").agg(F.count("*").alias("rows")), "once")
    total = once.agg(F.sum("bytes")).first()[0] or 0
    good = materialize(in_domain(once, labels), "good")
    domain = domain_dictionary(some, once, good, total, size)
    repeated = materialize(once.where("rows > 1").select("r", "h"), "repeated")
    again = not repeated.isEmpty()
    texts = some.select("doc_id", "r", "h", "text")
    if again:
        keys = [F.col("r"), F.col("h")]
        texts = without(texts, keys, repeated).unionByName(matching(texts, keys, repeated).dropDuplicates(["r", "h"]))
    ranges, hot = max(1, -(-total // RANGE)), heavy(once, "key")
    by = F.when(F.col("key").isin(hot), F.xxhash64("r")).otherwise(F.xxhash64("key")) if hot else F.xxhash64("key")
    flags = once.join(good, "doc_id", "left_semi").select("key", "doc_id", "r", "h", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    rows = texts.mapInArrow(with_key, "key long, doc_id long, r long, h long, text string").withColumn("kind", F.lit(1)).unionByName(flags)
    rows = rows.withColumn("range", F.pmod(by, F.lit(ranges)).cast("int")).repartitionById(ranges, F.col("range")).sortWithinPartitions("key", "r", "h", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        labelled: tuple | None = None
        n, flags = 0, []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            data, off = buffer_of(t["text"].combine_chunks() if t.num_rows else pa.array([], pa.large_string()))
            general, own = shelf_dictionaries(data, off, np.array(flags, bool), domain, size)
            found, per = sizes(data, off, general, own, level), np.diff(off)
            columns = [t["doc_id"].combine_chunks(), t["r"].combine_chunks(), t["h"].combine_chunks(), pa.array(per), *(pa.array(np.round(8 * found[:, k] / per, 6)) for k in (1, 0)), pa.array(np.round((found[:, 0] - found[:, 1]) / found.sum(1), 6))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "r", "h", "n_bytes", "in_bits", "general_bits", "score"])

        for b in batches:
            texts, kinds, rs, hs = clean_text(b.column(3)), b.column(4).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            lengths, start = np.diff(buffer_of(texts)[1]).tolist(), None
            own = pa.RecordBatch.from_arrays([*b.columns[:3], texts], ["doc_id", "r", "h", "text"])
            for k, kind in enumerate(kinds):
                if kind == 0:  # says that the row that follows is in-domain
                    labelled = rs[k], hs[k]
                    if start is not None:
                        held.append(own.slice(start, k - start))
                        start = None
                    continue
                start = k if start is None else start
                flags.append(labelled == (rs[k], hs[k]))
                n += lengths[k]
                if n >= shelf:
                    held.append(own.slice(start, k + 1 - start))
                    yield flush()
                    held, flags, n, start = [], [], 0, None
            if start is not None:
                held.append(own.slice(start))
        if held:
            yield flush()

    schema = "n_bytes long, in_bits double, general_bits double, score double"
    scored = rows.select("doc_id", "r", "h", "text", "kind").mapInArrow(run, "doc_id long, r long, h long, " + schema)
    names = ["doc_id", "n_bytes", "in_bits", "general_bits", "score"]
    empty = docs.where("text is null or octet_length(text) = 0").selectExpr("doc_id", "0L as n_bytes", "cast(null as double) as in_bits", "cast(null as double) as general_bits", "cast(null as double) as score")
    if not again:
        return scored.select(names).unionByName(empty)
    scored = materialize(scored, "scored")
    keys = [F.col("r"), F.col("h")]
    rest = without(scored, keys, repeated).select(names)
    of = matching(scored, keys, repeated).select("r", F.col("h").alias("own_h"), *names[1:])
    more = join_unique(matching(known, keys, repeated).select("doc_id", "r", "h"), of, "r").where("h = own_h").select(names)
    return rest.unionByName(more).unionByName(empty)
