"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, rotated by two, one and zero places so that order counts; a document's vector bundles
(sums) those of all its trigrams; a language's prototype bundles all documents declared to be in
it. A document gets the language of the prototype with the largest cosine.

How large the cosine must be depends on the document's length and on the language. With n trigrams drawn
from distribution d, q the sum of their squared counts and p the prototype's counts, the cosine would be about
n / sqrt(q) * (p . d) / norm(p), 1 at most: it grows with the text, but not by repetition. d is summed from
square roots of each document's counts, so that a text of one repeated word doesn't decide what is expected of
all others. A document is rejected below a share of the least that any language expects (where such a text
bends a prototype, the language's others may be nearest to another), or if chance alone could give its cosine.

Bundling is linear. Prototypes are therefore bundled from trigram counts that are summed over the
corpus on the map side first: what is shuffled is (language, trigram, count), never text.

Defined cases: null or empty text and text without letters have no vector and are rejected; a very long text
is read whole, in blocks whose trigrams are counted together, so that it takes no more memory than others;
documents with a null declared language are classified but form no prototype, bytes of a declared language
that are no UTF-8 become U+FFFD; without any prototype all are rejected; equal cosines go to the alphabetically first language; repeated rows
are judged alike, row by row; extra columns pass through the filter untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, clean_text, pieces, small_batches

DIMS = 4096
#: Least cosine with the nearest prototype: almost four standard deviations of chance with 4,096 dimensions;
#: texts of one word can pass.
MIN_COSINE = 0.06
#: Least share of the cosine that is expected of a text with as many trigrams.
MIN_SHARE = 0.25
SLOTS = 128
#: Bytes of text, and rows, that are worked on at once.
PIECE, JUDGED_PIECE, JUDGED_ROWS = 500_000, 150_000, 512


@lru_cache
def letter_slots() -> np.ndarray:
    """Slot of each code point: 0 for what is no letter, 1-26 for a-z, else by hash."""
    slots = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            slots[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 7) % (SLOTS - 27)
    return slots


def letter_vectors(dims: int, seed: int = 7) -> np.ndarray:
    """For each position in a trigram, the vectors of all slots, rotated for that position."""
    v = np.random.RandomState(seed).randint(0, 2, (SLOTS, dims)).astype(np.int8) * 2 - 1
    return np.stack([np.roll(v, 2, 1), np.roll(v, 1, 1), v])


def trigram_vectors(tri: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return letters[0][tri >> 14] * letters[1][(tri >> 7) & 127] * letters[2][tri & 127]


def trigram_counts(texts: pa.Array, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram, count) of lower-cased texts, ordered by row. Runs of non-letters are one space."""
    padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, _ = buffer_of(padded)
    s = slots[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), pc.utf8_length(padded).to_numpy(zero_copy_only=False))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (row[1:] != row[:-1])
    s, row = s[keep].astype(np.int32), row[keep]
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 3
    inside = row[2:] == row[:-2]
    keys, counts = np.unique((row[2:][inside].astype(np.int64) << 21) | (s[:-2] << 14 | s[1:-1] << 7 | s[2:])[inside], return_counts=True)
    return keys >> 21, keys & 0x1FFFFF, counts


def long_counts(data: np.ndarray, slots: np.ndarray, block: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trigram_counts() of one text of any length, its bytes read block by block."""
    total, last, at = np.zeros(1 << 21, np.int64), np.zeros(1, np.int32), 0
    while at <= len(data):
        end = min(at + block, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        s = slots[np.frombuffer(data[at:end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)].astype(np.int32)
        if end == len(data):
            s, end = np.append(s, 0), end + 1
        s = np.concatenate([last, s])
        keep = np.ones(len(s), bool)
        keep[len(last) :] = (s[len(last) :] != 0) | (s[len(last) - 1 : -1] != 0)
        s = s[keep]
        if len(s) > 2:
            total += np.bincount(s[:-2] << 14 | s[1:-1] << 7 | s[2:], minlength=1 << 21)
        last, at = s[-2:], end
    tri = np.flatnonzero(total)
    return np.zeros(len(tri), np.int64), tri, total[tri]


def counted(texts: pa.Array, slots: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, row, trigram, count) of ranges of lower-cased texts of about so many bytes and rows at most."""
    for start, stop in pieces(buffer_of(texts)[1], most):
        for lo in range(start, stop, rows):
            hi = min(stop, lo + rows)
            own = texts.slice(lo, hi - lo)
            data, _ = buffer_of(own)
            yield lo, hi, *(long_counts(data, slots) if hi - lo == 1 and len(data) > most else trigram_counts(own, slots))


class Prototypes(dict):
    """The unit vector of each language, and in slopes the cosine expected of a text of one trigram."""

    slopes: dict[str, float] = {}


def prototypes(docs: DataFrame, dims: int = DIMS) -> Prototypes:
    """Those of each declared language, from all documents."""
    small_batches(docs.sparkSession)
    slots, letters = letter_slots(), letter_vectors(dims)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return keys, *(np.bincount(back, np.concatenate([x[k] for x in held]), len(keys)) for k in (1, 2))

        for batch in batches:
            texts = clean_text(batch.column(0), True)
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            for lo, _, row, tri, n in counted(texts, slots, PIECE, 1 << 20):
                # summed over the piece's rows at once: what is held has no more keys than there are trigrams
                keys, back = np.unique((lang[lo + row] << 21) | tri, return_inverse=True)
                held.append((keys, np.bincount(back, n, len(keys)), np.bincount(back, np.sqrt(n), len(keys))))
                if len(held) >= 32:
                    held[:] = [merged()]
        if held:
            keys, n, d = merged()
            by = list(names)
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([by[i] for i in k >> 21], pa.string()), pa.array(k & 0x1FFFFF), pa.array(n[at : at + 100_000]), pa.array(d[at : at + 100_000])], ["lang", "tri", "n", "d"])

    def bundle(table: pa.Table) -> pa.Table:
        tri, n, d = (table[k].to_numpy() for k in ("tri", "n", "d"))
        v = np.zeros(dims)
        for at in range(0, len(tri), 1024):
            v += n[at : at + 1024] @ trigram_vectors(tri[at : at + 1024], letters)
        return pa.table([table["lang"].slice(0, 1), pa.array([v / max(np.linalg.norm(v), 1e-9)], pa.list_(pa.float64())), pa.array([n @ d / np.linalg.norm(n) / d.sum()])], ["lang", "v", "slope"])

    counts = docs.select("text", F.make_valid_utf8(F.col("lang").cast("string")).alias("lang")).where("lang is not null and text is not null").mapInArrow(count, "lang string, tri long, n double, d double")
    rows = counts.groupBy("lang", "tri").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).groupBy("lang").applyInArrow(bundle, "lang string, v array<double>, slope double").collect()
    out = Prototypes({r["lang"]: np.array(r["v"]) for r in sorted(rows, key=lambda r: r["lang"])})
    out.slopes = {r["lang"]: r["slope"] for r in rows}
    return out


def _judge(protos: dict[str, np.ndarray], dims: int, slots: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest language (-1: none), its cosine, the lead over the second and the cosine expected
    of a text of its length (0 if the prototypes come without slopes)."""
    letters, p = letter_vectors(dims), np.array([*protos.values()], np.float32).reshape(-1, dims)
    best, cosine, margin, expected = np.full(len(texts), -1), *np.zeros((3, len(texts)))
    if not len(p):
        return best, cosine, margin, expected
    slope = min(getattr(protos, "slopes", {}).get(x, 0) for x in protos)
    for lo, hi, row, tri, n in counted(texts, slots, JUDGED_PIECE, JUDGED_ROWS):
        if not len(row):
            continue
        grams, at = np.unique(tri, return_inverse=True)
        v = np.zeros((hi - lo, dims), np.float32)
        for g in range(0, len(grams), 1024):
            own = (at >= g) & (at < g + 1024)
            m = np.zeros((hi - lo, min(1024, len(grams) - g)), np.float32)
            m[row[own], at[own] - g] = n[own]
            v += m @ trigram_vectors(grams[g : g + 1024], letters).astype(np.float32)
        norm = np.linalg.norm(v, axis=1)
        c = (v @ p.T) / np.maximum(norm, 1e-9)[:, None]
        top = c.argmax(1)
        cosine[lo:hi] = c[np.arange(hi - lo), top]
        c[np.arange(hi - lo), top] = -1
        margin[lo:hi] = cosine[lo:hi] - c.max(1)
        best[lo:hi] = np.where(norm > 0, top, -1)
        squares = np.bincount(row, n.astype(float) ** 2, hi - lo)
        expected[lo:hi] = np.minimum(np.bincount(row, n, hi - lo) / np.sqrt(np.maximum(squares, 1)) * slope, 1)
    return best, cosine, margin, expected


def language_id(docs: DataFrame, protos: dict[str, np.ndarray] | None = None, dims: int = DIMS, min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, lang as declared, predicted (null if rejected), cosine, margin and accepted, a row for each row."""
    protos, slots = prototypes(docs, dims) if protos is None else protos, letter_slots()
    names = np.array([*protos, None], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, cosine, margin, expected = _judge(protos, dims, slots, clean_text(b.column(2), True))
            ok = (best >= 0) & (cosine >= np.maximum(min_cosine, MIN_SHARE * expected))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[np.where(ok, best, -1)], pa.string()), pa.array(np.round(cosine, 6)), pa.array(np.round(margin, 6)), pa.array(ok)], ["doc_id", "lang", "predicted", "cosine", "margin", "accepted"])

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(judge, "doc_id long, lang string, predicted string, cosine double, margin double, accepted boolean")


def keep_languages(docs: DataFrame, languages: list[str] | None = None, dims: int = DIMS, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The rows of docs that are accepted, in one of the languages if given, with all their columns."""
    protos, slots = prototypes(docs, dims), letter_slots()
    names = [*protos]
    wanted = np.array([languages is None or x in languages for x in names] + [False])
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, cosine, _, expected = _judge(protos, dims, slots, clean_text(b.column(at), True))
            yield b.filter(pa.array(wanted[best] & (cosine >= np.maximum(min_cosine, MIN_SHARE * expected))))

    return docs.mapInArrow(judge, docs.schema)
