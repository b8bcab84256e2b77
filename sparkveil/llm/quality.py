"""Quality rules as robust multivariate outlier detection.

Each document has a vector of text statistics, transformed towards normality and shrunk for short
texts. Per language and source, the minimum covariance determinant estimates location and scatter:
of ``SUPPORT`` of the documents, those whose covariance has the least determinant. Concentration
steps find it from two starts (medians and quartiles; these with the correlation of clipped scores):
each takes the documents with the least Mahalanobis distances under the last estimate and estimates
anew. In a step every task adds up, for each group and bin of distance, the moments of all its documents'
vectors; the group's bins are then summed up to the one in which the support is reached. A group of any
size is thus never gathered in one place. The start with the lesser determinant wins. Documents beyond
the cutoff are rejected.

Defined cases: null language or source forms a group of its own; null or empty text, or text of white
space, has no statistics and is rejected; a group with fewer than ``LEAST`` documents, or one whose
scatter is singular (all rows equal), borrows the estimate over the whole table, and if that is
singular too all stay; repeated rows are judged alike; documents in the bin at the support's edge are all taken;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, clean_text, materialize, pieces
from .near_dedup import words_by_row

SUPPORT = 0.75
STEPS = 8
#: Documents that the estimate over the whole table counts for in that of a group.
PRIOR = 200
#: Squared distance beyond which a document goes. Clean texts have longer tails than normal ones (the
#: chi-square quantile for one in 1e9 at six degrees of freedom is 55). Of the half of the labelled documents with
#: even doc_id (sf0.1), 99 % of the good ones are nearer than 97; with a margin for other tables, the other half
#: has 0.8 % of the good ones beyond the cutoff and 2 % of the bad ones within.
CUTOFF = 110.0
NAMES = ["marks", "upper", "word_length", "words", "variety", "sentence"]
P = len(NAMES)
#: Covariance of a normal's central 75 % in six dimensions, times this, is the normal's.
CONSISTENCY = 1.42

_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_CHAR = np.ones(256, np.uint8)
_CHAR[128:192] = 0
_STOP = np.zeros(256, np.uint8)
_STOP[[10, 33, 46, 63]] = 1


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed vector of each text, all NaN for one without words. Each count has a prior worth
    some 50 characters or 10 words, so that a short text's vector lies near the middle."""
    lowered = clean_text(texts, True)
    texts = clean_text(texts)
    out = np.full((len(texts), P), np.nan)
    counts = np.zeros((5, len(texts)))
    for lo, hi in pieces(buffer_of(texts)[1], 2_000_000):
        data, off = buffer_of(texts.slice(lo, hi - lo))
        some = np.diff(off) > 0
        if some.any():
            for k, lookup in enumerate((_CHAR, _LETTER, _UPPER, _SPACE, _STOP)):
                counts[k, lo:hi][some] = np.add.reduceat(lookup[data], off[:-1][some], dtype=np.int64)
    words, distinct = np.zeros(len(texts)), np.zeros(len(texts))
    for lo, hi, doc, h in words_by_row(lowered):
        words[lo:hi] = np.bincount(doc, minlength=hi - lo)
        distinct[lo:hi] = np.bincount(np.unique((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))) >> np.uint64(44), minlength=hi - lo)
    chars, letters, upper, spaces, stops = counts
    solid = chars - spaces
    marks = np.maximum(solid - letters, 0)
    x = [
        np.log((marks + 2.5) / (letters + 50)),
        np.log((upper + 2.5) / (letters - upper + 50)),
        np.log((letters + 50) / (words + 10)),
        np.log(words + 10),
        np.log(distinct + 10),
        np.log((words + 10) / (stops + 1.5)),
    ]
    out[solid > 0] = np.stack(x, 1)[solid > 0]
    return out


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, g, x0..): g names the group of language and source."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(3))
            columns = [pa.array(x[:, k], mask=np.isnan(x[:, k])) for k in range(P)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["doc_id", "lang", "source", *(f"x{k}" for k in range(P))])

    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    found = own.mapInArrow(scan, "doc_id long, lang string, source string, " + ", ".join(f"x{k} double" for k in range(P)))
    return found.withColumn("g", F.to_json(F.struct("lang", "source")))


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Squared distances are counted in so many bins of equal width in the logarithm, between these powers of e.
BINS, LOWEST, HIGHEST = 256, -7.0, 9.0


def distances(x: np.ndarray, centre: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances under the rows of an inverse triangular factor."""
    return (((x - centre) @ factor.T) ** 2).sum(1)


def factor_of(cov: np.ndarray) -> np.ndarray | None:
    """Inverse of the covariance's Cholesky factor; None if it is singular."""
    scale = np.sqrt(np.maximum(cov.diagonal(), 0))
    if not np.isfinite(cov).all() or (scale < 1e-9).any():
        return None
    corr = cov / np.outer(scale, scale)
    if np.linalg.eigvalsh(corr)[0] < 1e-8:
        return None
    return np.linalg.inv(np.linalg.cholesky(corr)) / scale


def moments_of(x: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of each row, side by side."""
    return np.concatenate([np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in PAIRS], 1)], 1)


def estimate(m: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from summed moments of vectors taken from a point near their mean."""
    mean = m[1 : P + 1] / m[0]
    cov = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, m[P + 1 :]):
        cov[i, j] = cov[j, i] = v / m[0] - mean[i] * mean[j]
    return mean + about, cov


#: The name of all groups together.
WHOLE = ""
#: Groups whose sums a task holds at once.
HELD = 256


def _by_group(table: DataFrame, binned, estimated, result: str) -> list:
    """One row for each group and for the whole. binned(g, x) gives (start, bin) keys and moments of a batch's
    vectors of a group; they are added up per task, and estimated(g, sums by start, by bin) ends in a row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        row = lambda g, m: pa.RecordBatch.from_arrays([pa.array([g]), pa.array([m.tobytes()], pa.binary())], ["g", "m"])
        for b in batches:
            code = b.column(0).dictionary_encode()
            x = np.stack([b.column(k + 1).to_numpy() for k in range(P)], 1)
            at = code.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(len(code.dictionary) + 1))
            parts = [(g, x[order[cuts[k] : cuts[k + 1]]]) for k, g in enumerate(code.dictionary.to_pylist())]
            for g, own in [*parts, (WHOLE, x)] if len(x) else []:
                own = binned(g, own)
                if own is not None:
                    held[g] = held[g] + own if g in held else own
                if len(held) > HELD:
                    yield from (row(*i) for i in held.items())
                    held.clear()
        yield from (row(*i) for i in held.items())

    def total(t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(v.as_buffer()) for v in t["m"])
        return estimated(t["g"][0].as_py(), m)

    return table.mapInArrow(partial, "g string, m binary").groupBy("g").applyInArrow(total, result).collect()


def mcd(table: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> dict[str, tuple[int, np.ndarray | None, np.ndarray | None]]:
    """For each group g of table (g, x0..), and for the whole, number of rows, centre and inverse factor of the
    consistent scatter. A group whose scatter is singular has neither."""
    return {g: (n, c, None if cov is None else factor_of(cov)) for g, (n, c, cov) in scatters(table, support, steps).items()}


def scatters(table: DataFrame, support: float, steps: int = STEPS) -> dict[str, tuple[int, np.ndarray | None, np.ndarray | None]]:
    """mcd() with the scatter itself. What comes to the driver is one row a group."""
    xs = [f"x{k}" for k in range(P)]
    table = table.select("g", *xs)
    size, mid, mad = {}, {}, {}
    summary = [F.count("*").alias("n"), *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(x) for x in xs]]
    everything = table.agg(*summary).where("n > 0").select(F.lit(WHOLE).alias("g"), "n", *xs)
    for r in table.groupBy("g").agg(*summary).unionByName(everything).collect():
        q = np.array([r[x] for x in xs])
        size[r["g"]], mid[r["g"]] = r["n"], q[:, 1]
        mad[r["g"]] = np.maximum((q[:, 2] - q[:, 0]) / 1.349, 1e-6)
    wide = len(PAIRS) + P + 1

    def clipped(g: str, x: np.ndarray) -> np.ndarray:
        return moments_of(np.tanh((x - mid[g]) / mad[g])).sum(0)

    def first(g: str, m: np.ndarray) -> pa.Table:
        _, cov = estimate(m, np.zeros(P))
        sd = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
        return pa.table([[g], [(cov / np.outer(sd, sd)).ravel().tolist()]], ["g", "corr"])

    starts: dict[str, list] = {}
    for r in _by_group(table, clipped, first, "g string, corr array<double>"):
        g = r["g"]
        plain = factor_of(np.diag(mad[g] ** 2))
        tied = factor_of(np.outer(mad[g], mad[g]) * np.array(r["corr"]).reshape(P, P))
        starts[g] = [(mid[g], plain), (mid[g], plain if tied is None else tied)]

    def binned(g: str, x: np.ndarray) -> np.ndarray | None:
        if g not in starts:
            return None
        out = np.zeros((2, BINS, wide))
        m = moments_of(x - mid[g])
        for s, (centre, factor) in enumerate(starts[g]):
            d = np.log(np.maximum(distances(x, centre, factor), 1e-12))
            at = np.clip((d - LOWEST) / (HIGHEST - LOWEST) * BINS, 0, BINS - 1).astype(int)
            np.add.at(out[s], at, m)
        return out.ravel()

    def concentrate(g: str, m: np.ndarray) -> pa.Table:
        m = m.reshape(2, BINS, wide)
        means, covs = [], []
        for s in (0, 1):
            seen = np.cumsum(m[s, :, 0])
            last = int(np.searchsorted(seen, support * seen[-1]))  # the bin in which the support is reached
            mean, cov = estimate(m[s, : last + 1].sum(0), mid[g])
            means, covs = means + mean.tolist(), covs + cov.ravel().tolist()
        return pa.table([[g], [means], [covs]], ["g", "means", "covs"])

    final: dict[str, list] = {}
    for _ in range(steps):
        if not starts:
            break
        found = _by_group(table, binned, concentrate, "g string, means array<double>, covs array<double>")
        following = {}
        for r in found:
            both = [*zip(np.array(r["means"]).reshape(2, P), np.array(r["covs"]).reshape(2, P, P))]
            final[r["g"]] = both
            factors = [factor_of(cov) for _, cov in both]
            if all(f is not None for f in factors):
                following[r["g"]] = [(mean, f) for (mean, _), f in zip(both, factors)]
        starts = following
    out = {}
    for g, n in size.items():
        best = min((x for x in final.get(g, []) if factor_of(x[1]) is not None), key=lambda x: np.linalg.slogdet(x[1])[1], default=None)
        out[g] = (n, best[0], best[1] * CONSISTENCY) if best else (n, None, None)
    return out


def shrunk(n: int, centre: np.ndarray | None, cov: np.ndarray | None, centre_all: np.ndarray | None, cov_all: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Centre and inverse factor of a group of n documents, drawn towards those of the whole."""
    if cov is None or cov_all is None:
        centre, cov = (centre_all, cov_all) if cov is None else (centre, cov)
    else:
        w = n / (n + PRIOR)
        # between logarithms, else a few outliers that swell a small group's scatter outweigh the whole's
        centre, cov = w * centre + (1 - w) * centre_all, _of_eigenvalues(w * _of_eigenvalues(cov, np.log) + (1 - w) * _of_eigenvalues(cov_all, np.log), np.exp)
    return centre, None if cov is None else factor_of(cov)


def _of_eigenvalues(m: np.ndarray, f) -> np.ndarray:
    """The symmetric matrix with f of m's eigenvalues."""
    values, vectors = np.linalg.eigh(m)
    return (vectors * f(np.maximum(values, 1e-12) if f is np.log else values)) @ vectors.T


def judged(docs: DataFrame, support: float = SUPPORT, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, x0.., d2 and accepted for each row; d2 is null where nothing can be measured."""
    table = materialize(vectors(docs), "statistics")
    whole = table.where("x0 is not null")
    own = scatters(whole, support)
    n_all, centre_all, cov_all = own.pop(WHOLE, (0, None, None))
    found = {g: shrunk(n, centre, cov, centre_all, cov_all) for g, (n, centre, cov) in own.items()}
    names = ["doc_id", "lang", "source", *(f"x{k}" for k in range(P)), "d2", "accepted"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(3 + k).to_numpy(zero_copy_only=False) for k in range(P)], 1)
            some = ~np.isnan(x[:, 0])
            d2 = np.full(len(x), np.nan)
            code = b.column(3 + P).dictionary_encode()
            at = code.indices.to_numpy()
            for k, g in enumerate(code.dictionary.to_pylist()):
                centre, factor = found.get(g, (None, None))
                own = some & (at == k)
                if factor is not None and own.any():
                    d2[own] = np.round(distances(x[own], centre, factor), 4)
            ok = some & ~(d2 > cutoff)
            yield pa.RecordBatch.from_arrays([*b.columns[: 3 + P], pa.array(d2, mask=np.isnan(d2)), pa.array(ok)], names)

    schema = "doc_id long, lang string, source string, " + "".join(f"x{k} double, " for k in range(P)) + "d2 double, accepted boolean"
    return table.mapInArrow(judge, schema)
