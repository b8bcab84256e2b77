"""Mixing sources to target weights by entropy balancing.

Every document d has x_d, its tokens placed in the coordinate of its source and in that of its
language. Among all rates r_d the balanced ones deviate least from 1 (in unnormalised relative
entropy) while the tokens they imply, sum r_d x_d, meet the target of each source and language.
The solution is exponentially tilted, r_d = exp(l . x_d), with l minimising the convex dual
sum exp(l . x_d) - l . T; Newton's iterations with a line search find it. A document enters only
by (source, language, tokens), so the corpus is first counted by these; each iteration is one
aggregation of that table into the gradient's and Hessian's terms by (source, language).

Targets: a source's tokens in proportion to its share to the power ``alpha``, the total being the
least at which no source is sampled below its size. Languages keep their shares as far as that agrees with
the sources: where no rates could meet both (as when each source has a language of its own), the languages
yield, in steps of a twentieth, towards what they get if each source is scaled as a whole. If the iterations
don't come within ``ACCEPTED`` of the targets, that is an error. Rates become
copies by rounding down and adding one with the fraction as probability, drawn by hash of doc_id and
text, so that it is the same in every run.

Defined cases: a null source or language is a group of its own; null text, empty text and text
without words have no tokens, constrain nothing and keep the rate 1, as does everything when no
document has a token; a very long text counts with all its tokens; an empty table gives an empty result; repeated
rows share rate and draw; texts of as many tokens in one source and language have one rate, ties having no
order; extra columns pass through. A single source has the rate 1 throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ALPHA = 0.8
#: Largest gap to a target that is aimed at, and that is accepted, as a share of all tokens.
TOLERANCE, ACCEPTED = 1e-6, 1e-4
ITERATIONS = 60
#: Rows by source and language up to which their table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def token_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")


def targets(tokens: dict[tuple, float], alpha: float) -> tuple[dict, dict]:
    """Target tokens by source and by language, from tokens by (source, language)."""
    by_source: dict = {}
    by_lang: dict = {}
    for (s, g), n in tokens.items():
        by_source[s], by_lang[g] = by_source.get(s, 0) + n, by_lang.get(g, 0) + n
    total = sum(by_source.values())
    raised = {s: (n / total) ** alpha for s, n in by_source.items() if n}
    scale = max((by_source[s] / w for s, w in raised.items()), default=0)
    goal = {s: w * scale for s, w in raised.items()}
    langs = {g: n for g, n in by_lang.items() if n}
    if not goal:
        return goal, langs
    at_s, at_g = {s: i for i, s in enumerate(goal)}, {g: i for i, g in enumerate(langs)}
    held = np.zeros((len(at_s), len(at_g)))
    for (s, g), n in tokens.items():
        if n:
            held[at_s[s], at_g[g]] += n
    rows = np.array([*goal.values()])
    implied = held * (rows / held.sum(1))[:, None]
    kept = np.array([*langs.values()]) / total * rows.sum()
    for step in range(21):
        wanted = kept + (implied.sum(0) - kept) * (step / 20)
        if step == 20 or agree(held, implied, rows, wanted):
            return goal, dict(zip(langs, wanted.tolist()))


def agree(held: np.ndarray, implied: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> bool:
    """Whether tokens by source and language can have these sums, no cell falling below a hundredth of what it is
    implied to have; found by iterative proportional fitting."""
    m = held.copy()
    for _ in range(500):
        m *= (rows / m.sum(1))[:, None]
        m *= columns / m.sum(0)
        if np.abs(m.sum(1) - rows).max() < 1e-9 * rows.sum():
            break
    some = held > 0
    return bool(np.abs(m.sum(1) - rows).max() < 1e-6 * rows.sum() and (m[some] >= 0.01 * implied[some]).all())


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if so many rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def solve(cells: DataFrame, alpha: float = ALPHA) -> tuple[dict, dict]:
    """The multipliers by source and by language. cells: (source, lang, tokens, n), tokens above 0."""
    groups = [(r["source"], r["lang"], float(r["t"])) for r in cells.groupBy("source", "lang").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).collect()]
    if not groups:
        return {}, {}
    goal_s, goal_g = targets({(s, g): t for s, g, t in groups}, alpha)
    at_s, at_g = {s: i for i, s in enumerate(goal_s)}, {g: i for i, g in enumerate(goal_g)}
    first = len(at_s)
    goal = np.array([*goal_s.values(), *goal_g.values()])
    spark = cells.sparkSession

    def moments(l: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual, its gradient, the Hessian's diagonal and its block of sources by languages."""
        rows = [(s, g, float(l[at_s[s]] + l[first + at_g[g]])) for s, g, _ in groups]
        tilt = spark.createDataFrame(rows, cells.select("source", "lang").schema.add("l", "double"))
        w = F.col("n") * F.exp(F.least(F.col("l") * F.col("tokens"), F.lit(300.0)))
        joined = cells.join(small(tilt, len(rows)), cells["source"].eqNullSafe(tilt["source"]) & cells["lang"].eqNullSafe(tilt["lang"])).select(cells["source"], cells["lang"], "tokens", w.alias("w"))
        value, grad, diagonal, block = 0.0, -goal.copy(), np.zeros(len(goal)), np.zeros((first, len(at_g)))
        for r in joined.groupBy("source", "lang").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("tokens")).alias("w1"), F.sum(F.col("w") * F.col("tokens") * F.col("tokens")).alias("w2")).collect():
            i, j = at_s[r["source"]], at_g[r["lang"]]
            value += r["w"]
            grad[[i, first + j]] += r["w1"]
            diagonal[[i, first + j]] += r["w2"]
            block[i, j] += r["w2"]
        return value - float(l @ goal), grad, diagonal, block

    def newton(grad: np.ndarray, diagonal: np.ndarray, block: np.ndarray) -> np.ndarray:
        # sources are eliminated, so that only a matrix of the languages is left; it is singular in one
        # direction, as the two sets of targets have one sum
        top = np.maximum(diagonal[:first], 1e-300)
        left = np.diag(diagonal[first:]) - block.T @ (block / top[:, None])
        unit = max(float(np.abs(diagonal).max()), 1e-300)
        y = np.linalg.lstsq(left / unit, (block.T @ (grad[:first] / top) - grad[first:]) / unit, rcond=1e-10)[0]
        return np.concatenate([(-grad[:first] - block @ y) / top, y])

    l = np.zeros(len(goal))
    value, grad, diagonal, block = moments(l)
    for _ in range(ITERATIONS):
        if np.abs(grad).max() <= TOLERANCE * goal.sum():
            break
        step, size = newton(grad, diagonal, block), 1.0
        while size > 1e-8:
            tried = moments(l + size * step)
            if tried[0] <= value + 1e-4 * size * float(grad @ step) or abs(float(grad @ step)) < 1e-12 * max(1.0, abs(value)):
                break
            size /= 2
        else:
            break
        l, (value, grad, diagonal, block) = l + size * step, tried
    if np.abs(grad).max() > ACCEPTED * goal.sum():
        raise ArithmeticError(f"the targets were not met: {np.abs(grad).max() / goal.sum():.2g} of all tokens are missing")
    return {s: l[i] for s, i in at_s.items()}, {g: l[first + j] for g, j in at_g.items()}


def _with_rates(docs: DataFrame, alpha: float) -> tuple[DataFrame, Column, Column]:
    """docs, perhaps joined with multipliers, and the columns of rate and copies."""
    cells = materialize(docs.select("source", "lang", token_count().alias("tokens")).where("tokens > 0").groupBy("source", "lang", "tokens").agg(F.count("*").alias("n")), "cells")
    by_source, by_lang = solve(cells, alpha)
    pairs = [(r["source"], r["lang"], float(by_source[r["source"]] + by_lang[r["lang"]])) for r in cells.select("source", "lang").distinct().collect()]
    side = docs.sparkSession.createDataFrame(pairs, cells.select(F.col("source").alias("_source"), F.col("lang").alias("_lang")).schema.add("_tilt", "double"))
    joined = docs.join(small(side, len(pairs)), docs["source"].eqNullSafe(side["_source"]) & docs["lang"].eqNullSafe(side["_lang"]), "left")
    rate = F.round(F.exp(F.coalesce(side["_tilt"], F.lit(0.0)) * token_count()), 9)
    # one in 2 ** 30 parts; rows that repeat a doc_id and its text share their draw
    draw = (F.pmod(F.xxhash64(F.lit("mix"), docs["doc_id"], docs["text"]), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return joined, rate, (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def rates(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, source, lang, tokens, rate and copies for each row."""
    docs = docs.select("doc_id", "source", "lang", "text")
    joined, rate, copies = _with_rates(docs, alpha)
    return joined.select("doc_id", "source", "lang", token_count().alias("tokens"), rate.alias("rate"), copies.alias("copies"))


def mix(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs with each row as often as its copies say, its columns unchanged."""
    joined, _, copies = _with_rates(docs, alpha)
    repeated = joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"))
    return repeated.drop("_copy") if "_copy" not in docs.columns else repeated.toDF(*docs.columns, "_copy_of_row").drop("_copy_of_row")
