"""Pairwise logistic learning without pair rows.

A pool's rows are numbered from best to worst and packed into blocks. Two blocks
meet in a task, which adds up the gradient and curvature of all their pairs; a pair
is never a row. The driver gets folds x features^2 numbers a Newton round.

The fit's blocks are halved down to ``LEAF`` rows. All pairs of a better and a worse
half count at once: a pair's weight is a smooth function of the difference of two
scores, so over cells of scores it is a Chebyshev series, and each half is its moments
in the series' terms. The series is cut where its terms are below the rounding of
doubles, so the sums are those over all pairs, in steps that grow as n log n.

A pair counts both ways round with one intercept, so the loss is even in it and
convex: its optimum is 0 whatever the rows, and only the coefficients are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.sums import sum_of
from rankloom.operators.windows import row_numbers
from rankloom.sources.shared import Stored, stored

BLOCK = 2048  # rows of a pool that meet another block's at a time, a pair at a time
STRIP = 512  # rows of the better block weighed at a time
FIT_BLOCK = 32_768  # rows of a pool that meet another block's by moments
ROWS_A_TASK = 20_000  # rows of all folds that a task weighs, about
LEAF = 160  # rows whose pairs are weighed one by one
WIDE, ORDER = 2.0, 24  # width of a cell of scores, terms of a series: what is left out is below 6.4^-24
CELLS = 64  # cells of a block up to which their table is made once
TABLE = 2**23  # numbers of a table that two halves may make for themselves
FAR = 21  # cells apart at which a weight no longer changes: e^-40
ROUNDS = 40


def packed_blocks(df: DataFrame, group: str, order: Sequence[str], key: str, features: Sequence[str], block: int = BLOCK) -> DataFrame:
    """pool, block, n, x: the rows of each block, best first, as little-endian doubles."""
    names = list(features)
    numbered = row_numbers(df.select(group, *dict.fromkeys([*order, key]), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names))), [group], [*order, key], "_n")
    rows = numbered.select(F.col(group).alias("pool"), F.floor((F.col("_n") - 1) / block).cast("int").alias("block"), "_n", *(f"x{i}" for i in range(len(names))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        x = pdf[[f"x{i}" for i in range(len(names))]].to_numpy("<f8")
        return pd.DataFrame({"pool": [pdf["pool"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(pdf)], "x": [np.ascontiguousarray(x).tobytes()]})

    kind = dict(df.dtypes)[group]
    return rows.groupBy("pool", "block").applyInPandas(pack, f"pool {kind}, block int, n int, x binary")


def most_tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def dealt(held: Stored, n_folds: int) -> Stored:
    """The blocks in as many files as their work is worth: a few megabytes, which would be one task, are minutes of it."""
    blocks, rows = held.frame.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = min(blocks, 1 + rows * n_folds // ROWS_A_TASK, most_tasks(held.frame))
    if tasks <= held.frame.rdd.getNumPartitions():
        return held
    out = stored(held.frame.repartition(tasks), "blocks")
    held.dropped()
    return out


def meetings(blocks: DataFrame) -> list[DataFrame]:
    """pool, x, y, same: every block with itself, and, where a pool has several, with each block behind it."""
    own = blocks.select("pool", "x", F.col("x").alias("y"), F.lit(True).alias("same"))
    if not blocks.where("block > 0").limit(1).count():
        return [own]
    last = blocks.groupBy("pool").agg(F.max("block").alias("last")).where("last > 0")
    ahead = blocks.join(last, "pool").where("block < last").select("pool", "x", F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("block"))
    return [own, ahead.join(blocks.select("pool", "block", F.col("x").alias("y")), ["pool", "block"]).select("pool", "x", "y", F.lit(False).alias("same"))]


def accuracy(df: DataFrame, group: str, order: Sequence[str], key: str, score: Column, intercept: float, block: int = BLOCK) -> float | None:
    """Share of the pairs of a pool, both ways round, whose difference in score plus the intercept has the right sign; null without pairs."""
    held = stored(packed_blocks(df.withColumn("_score", score), group, order, key, ["_score"], block), "blocks")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = n = 0
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                x, y = np.frombuffer(r.x, "<f8"), np.frombuffer(r.y, "<f8")
                for i in range(0, len(x), STRIP):
                    s = x[i : i + STRIP, None] - y[None]
                    right = (s + intercept > 0).astype(np.int8) + ~(intercept - s > 0)
                    ahead = np.arange(i, i + len(s))[:, None] < np.arange(len(y))[None] if r.same else np.ones(s.shape, dtype=bool)
                    hits += int(right[ahead].sum())
                    n += 2 * int(ahead.sum())
        yield pd.DataFrame({"hits": [hits], "n": [n]})

    try:
        found = [part.mapInPandas(count, "hits long, n long").agg(F.sum("hits"), F.sum("n")).first() for part in meetings(held.frame)]
    finally:
        held.dropped()
    hits, n = (sum(r[i] or 0 for r in found) for i in (0, 1))
    return hits / n if n else None


@lru_cache(maxsize=1)
def series() -> tuple[np.ndarray, np.ndarray]:
    """For cells -FAR to FAR apart, the terms by terms of 1 - p and p(1 - p), p the logistic function of the difference of a score in each."""
    k = np.arange(ORDER)
    angle = np.pi * (k + 0.5) / ORDER
    terms = np.cos(np.outer(k, angle)) * np.where(k == 0, 1, 2)[:, None] / ORDER
    apart = WIDE * np.arange(-FAR, FAR + 1)[:, None, None] + WIDE / 2 * (np.cos(angle)[:, None] - np.cos(angle))
    wrong = 1 / (1 + np.exp(apart))
    return terms @ wrong @ terms.T, terms @ (wrong * (1 - wrong)) @ terms.T


def pair_sums(better: np.ndarray, worse: np.ndarray, w: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of (difference, 1) and (its negative, 0) over all pairs of a better and a worse row.

    In one block (``same``) a row is better than those behind it. Sums of differences are
    differences of weighted sums; both directions of a pair weigh the same.
    """
    x = better if same else np.concatenate([better, worse])
    x = x - x.mean(axis=0)  # differences stay, and nothing large cancels
    n, d = x.shape
    s = x @ w
    smooth = n > LEAF and bool(np.isfinite(s).all())
    if smooth:
        cell = np.floor(s / WIDE)
        cells, at = np.unique(cell, return_inverse=True)
        basis = np.polynomial.chebyshev.chebvander(np.clip(2 * (s / WIDE - cell) - 1, -1, 1), ORDER - 1)
    one = np.c_[np.ones(n), x]
    g, cross, curve = np.zeros(d), np.zeros((d, d)), np.zeros(n)

    def one_by_one(a: slice, b: slice, own: bool) -> None:
        for i in range(a.start, a.stop, STRIP):
            part = slice(i, min(i + STRIP, a.stop))
            wrong = 1 / (1 + np.exp(np.minimum(s[part, None] - s[None, b], 500)))
            if own:
                wrong = wrong * (np.arange(part.start, part.stop)[:, None] < np.arange(b.start, b.stop)[None])
            v = wrong * (1 - wrong)
            curve[part] += v.sum(axis=1)
            curve[b] += v.sum(axis=0)
            g[:] += x[b].T @ wrong.sum(axis=0) - x[part].T @ wrong.sum(axis=1)
            cross[:] += x[part].T @ (v @ x[b])

    def table(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        apart = (np.clip(a[:, None] - b, -FAR, FAR) + FAR).astype(int)
        return [t[apart].transpose(0, 2, 1, 3).reshape(len(a) * ORDER, -1) for t in series()]

    whole = table(cells, cells) if smooth and len(cells) <= CELLS else None

    def moments(of: slice, low: int, high: int) -> np.ndarray:
        place = at[of] - low
        order = np.argsort(place, kind="stable") + of.start
        ends = np.cumsum(np.bincount(place, minlength=high - low))
        return np.concatenate([basis[order[i:j]].T @ one[order[i:j]] for i, j in zip([0, *ends[:-1]], ends)])

    def halves(a: slice, b: slice) -> None:
        if not smooth:
            return one_by_one(a, b, False)
        (la, ha), (lb, hb) = ((at[of].min(), at[of].max() + 1) for of in (a, b))
        steps = (ha - la) * (hb - lb) * ORDER**2 // (12 if whole else 1)
        if (a.stop - a.start) * (b.stop - b.start) <= steps:  # few rows a cell
            return one_by_one(a, b, False)
        if not whole and steps > TABLE:
            middle = (a.start + a.stop) // 2
            halves(slice(a.start, middle), b)
            return halves(slice(middle, a.stop), b)
        wrong, v = [t[la * ORDER : ha * ORDER, lb * ORDER : hb * ORDER] for t in whole] if whole else table(cells[la:ha], cells[lb:hb])
        ma, mb = moments(a, la, ha), moments(b, lb, hb)
        pull = ma.T @ (wrong @ mb)
        bent = v @ mb
        g[:] += pull[0, 1:] - pull[1:, 0]
        cross[:] += ma[:, 1:].T @ bent[:, 1:]
        curve[a] += (basis[a] * bent[:, 0].reshape(-1, ORDER)[at[a] - la]).sum(axis=1)
        curve[b] += (basis[b] * (v.T @ ma[:, 0]).reshape(-1, ORDER)[at[b] - lb]).sum(axis=1)

    def within(start: int, stop: int) -> None:
        if stop - start <= LEAF:
            return one_by_one(slice(start, stop), slice(start, stop), True)
        middle = (start + stop) // 2
        within(start, middle)
        within(middle, stop)
        halves(slice(start, middle), slice(middle, stop))

    if same:
        within(0, n)
    else:
        halves(slice(0, len(better)), slice(len(better), n))
    return 2 * g, 2 * ((x.T * curve) @ x - cross - cross.T)


def uses(kind: str, folds: Sequence, pool) -> np.ndarray:
    """Which folds train on a pool: all others (loso), later ones (expanding), or the only fold None."""
    if list(folds) == [None]:
        return np.ones(1, dtype=bool)
    return np.array([pool != f if kind == "loso" else pool < f for f in folds])


def fit_folds(df: DataFrame, group: str, order: Sequence[str], key: str, features: Sequence[str], folds: Sequence = (None,), kind: str = "loso", c: float = 1.0, rounds: int = ROUNDS, block: int = FIT_BLOCK) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """(scale, coefficients, intercept, pairs) of each fold: L2 logistic regression on pair differences over their population deviation (0: left alone).

    All folds are fitted together by Newton's method; the intercept, which is not penalised, is 0.
    """
    held = dealt(stored(packed_blocks(df, group, order, key, features, block), "blocks"), len(folds))
    try:
        return _fit(held, df, group, list(features), list(folds), kind, c, rounds)
    finally:
        held.dropped()


def _fit(held: Stored, df: DataFrame, group: str, names: list[str], folds: list, kind: str, c: float, rounds: int) -> list:
    d, n_folds = len(names), len(folds)
    spread = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(names)))
    if folds == [None]:  # only the sums over all pools
        n = F.col("n").cast("double")
        sums = spread.agg(F.coalesce(F.sum(n * (n - 1)), F.lit(0.0)), *(F.coalesce(F.sum(2 * n * n * F.col(f"v{i}")), F.lit(0.0)) for i in range(d))).first()
        pairs, squares = np.array([sums[0]]), np.array([sums[1:]], dtype=float).reshape(1, d)
    else:
        pdf = spread.toPandas()  # a row a year
        mask = np.stack([uses(kind, folds, y) for y in pdf[group]], axis=1).astype(float) if len(pdf) else np.zeros((n_folds, 0))
        n = pdf["n"].to_numpy(float)
        pairs = mask @ (n * (n - 1))
        squares = mask @ (2 * (n * n)[:, None] * pdf[[f"v{i}" for i in range(d)]].to_numpy(float))
    scale = np.sqrt(np.maximum(squares / np.maximum(pairs, 1)[:, None], 0))  # differences of both directions have mean 0
    scale[scale < 1e-12] = 1.0
    w = np.zeros((n_folds, d))
    own, *apart = meetings(held.frame)
    met, n_tasks = [own, *(part.repartition(most_tasks(part)) for part in apart)], held.frame.rdd.getNumPartitions()
    for _ in range(rounds):
        g, h = np.zeros((n_folds, d)), np.zeros((n_folds, d, d))
        for part, tasks in zip(met, (n_tasks, None)):
            flat = sum_of(part.mapInPandas(newton_part(kind, folds, d, scale, w.copy()), "payload binary"), tasks)
            if flat is not None:
                g += flat[: g.size].reshape(g.shape)
                h += flat[g.size :].reshape(h.shape)
        steps = np.stack([np.linalg.solve(c * h[f] + np.eye(d), c * g[f] + w[f]) if pairs[f] else np.zeros(d) for f in range(n_folds)])
        w -= steps
        if np.abs(steps).max(initial=0.0) < 1e-8:
            break
    return [(scale[f], w[f], 0.0, int(pairs[f])) for f in range(n_folds)]


def newton_part(kind: str, folds: list, d: int, scale: np.ndarray, now: np.ndarray):
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros((len(folds), d)), np.zeros((len(folds), d, d))
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                x, y = (np.frombuffer(raw, "<f8").reshape(-1, d) for raw in (r.x, r.y))
                for f in np.flatnonzero(uses(kind, folds, r.pool)).tolist():
                    more = pair_sums(x / scale[f], y / scale[f], now[f], r.same)
                    g[f] += more[0]
                    h[f] += more[1]
        yield pd.DataFrame({"payload": [np.concatenate([g.reshape(-1), h.reshape(-1)]).tobytes()]})

    return partial
