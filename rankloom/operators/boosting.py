"""A listwise ranker: boosted histogram trees on NDCG gradients, fitted where the pools lie.

Features are cut at approximate quantiles into byte codes. A pool (the candidates
of one year) is packed into one row; every pass over the packed table computes the
pools' gradients and adds them up by fold, tree node, feature and code, within a
task first and then, with many tasks, within a few groups of tasks. The driver gets
those sums only, picks the splits and sends the tree's next level back. Scores are
kept in the table and brought up to date every ``KEEP`` rounds. No row reaches the
driver, there is no limit on rows, and all folds of a validation are fitted in the
same passes. A pool lies in one task, with a byte for each of its values and a few
numbers a row and fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.sums import sum_of
from rankloom.sources.shared import read_text, stored, write_text

SEED = 20260728
BINS = 32  # codes of a feature; one more stands for missing values
KEEP = 16  # rounds between two written states
FOLDS = 64  # folds fitted at a time
ROWS_A_TASK = 50_000  # rows x folds


@dataclass(frozen=True)
class ListwiseRanker:
    """Regression trees in level order: (feature, threshold, missing goes left) of the inner nodes, values of the leaves."""

    features: tuple[str, ...]
    depth: int
    inner: tuple[tuple[tuple[int, float, bool], ...], ...]
    leaves: tuple[tuple[float, ...], ...]
    gain: tuple[float, ...]

    def score(self) -> Column:
        """The ensemble as one expression, so scoring stays in the JVM."""

        def walk(inner, leaves, at: int) -> Column:
            if at >= len(inner):
                return F.lit(leaves[at - len(inner)])
            feature, threshold, left_if_missing = inner[at]
            if feature < 0:
                return walk(inner, leaves, 2 * at + 1)
            c = F.nanvl(F.col(self.features[feature]).cast("double"), F.lit(None).cast("double"))
            low, high = walk(inner, leaves, 2 * at + 1), walk(inner, leaves, 2 * at + 2)
            return F.when(c.isNull(), low if left_if_missing else high).when(c < threshold, low).otherwise(high)

        total = F.lit(0.0)
        for inner, leaves in zip(self.inner, self.leaves):
            total = total + walk(inner, leaves, 0)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for inner, leaves in zip(self.inner, self.leaves):
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f, t, m = (np.array([inner[k][j] for k in at]) for j in range(3))
                v = x[np.arange(len(x)), np.maximum(f, 0)] if x.shape[1] else np.full(len(x), np.nan)
                left = (f < 0) | np.where(np.isnan(v), m, v < t)
                at = 2 * at + np.where(left, 1, 2)
            out += np.array(leaves)[at - len(inner)]
        return out

    def to_json(self) -> str:
        return json.dumps({"kind": "listwise"} | asdict(self))

    @staticmethod
    def from_json(text: str) -> ListwiseRanker:
        d = json.loads(text)
        inner = tuple(tuple((int(f), float(t), bool(m)) for f, t, m in tree) for tree in d["inner"])
        return ListwiseRanker(tuple(d["features"]), d["depth"], inner, tuple(map(tuple, d["leaves"])), tuple(d["gain"]))


def save_ranker(spark: SparkSession, model: ListwiseRanker, path: str) -> str:
    """The model as JSON, with its feature order, on any file system that Spark knows."""
    return write_text(spark, path, model.to_json())


def load_ranker(spark: SparkSession, path: str) -> ListwiseRanker:
    return ListwiseRanker.from_json(read_text(spark, path))


def relevance_of(rank: np.ndarray) -> np.ndarray:
    """32 - rank, 1 at least; rows without a rank count as the last."""
    return np.where(np.isnan(rank), 1.0, np.maximum(32 - rank, 1))


def gradients(score: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the pairwise logistic loss, weighted by what swapping two rows does to the pool's NDCG.

    ``score`` has a row a fold; ``gain`` falls. Only rows above the least gain have
    somebody below them, so a pool of n rows takes n times as many steps as it has such rows, and no table of pairs.
    """
    g, h = np.zeros_like(score), np.zeros_like(score)
    n = len(gain)
    ideal = float((gain / np.log2(2.0 + np.arange(n))).sum())
    if n < 2 or ideal <= 0:
        return g, h
    place = np.empty(score.shape, dtype=np.int64)
    np.put_along_axis(place, np.argsort(-score, axis=1, kind="stable"), np.arange(n)[None], axis=1)
    discount = 1 / np.log2(2.0 + place)
    below = np.searchsorted(-gain, -gain, side="right")  # the first row of a lesser gain
    for i in np.flatnonzero(below < n).tolist():
        j = slice(int(below[i]), n)
        change = (gain[i] - gain[j])[None] * np.abs(discount[:, i : i + 1] - discount[:, j]) / ideal
        p = 1 / (1 + np.exp(np.clip(score[:, i : i + 1] - score[:, j], -35, 35)))
        pull, bend = change * p, change * p * (1 - p)
        g[:, j] += pull
        h[:, j] += bend
        g[:, i] -= pull.sum(axis=1)
        h[:, i] += bend.sum(axis=1)
    return g, h


@dataclass
class Trees:
    """One tree of each fold: feature (-1: no split), last code of the left side, where missing codes go, leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    leaf: np.ndarray | None = None

    def route(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row after so many levels, a row a fold."""
        at = np.zeros((len(self.feature), len(codes)), dtype=np.int64)
        for _ in range(levels):
            f = np.take_along_axis(self.feature, at, axis=1)
            c = codes[np.arange(len(codes))[None], np.maximum(f, 0)]
            left = (f < 0) | np.where(c == BINS, np.take_along_axis(self.missing_left, at, axis=1), c <= np.take_along_axis(self.cut, at, axis=1))
            at = 2 * at + np.where(left, 1, 2)
        return at

    def values(self, codes: np.ndarray, depth: int) -> np.ndarray:
        return np.take_along_axis(self.leaf, self.route(codes, depth) - (2**depth - 1), axis=1)


def uniform(seed: int, round_: int, pool: int, n: int) -> np.ndarray:
    """A number in [0, 1) for every row of a pool, the same in every run and on every executor."""
    x = np.arange(n, dtype=np.uint64) + np.uint64((pool ^ (round_ * 0x9E3779B97F4A7C15) ^ (seed << 32)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Approximate quantiles of each feature, distinct; none where all values are missing."""
    if not features:
        return []
    number = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    found = df.agg(*(F.percentile_approx(number(f), [i / bins for i in range(1, bins)], 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(found[i] or [], dtype=float)) for i in range(len(features))]


def packed_pools(df: DataFrame, group: str, rank: str, key: str, features: Sequence[str], cuts: list[np.ndarray], folds: int) -> DataFrame:
    """pool (a hash), year, n, gain, codes, score: one row a pool, its rows by rank and key."""
    names = list(features)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rank", "_key"], kind="stable", na_position="last")
        codes = np.full((len(pdf), len(names)), BINS, dtype=np.uint8)
        for i, f in enumerate(names):
            v = pdf[f].to_numpy(float)
            known = ~np.isnan(v)
            codes[known, i] = np.searchsorted(cuts[i], v[known], side="right")
        gain = relevance_of(pdf["_rank"].to_numpy(float))
        return pd.DataFrame({"pool": [pdf["_pool"].iloc[0]], "year": [pdf["_year"].iloc[0]], "n": [len(pdf)], "gain": [gain.astype("<f8").tobytes()], "codes": [codes.tobytes()], "score": [np.zeros(folds * len(pdf)).tobytes()]})

    rows = df.select(F.xxhash64(group).alias("_pool"), F.col(group).cast("string").alias("_year"), F.col(rank).cast("double").alias("_rank"), F.col(key).cast("string").alias("_key"), *(F.col(f).cast("double").alias(f) for f in names))
    return rows.groupBy("_pool", "_year").applyInPandas(pack, "pool long, year string, n int, gain binary, codes binary, score binary")


@dataclass
class Settings:
    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    share: float = 0.8
    l1: float = 1.0
    l2: float = 5.0
    least: float = 5.0
    seed: int = SEED


def in_folds(kind: str, folds: list[str | None], year: str | None) -> np.ndarray:
    """Which folds train on a pool: all others (loso), later ones (expanding; years compare as numbers), or the only one."""
    if folds == [None]:
        return np.ones(1, dtype=bool)
    if kind == "loso":
        return np.array([f != year for f in folds])
    return np.array([float(year) < float(f) for f in folds])


def histogram_pass(packed: DataFrame, kind: str, folds: list, d: int, done: list[Trees], growing: Trees, level: int, round_: int, s: Settings, tasks: int) -> np.ndarray | None:
    """Sums of gradient and curvature by (fold, node of the level, feature, code), then each fold's curvature and rows over all its pools."""
    nodes, codes_, depth = 2**level, BINS + 1, s.depth
    size = len(folds) * nodes * d * codes_

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, size))
        whole = np.zeros((2, len(folds)))
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                use = in_folds(kind, folds, r.year)
                if not use.any():
                    continue
                codes = np.frombuffer(r.codes, np.uint8).reshape(r.n, d)
                score = np.frombuffer(r.score).reshape(len(folds), r.n)
                for t in done:
                    score = score + t.values(codes, depth)
                g, h = gradients(score, np.frombuffer(r.gain, "<f8"))
                g, h = g * use[:, None], h * use[:, None]
                whole += np.stack([h.sum(axis=1), use * float(r.n)])
                taken = np.flatnonzero(uniform(s.seed, round_, r.pool, r.n) < s.share)
                node = (growing.route(codes, level) - (nodes - 1))[:, taken]
                at = (np.arange(len(folds))[:, None] * nodes + node)[:, :, None] * d + np.arange(d)[None, None]
                at = (at * codes_ + codes[taken][None]).reshape(-1)
                for i, v in enumerate((g, h)):
                    sums[i] += np.bincount(at, weights=np.repeat(v[:, taken].reshape(-1), d), minlength=size)
        yield pd.DataFrame({"payload": [np.concatenate([sums.reshape(-1), whole.reshape(-1)]).tobytes()]})

    return sum_of(packed.mapInPandas(run, "payload binary"), tasks)


def splits(sums: np.ndarray, cuts: list[np.ndarray], columns: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """gain, feature, cut, missing_left and (left, right) sums of the best split of each fold and node; ``sums``: 2 x folds x nodes x features x codes."""
    best = lambda g, h: np.maximum(np.abs(g) - s.l1, 0) ** 2 / (h + s.l2)
    g, h = sums
    gs, hs = g[:, :, 0].sum(axis=-1), h[:, :, 0].sum(axis=-1)  # every feature has all rows of the node
    won = np.full((*gs.shape, len(cuts), 2, BINS), 0.0)
    left = np.zeros((2, *won.shape))
    for f in columns:
        k = len(cuts[f])
        for way, missing_left in enumerate((True, False)):
            gl, hl = (np.cumsum(v[:, :, f, :k], axis=-1) + v[:, :, f, BINS, None] * missing_left for v in (g, h))
            ok = (hl >= s.least) & (hs[..., None] - hl >= s.least)
            won[:, :, f, way, :k] = np.where(ok, best(gl, hl) + best(gs[..., None] - gl, hs[..., None] - hl) - best(gs, hs)[..., None], 0)
            left[0, :, :, f, way, :k], left[1, :, :, f, way, :k] = gl, hl
    flat = won.reshape(*gs.shape, -1)
    at = flat.argmax(axis=-1)
    gain = np.take_along_axis(flat, at[..., None], axis=-1)[..., 0]
    feature, way, cut = np.unravel_index(at, won.shape[2:])
    none = gain <= 1e-12
    here = np.take_along_axis(left.reshape(2, *gs.shape, -1), at[None, ..., None], axis=-1)[..., 0]
    here = np.where(none[None], np.stack([gs, hs]), here)
    return np.where(none, 0, gain), np.where(none, -1, feature), cut, way == 0, here, np.stack([gs, hs]) - here


def fit_folds(df: DataFrame, group: str, rank: str, key: str, features: Sequence[str], folds: list[str | None], kind: str = "loso", cuts: list[np.ndarray] | None = None, **options) -> list[ListwiseRanker]:
    """A ranker for each fold (one in all for the only fold None)."""
    s, d = Settings(**options), len(features)
    if not d:
        return [ListwiseRanker((), s.depth, (), (), ()) for _ in folds]
    cuts = feature_cuts(df, features) if cuts is None else cuts
    packed = stored(packed_pools(df, group, rank, key, features, cuts, len(folds)), "pools")
    try:
        return _fit(packed, list(features), folds, kind, cuts, s)
    finally:
        packed.dropped()


def _fit(packed, features: list[str], folds: list, kind: str, cuts: list[np.ndarray], s: Settings) -> list[ListwiseRanker]:
    d, n_folds = len(features), len(folds)
    rows = packed.frame.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(packed.frame.rdd.getNumPartitions(), rows * n_folds // ROWS_A_TASK))
    held = packed.frame.coalesce(tasks).persist()
    trees: list[Trees] = []
    gains = np.zeros((n_folds, d))
    done: list[Trees] = []
    old = []
    try:
        for round_ in range(s.rounds if rows else 0):
            columns = np.sort(np.random.default_rng([s.seed, round_]).choice(d, max(1, round(s.share * d)), replace=False))
            inner = 2**s.depth - 1
            tree = Trees(np.full((n_folds, inner), -1), np.zeros((n_folds, inner), dtype=np.int64), np.ones((n_folds, inner), dtype=bool))
            for level in range(s.depth):
                flat = histogram_pass(held, kind, folds, d, done, tree, level, round_, s, tasks)
                whole = flat[-2 * n_folds :].reshape(2, n_folds)
                unit = np.maximum(whole[0] / np.maximum(whole[1], 1), 1e-12)  # a row has a curvature of 1 on average, so l1, l2 and least count rows
                sums = flat[: -2 * n_folds].reshape(2, n_folds, 2**level, d, BINS + 1) / unit[None, :, None, None, None]
                gain, feature, cut, missing_left, left, right = splits(sums, cuts, columns, s)
                here = slice(2**level - 1, 2 ** (level + 1) - 1)
                tree.feature[:, here], tree.cut[:, here], tree.missing_left[:, here] = feature, cut, missing_left
                for f in range(d):
                    gains[:, f] += np.where(feature == f, gain, 0).sum(axis=1)
            ends = np.stack([left, right], axis=-1).reshape(2, n_folds, -1)
            tree.leaf = -s.rate * np.sign(ends[0]) * np.maximum(np.abs(ends[0]) - s.l1, 0) / (ends[1] + s.l2)
            trees.append(tree)
            done.append(tree)
            if len(done) == KEEP and round_ + 1 < s.rounds:
                now = stored(brought_up(held, done, n_folds, d, s.depth), "scores")
                held.unpersist()
                for x in old:
                    x.dropped()
                old, done = [now], []
                held = now.frame.coalesce(tasks).persist()
    finally:
        held.unpersist()
        for x in old:
            x.dropped()
    threshold = lambda f, c: float(cuts[f][c]) if f >= 0 else 0.0
    models = []
    for k in range(n_folds):
        inner = tuple(tuple((int(f), threshold(int(f), int(c)), bool(m)) for f, c, m in zip(t.feature[k], t.cut[k], t.missing_left[k])) for t in trees)
        models.append(ListwiseRanker(tuple(features), s.depth, inner, tuple(tuple(map(float, t.leaf[k])) for t in trees), tuple(gains[k].tolist())))
    return models


def brought_up(packed: DataFrame, done: list[Trees], n_folds: int, d: int, depth: int) -> DataFrame:
    """The same pools with the scores after the trees in ``done``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                codes = np.frombuffer(r.codes, np.uint8).reshape(r.n, d)
                score = np.frombuffer(r.score).reshape(n_folds, r.n)
                for t in done:
                    score = score + t.values(codes, depth)
                out.append(score.tobytes())
            yield pdf.assign(score=out)

    return packed.mapInPandas(run, packed.schema)


def train_listwise(df: DataFrame, group: str, rank: str, key: str, features: Sequence[str], **options) -> ListwiseRanker:
    """Trees that rank each group's rows, fitted on the NDCG of relevance 32 - rank (1 at least)."""
    return fit_folds(df, group, rank, key, features, [None], **options)[0]


def cross_validate_listwise(df: DataFrame, year: str, key: str, rank: str, features: Sequence[str], kind: str = "loso", **options) -> DataFrame:
    """year, key, rank, score by a listwise model of all other years (loso) or of the earlier ones (expanding)."""
    years = [str(r[0]) for r in df.select(year).distinct().orderBy(year).collect() if r[0] is not None]  # a row a year
    cuts = feature_cuts(df, features)
    models: dict[str, ListwiseRanker] = {}
    for i in range(0, len(years), FOLDS):
        models |= zip(years[i : i + FOLDS], fit_folds(df, year, rank, key, features, years[i : i + FOLDS], kind, cuts, **options))
    names = list(features)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            score = np.zeros(len(pdf))
            for y, at in pdf.groupby(pdf["_y"]).indices.items():
                score[at] = models[y].predict(pdf[names].to_numpy(float)[at])
            yield pd.DataFrame({year: pdf[year], key: pdf[key], rank: pdf[rank], "score": score})

    rows = df.where(F.col(year).isNotNull()).select(year, F.col(key).cast("string").alias(key), F.col(rank).cast("int").alias(rank), F.col(year).cast("string").alias("_y"), *(F.col(f).cast("double").alias(f) for f in names))
    return rows.mapInPandas(scored, f"{year} {dict(df.dtypes)[year]}, {key} string, {rank} int, score double")
