"""Similar names by an inverted index of positional q-grams.

Two names of lengths m and n (words sorted) whose ratio reaches r have a common
subsequence of c = r (m + n) / 200 characters at least, so m - c characters of the
one were deleted and n - c inserted to get the other. A deletion destroys at most
two of a name's bigrams, an insertion one; what is left stands in the other name,
moved by no more than the larger of the two numbers. So of a name's bigrams in any
fixed order, rarest first, one more than can be destroyed holds one that the other
name's prefix of this kind has as well. Only prefixes are indexed and joined by gram.
Names too short to keep a bigram for certain are indexed by single characters in the
same way (a deletion destroys one of them, an insertion none).

No pair is a candidate by its length alone, and none that reaches the ratio is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import token_sort_ratio

BUCKETS = 1 << 16  # of the table that tells frequent grams from rare ones


def common(least: float, total: int) -> int:
    """Characters that names of so many in all have in common at least."""
    return ceil(least * total / 200 - 1e-9)


class Bounds:
    """How many grams of a name of length m are indexed, for a ratio of ``least``."""

    def __init__(self, least: float):
        if not 0 < least <= 100:
            raise ValueError("the least ratio is above 0 and at most 100")
        self.least = least
        slope = 3 * least / 200 - 1  # a bigram stays for certain where 3 c >= m + n + 2
        self.long = None
        if slope > 1e-3:
            self.long = 1 + max((t for t in range(ceil(2 / slope) + 2) if 3 * common(least, t) < t + 2), default=0)
        self.sizes = lru_cache(1 << 16)(self._sizes)

    def _sizes(self, m: int) -> tuple[int, int]:
        """Indexed (characters, bigrams) of a name of m characters; 0 where no partner is found by them."""
        one = two = 0
        for n in range(ceil(m * self.least / (200 - self.least) - 1e-9), int(m * (200 - self.least) / self.least + 1e-9) + 1):
            c = common(self.least, m + n)
            if c > min(m, n):
                continue
            if self.long is None or m + n < self.long:
                one = max(one, m - c + 1)
            else:
                two = max(two, 2 * (m - c) + (n - c) + 1)
        return one, two


def bucket(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def sorted_words(name: str) -> str:
    return " ".join(sorted(name.split()))


def grams_of(name: str, size: int) -> list[tuple[str, int]]:
    return [(name[i : i + size], i) for i in range(len(name) - size + 1)]


def prefix(grams: list[tuple[str, int]], size: int, often: np.ndarray) -> list[tuple[str, int]]:
    """The first ``size`` grams, rarest first; equal grams stay together."""
    if not size:
        return []
    grams = sorted(grams, key=lambda g: (often[bucket(g[0])], g[0], g[1]))
    while size < len(grams) and grams[size][0] == grams[size - 1][0]:
        size += 1
    return grams[:size]


def gram_counts(names: DataFrame) -> np.ndarray:
    """How often the grams of each bucket occur in the names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in frames:
            for name in pdf["name"]:
                s = sorted_words(name)
                for size in (1, 2):
                    for g, _ in grams_of(s, size):
                        seen[bucket(g)] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    often = np.zeros(BUCKETS, dtype=np.int64)
    for r in names.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        often[r.bucket] = r.n
    return often


def indexed(names: DataFrame, least: float, often: np.ndarray) -> DataFrame:
    """name, size (its length), gram, at: the part of each name's grams that is indexed; the empty name has the empty gram."""
    sent = names.sparkSession.sparkContext.broadcast(often)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = Bounds(least)
        for pdf in frames:
            rows = []
            for name in pdf["name"]:
                s = sorted_words(name)
                one, two = bounds.sizes(len(s))
                found = [*prefix(grams_of(s, 1), one, sent.value), *prefix(grams_of(s, 2), two, sent.value)] if s else [("", 0)]
                rows += [(name, len(s), g, at) for g, at in found]
            yield pd.DataFrame(rows, columns=["name", "size", "gram", "at"])

    return names.mapInPandas(run, "name string, size int, gram string, at int")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: distinct names of the two sides (column ``name``) that share an indexed gram in places that allow the ratio."""
    bounds = Bounds(least)
    often = gram_counts(right)
    x, y = (indexed(names, least, often).select(F.col("name").alias(n), F.col("size").alias(f"_{n}"), "gram", F.col("at").alias(f"_{n}_at")) for names, n in ((left, "a"), (right, "b")))
    total = F.col("_a") + F.col("_b")
    shared = F.ceil(F.lit(least) * total / 200 - 1e-9)
    by_two = F.length("gram") == 2
    kind = (total >= bounds.long) == by_two if bounds.long is not None else ~by_two
    fits = (shared <= F.least("_a", "_b")) & (F.abs(F.col("_a_at") - F.col("_b_at")) <= F.greatest("_a", "_b") - shared) & kind
    return x.join(y, "gram").where(fits).select("a", "b").distinct()


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score: the pairs of distinct names (column ``name`` of both sides, nulls left out) whose token-sort ratio reaches ``least``."""
    sides = (df.where(F.col("name").isNotNull()).select("name").distinct() for df in (left, right))
    found = candidates(*sides, least)
    return found.withColumn("score", token_sort_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
