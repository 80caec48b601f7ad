"""Exact top-k search by inner product over a bit-sliced index.

Index: rows are dealt evenly to blocks. For each attribute (vector component) of a
block, its integers are taken relative to the attribute's least one and stored as
slices: one bitmap over the block's rows for each bit. The index is a stored
table, a row for each block, dimension and attribute.

Search: a query's integer weights are written in signed binary digits. Every
nonzero digit adds the upper slices of its attribute (complemented, for a negative
digit) at its place; all slices of one place are added with carry-save adders, three
bitmaps becoming a sum and a carry, so the scores of a block's rows come out as
slices themselves. The ``k`` largest are found from the most significant slice
downward. The slices that were left out (``LOW`` of each attribute) can change a
score by a known bound only, so rows within that bound of the k-th one are the
boundary: their exact scores are computed from all their slices.

Queries meet all blocks, in groups: a task has one block and at most
``QUERIES`` queries, and hands on ``k`` rows a query. No row is left out at any size.

Edge cases: a component becomes floor(1024 x) of x as double. Vectors that are null,
hold null or non-finite components, have no id, or whose integers are so large that
an inner product could pass 62 bits (a length of 2**31 or more; components of about
two millions) take no part. Only vectors of as many components have an inner
product; empty ones score 0. A row is no candidate of itself; other rows of its id
are, and rows that share an id are queries of their own. Equal scores go to the smaller
vec_id. Fewer than k candidates give as many ranks; an empty table gives no rows.
Only the id and the vector are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.work import table

BLOCK, LEAST_BLOCK = 1 << 16, 1 << 13  # rows of a block at most, and where the table is small
QUERIES = 1 << 12  # of one task at most
SCALE = 1024
LOW = 3  # low slices of an attribute that the first pass leaves out
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def integers(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and x, the integer components, of the rows that take part."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * SCALE))
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < 2.0**31))
    length = F.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, x).alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (length < 2.0**62))


def slices_of(values: np.ndarray) -> tuple[int, np.ndarray]:
    """The least value and the bitmaps (64-bit words, row 0 first) of the rest, lowest bit first."""
    least = int(values.min())
    rest = (values - least).astype(np.uint64)
    bits = max(int(rest.max()).bit_length(), 1)
    words = -(-len(values) // 64)
    out = np.zeros((bits, words * 64), dtype=np.uint8)
    for b in range(bits):
        out[b, : len(values)] = (rest >> np.uint64(b)) & np.uint64(1)
    return least, np.packbits(out, axis=1, bitorder="little").view("<u8")


def build(rows: DataFrame) -> DataFrame:
    """block, dims, at, least, bits, slices: the stored index; at -1 stands for the row numbers and at -2 for the ids, in the order of ids."""
    n = rows.count()
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // BLOCK), min(-(-n // LEAST_BLOCK), shares), 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held)
        block = TaskContext.get().partitionId()
        number, ids = (got.column(i).to_numpy() for i in (0, 1))
        vectors = got.column(2).combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        flat, start = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        for dims in np.unique(sizes).tolist():
            here = np.flatnonzero(sizes == dims)
            here = here[np.lexsort((number[here], ids[here]))]
            found = [(-1, 0, 64, number[here].astype("<i8").tobytes()), (-2, 0, 64, ids[here].astype("<i8").tobytes())]
            for at in range(dims):
                least, slices = slices_of(flat[start[here] + at])
                found.append((at, least, len(slices), slices.tobytes()))
            at, least, bits, raw = zip(*found)
            m = len(found)
            yield pa.record_batch([pa.array([block] * m, pa.int32()), pa.array([dims] * m, pa.int32()), pa.array(at, pa.int32()), pa.array(least, pa.int64()), pa.array(bits, pa.int32()), pa.array(raw, pa.binary())], names=["block", "dims", "at", "least", "bits", "slices"])

    return rows.repartition(blocks).select("row", "vec_id", "x").mapInArrow(run, "block int, dims int, at int, least long, bits int, slices binary")


class Block:
    """The slices of one block's rows of one dimension."""

    def __init__(self, index: pd.DataFrame):
        held = {r.at: r for r in index.itertuples(index=False)}
        self.rows, self.ids = (np.frombuffer(held[i].slices, "<i8") for i in (-1, -2))
        self.n, self.dims = len(self.rows), len(held) - 2
        self.words = -(-self.n // 64)
        part = [held[i] for i in range(self.dims)]
        self.least = np.array([p.least for p in part], dtype=np.int64)
        self.bits = np.array([p.bits for p in part], dtype=np.int64)
        full = [np.frombuffer(p.slices, "<u8").reshape(p.bits, self.words) for p in part]
        upper = [f[min(LOW, len(f)) :] for f in full]
        self.first = np.cumsum([0, *(len(u) for u in upper)])
        self.upper = np.concatenate(upper) if upper else np.zeros((0, self.words), np.uint64)
        self.values = np.stack([self._values(f, p.least) for f, p in zip(full, part)], axis=1) if part else np.zeros((self.n, 0), np.int64)
        last = np.zeros(self.words * 64, np.uint8)
        last[: self.n] = 1
        self.all = np.packbits(last, bitorder="little").view("<u8")

    def _values(self, slices: np.ndarray, least: int) -> np.ndarray:
        """The integers again, from all their slices: what the boundary is resolved with."""
        out = np.full(self.n, least, dtype=np.int64)
        for b, s in enumerate(slices):
            out += np.unpackbits(s.view(np.uint8), bitorder="little")[: self.n].astype(np.int64) << b
        return out

    def sums(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of sum(weight x upper part), lowest first, up to a constant; and by how much the rest can move a row against another."""
        low = np.minimum(self.bits, LOW)
        slack = int((np.abs(weights) * ((1 << low) - 1)).sum())
        at, place, negative = signed_digits(weights)
        width = self.first[at + 1] - self.first[at]  # each digit takes all upper slices of its attribute
        bit = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        place = np.repeat(place, width) + bit
        order = np.argsort(place, kind="stable")
        taken = self.upper[(np.repeat(self.first[at], width) + bit)[order]]
        taken ^= np.where(np.repeat(negative, width)[order], ALL, np.uint64(0))[:, None]
        ends = np.searchsorted(place[order], np.arange(int(place.max(initial=-1)) + 2))
        return add_slices([taken[i:j] for i, j in zip(ends, ends[1:])], self.words), slack

    def search(self, row: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the best k rows but the query's own, best first."""
        found, slack = self.sums(weights)
        near = np.flatnonzero(np.unpackbits(boundary(found, self.all, k + 1, -(-slack // (1 << LOW))).view(np.uint8), bitorder="little")[: self.n])
        near = near[self.rows[near] != row]
        score = self.values[near] @ weights
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near[best]], score[best]


def signed_digits(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(attribute, place, whether negative) of the nonzero digits of all weights in signed binary, where no two neighbours are nonzero."""
    size = np.abs(weights).astype(np.uint64)
    thrice, half = size + (size >> np.uint64(1)), size >> np.uint64(1)
    plus, minus = thrice & ~half, half & ~thrice
    at, place, negative = [], [], []
    for bit in range(int((plus | minus).max(initial=0)).bit_length()):
        for digits, sign in ((plus, False), (minus, True)):
            found = np.flatnonzero(digits >> np.uint64(bit) & np.uint64(1))
            at.append(found)
            place.append(np.full(len(found), bit))
            negative.append((weights[found] < 0) != sign)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(at), np.concatenate(place), np.concatenate(negative)


def add_slices(places: list[np.ndarray], words: int) -> list[np.ndarray]:
    """The sum of all bitmaps, those of the i-th array worth 2**i each, as slices: full adders take three bitmaps of a place to one there and one above."""
    out, carried, place = [], [], 0
    while place < len(places) or carried:
        x = np.concatenate([*places[place : place + 1], *carried])
        carried = []
        while len(x) > 2:
            third = len(x) // 3
            a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
            half = a ^ b
            carried.append((a & b) | (half & c))
            half ^= c
            x = np.concatenate([half, x[3 * third :]]) if len(x) % 3 else half
        if len(x) == 2:
            carried.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        place += 1
    return out


def boundary(slices: list[np.ndarray], rows: np.ndarray, k: int, slack: int) -> np.ndarray:
    """The rows whose sum is at least that of the k-th largest less ``slack``, found from the most significant slice downward."""
    if int(np.bitwise_count(rows).sum()) <= k:
        return rows
    above, equal, kth, wanted = np.zeros_like(rows), rows, 0, k
    for place in range(len(slices) - 1, -1, -1):
        with_bit = equal & slices[place]
        n = int(np.bitwise_count(with_bit).sum())
        if n >= wanted:  # the k-th row has this bit
            kth |= 1 << place
            equal = with_bit
        else:
            wanted -= n
            equal = equal & ~slices[place]
    least = max(kth - slack, 0)
    above, equal = np.zeros_like(rows), rows
    for place in range(len(slices) - 1, -1, -1):
        if least >> place & 1:
            equal = equal & slices[place]
        else:
            above = above | (equal & slices[place])
            equal = equal & ~slices[place]
    return above | equal


def search_block(key: tuple, queries: pd.DataFrame, index: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(index):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "query_id", "vec_id", "score")})
    block, parts = Block(index), []
    for row, query, x in zip(queries["row"], queries["query_id"], queries["x"]):
        ids, score = block.search(row, np.asarray(x, dtype=np.int64), k)
        parts.append((np.full(len(ids), row), np.full(len(ids), query), ids, score))
    return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), map(np.concatenate, zip(*parts)))))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest integer inner products for every row that ``is_query`` (of its vec_id) holds for."""
    rows = table(integers(df, id_col, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    index = table(build(rows), "slices")
    queries = rows.where(is_query).select("row", F.col("vec_id").alias("query_id"), "x", F.size("x").alias("dims"))
    groups = max(-(-queries.count() // QUERIES), 1)
    blocks = index.agg(F.max("block")).first()[0] or 0
    asked = queries.select("*", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block"))
    met = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    found = asked.groupBy("block", "dims", "part").cogroup(met.groupBy("block", "dims", "part")).applyInPandas(lambda key, q, i: search_block(key, q, i, k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.x[i] * c.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
