"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; pieces that fill a
sequence keep one to themselves. The others are dealt at random into blocks of
bounded size, which are separate packing problems. Every block is evolved on
several islands: a chromosome is a set of whole sequences, crossover injects
well-filled sequences of one parent into the other, drops the sequences that
hold the same pieces and best-fits what that displaced. Between epochs each
island's elite moves to the next island of its ring; an epoch's state is a table
in the shared folder, so a lost executor repeats one task of one epoch. A block
evolves until it has as few sequences as its tokens need, or no island got better
for ``PATIENCE`` epochs.

A block of n pieces wastes at most a sequence or two against one large problem,
so blocks cost nothing noticeable and no task ever sees more than one block.

Edge cases: null and empty texts hold the end id alone; repeated rows are packed
as often as they occur; texts of any length are cut whole; an empty table gives
no rows; pieces of equal length are placed in the order of their rows. Only doc_id
and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.bpe import codec
from rankloom.llm.work import id_text, table

BLOCK = 8192  # pieces of one packing problem, on average
ISLANDS = 3
PATIENCE = 2  # epochs without a better packing on any island before a block is settled
POPULATION = 6
CROSSOVERS = 24  # in an epoch, on each island
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, rows binary, lengths binary, sequences long, fill double, population array<binary>, quiet int"


def cut_pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece; only longer documents are cut, the first piece takes the odd length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = codec(tokenizer_path), struct.pack("<I", end_id)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[tuple] = []
                for key, ids in zip(part.column(0).to_pylist(), bpe.encode_many(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        out.append((row, key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                        row += 1
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(df).mapInArrow(run, PIECES)


def best_fit(order: list[int], lengths: list[int], bins: np.ndarray, free: list[int], new: int, capacity: int) -> int:
    """Place pieces in this order into the fullest sequence they fit; ``free`` is sorted (space << 32 | sequence)."""
    for i in order:
        size = lengths[i]
        k = bisect_left(free, size << 32)
        if k == len(free):
            space, at, new = capacity - size, new, new + 1
        else:
            v = free.pop(k)
            space, at = (v >> 32) - size, v & 0xFFFFFFFF
        bins[i] = at
        if space:
            insort(free, space << 32 | at)
    return new


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def score(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then how unevenly they are filled: nearly empty ones are easier to dissolve."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return len(fill), -float(np.mean(fill**2)) if len(fill) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject whole well-filled sequences of ``b`` into ``a``; best-fit the pieces displaced by that."""
    fill = np.bincount(b, weights=lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[rng.choice(good, size=max(1, len(good) // 3), replace=False)] = True
    given = chosen[b]
    used = np.bincount(a, weights=lengths)
    hit = np.zeros(len(used), dtype=bool)
    hit[a[given]] = True
    # the emptiest sequences go too: they are what a better packing does without
    hit[np.argsort(used, kind="stable")[: max(1, len(used) // 50)]] = True
    child = a.astype(np.int64)
    child[given] = len(used) + b[given]
    loose = np.flatnonzero(hit[a] & ~given)
    space = (capacity - used).astype(np.int64)
    open_ = np.flatnonzero(~hit & (space > 0))
    free = np.sort((space[open_] << 32) | open_).tolist()
    order = loose[np.argsort(-lengths[loose], kind="stable")].tolist()
    best_fit(order, lengths.tolist(), child, free, len(used) + len(fill), capacity)
    return compact(child)


def gap_filled(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Each sequence begins with the longest piece left and takes the piece, or the two pieces, that fill its gap best."""
    left = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    next_of = np.cumsum(left) - left  # where the pieces of a length not yet placed begin in ``order``
    bins, n = np.zeros(len(lengths), dtype=np.int64), 0
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return compact(bins)
        gap, take = capacity, [int(sizes[-1])]
        while take:
            for size in take:
                bins[order[next_of[size]]] = n
                next_of[size] += 1
                left[size] -= 1
                gap -= size
            sizes = np.flatnonzero(left[: gap + 1])
            take = []
            if len(sizes):
                one, take = int(sizes[-1]), [int(sizes[-1])]
                other = np.searchsorted(sizes, gap - sizes, side="right") - 1
                other -= (other >= 0) & (sizes[other] == sizes) & (left[sizes] < 2)
                pair = np.where(other >= 0, sizes + sizes[other], 0)
                k = int(np.argmax(pair))
                if pair[k] > one:
                    take = [int(sizes[k]), int(sizes[other[k]])]
        n += 1


def first_population(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit by falling length; where that isn't perfect, also by filled gaps and by falling length under growing noise."""
    out = []
    for k in range(POPULATION):
        noisy = lengths * (1 + 0.15 * k * rng.random(len(lengths)))
        bins = np.zeros(len(lengths), dtype=np.int64)
        best_fit(np.argsort(-noisy, kind="stable").tolist(), lengths.tolist(), bins, [], 0, capacity)
        out.append(compact(bins))
        if k == 0:
            if score(out[0], lengths, capacity)[0] <= fewest(lengths, capacity):
                break
            out.append(gap_filled(lengths, capacity))
    return out


def fewest(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: all tokens need a place, and no two pieces longer than a half share one."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def evolve(population: list[np.ndarray], lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The fittest first; stops early once no packing can have fewer sequences."""
    rank = lambda people: [x for _, x in sorted(((score(x, lengths, capacity), x) for x in people), key=lambda p: p[0])[:POPULATION]]
    ranked = rank(population)
    for _ in range(CROSSOVERS):
        if score(ranked[0], lengths, capacity)[0] <= fewest(lengths, capacity) or len(ranked) < 2:
            break
        i, j = rng.choice(len(ranked), size=2, replace=False)
        ranked = rank([*ranked, crossover(ranked[i], ranked[j], lengths, capacity, rng)])
    return ranked


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """row, sequence_id, offset for every row of ``pieces`` (a stored table with unique ``row`` and ``length``)."""
    rest = pieces.where(F.col("length") < capacity).select("row", "length")
    blocks = max(1, round(rest.count() / BLOCK))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True])
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        block, out = int(pdf["block"].iloc[0]), []
        for island in range(ISLANDS):
            out.append((block, island, pdf["row"].to_numpy("<i8").tobytes(), lengths.astype("<i4").tobytes(), 0, 0.0, [], 0))
        return pd.DataFrame(out, columns=["block", "island", "rows", "lengths", "sequences", "fill", "population", "quiet"])

    def epoch(k: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for s in pdf.itertuples(index=False):
                    lengths = np.frombuffer(s.lengths, dtype="<i4").astype(np.int64)
                    rng = np.random.default_rng([k, s.block, s.island])
                    people = [np.frombuffer(p, dtype="<i4") for p in s.population] or first_population(lengths, capacity, rng)
                    if k and s.elite is not None:
                        people.append(np.frombuffer(s.elite, dtype="<i4"))
                    people = evolve(people, lengths, capacity, rng)
                    n, fill = score(people[0], lengths, capacity)
                    quiet = -1 if n <= fewest(lengths, capacity) else s.quiet + 1 if k and n >= s.sequences else 0
                    yield pd.DataFrame([(s.block, s.island, s.rows, s.lengths, n, fill, [p.astype("<i4").tobytes() for p in people], quiet)], columns=["block", "island", "rows", "lengths", "sequences", "fill", "population", "quiet"])

        return run

    state = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInPandas(found, STATE)
    active, settled, k = table(state.repartition("block", "island").mapInPandas(epoch(0), STATE), "islands-0"), [], 0
    while True:
        # a block is settled once an island can't be better (quiet is -1), or all have been quiet
        ended = active.groupBy("block").agg(((F.min("quiet") < 0) | (F.min("quiet") >= PATIENCE)).alias("ended"))
        told = active.join(ended, "block")
        settled.append(told.where("ended").drop("ended"))
        active = told.where("NOT ended").drop("ended")
        if not active.take(1):
            break
        k += 1
        moved = active.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
        active = table(active.join(moved, ["block", "island"], "left").mapInPandas(epoch(k), STATE), f"islands-{k}")
    state = reduce(DataFrame.unionByName, settled)

    best = state.groupBy("block").agg(F.min(F.struct("sequences", "fill", "island")).alias("best"))
    chosen = state.join(best.select("block", F.col("best.island").alias("island")), ["block", "island"]).select("block", "rows", "lengths", F.col("population")[0].alias("bins"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for s in pdf.itertuples(index=False):
                rows, lengths, bins = (np.frombuffer(x, dtype=d) for x, d in ((s.rows, "<i8"), (s.lengths, "<i4"), (s.bins, "<i4")))
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order].astype(np.int64))
                starts = ends - lengths[order]
                first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                yield pd.DataFrame({"row": rows[order], "sequence_id": (int(s.block) << 20) + bins[order].astype(np.int64), "offset": starts - np.maximum.accumulate(np.where(first, starts, 0))})

    shared = chosen.mapInPandas(place, "row long, sequence_id long, offset long")
    alone = pieces.where(F.col("length") >= capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = table(cut_pieces(df, tokenizer_path, end_id, capacity), "pieces")
    return pieces.join(pack_pieces(pieces, capacity), "row").drop("row")
