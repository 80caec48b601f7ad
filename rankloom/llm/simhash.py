"""SimHash fingerprints and their near-duplicate groups by a binary trie self-join.

All fingerprints that differ in at most ``budget`` of 64 bits are linked. The
bits are cut into budget + m parts; two linked fingerprints agree in at least m
of them, so for every choice of m parts the fingerprints are dealt by those
parts' bits, put first, and each bucket is the trie below one node. Inside a
task, pairs of trie nodes are traversed together: a node is a range of the sorted
fingerprints, differing bits add up on the way down, and a pair is dropped once
they exceed the budget, or once both ranges lie in one component already. m
grows with the number of fingerprints, so a bucket stays at a few thousand.

A bucket above ``MOST`` fingerprints is cut into chunks that meet pairwise in
tasks of their own. Tasks hand on one edge per node, never all pairs of a group.
Equal fingerprints are one node from the start.

Edge cases: null text is empty; without a word the fingerprint is zero and links
like any other; a null doc_id takes part, a component of null ids only has a null
id. Equal texts, repeated rows and texts that tie in a fingerprint are one node;
every row keeps a row of its own. Whole texts count, whatever their length; an
empty table gives no rows. Only doc_id and text are read, so extra columns of any
name do no harm. doc_ids are taken to be below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.lookups import fair_share, lookup
from rankloom.llm.work import id_text, table

SEED = 42
BUCKET = 4096  # fingerprints a bucket may hold on average
MOST = 200_000  # fingerprints of one bucket in one task
PER_TASK = 400_000  # rows of the trie join in one task, on average
PAIRS = 1 << 14  # node pairs worked on at a time
LEAF = 48  # a node pair of so many fingerprint pairs is compared outright
NO_ID = 1 << 62


def fingerprint(text: str, words: int = 4, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    k = min(words, len(w))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(w) - k] + 1).tolist()]
    h = np.array([xxh64_intdigest(flat[i:j], seed) for i, j in zip(first, last)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_text(df).mapInArrow(run, "doc_id long, fp long")


def block_masks(parts: int) -> list[int]:
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def choices(n: int, budget: int) -> list[tuple[int, ...]]:
    """Which parts go first in each pass: the fewest passes that keep buckets small for n fingerprints."""
    m = 1
    while n / 2 ** (64 * m / (budget + m)) > BUCKET and comb(budget + m + 1, m + 1) <= 500:
        m += 1
    return list(combinations(range(budget + m), m))


def permuted(fp: np.ndarray, masks: list[int], first: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The same bits with the chosen parts at the top, and how many bits those are."""
    out, used = np.zeros(len(fp), dtype=np.uint64), 64
    top = 0
    for k in [*first, *(i for i in range(len(masks)) if i not in first)]:
        width, low = masks[k].bit_count(), (masks[k] & -masks[k]).bit_length() - 1
        used -= width
        out |= ((fp & np.uint64(masks[k])) >> np.uint64(low)) << np.uint64(used)
        top += width if k in first else 0
    return out, top


class Joined:
    """Components over positions 0..n-1, smallest position first, updated in batches."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            if not (a != b).any():
                return
            low = np.minimum(a, b)
            np.minimum.at(self.of, a, low)
            np.minimum.at(self.of, b, low)
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up

    def changes(self) -> np.ndarray:
        """Running count of places where a position's component differs from the one before."""
        return np.r_[0, np.cumsum(self.of[1:] != self.of[:-1])]


def trie_components(value: np.ndarray, starts: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Component of each position, for distinct values sorted within the tries that begin at ``starts``.

    All values of one trie agree in the top ``depth`` bits.
    """
    n = len(value)
    joined = Joined(n)
    lo, hi = starts, np.r_[starts[1:], n]
    many = hi - lo > 1
    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), dtype=np.int64))]
    while stack:
        d, alo, ahi, blo, bhi, dist = stack.pop()
        if len(alo) > PAIRS:
            stack.append((d, *(x[PAIRS:] for x in (alo, ahi, blo, bhi, dist))))
            alo, ahi, blo, bhi, dist = (x[:PAIRS] for x in (alo, ahi, blo, bhi, dist))
        change, of = joined.changes(), joined.of
        known = (of[alo] == of[blo]) & (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo])
        keep = ~known
        alo, ahi, blo, bhi, dist = (x[keep] for x in (alo, ahi, blo, bhi, dist))
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= LEAF) if d < 64 else np.ones(len(size), dtype=bool)
        if leaf.any():
            la, lb, nb, count = alo[leaf], blo[leaf], (bhi - blo)[leaf], size[leaf]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = np.repeat(nb, count)
            i, j = np.repeat(la, count) + at // wide, np.repeat(lb, count) + at % wide
            near = (i < j) & (np.bitwise_count(value[i] ^ value[j]) <= budget)
            if near.any():
                joined.link(i[near], j[near])
        alo, ahi, blo, bhi, dist = (x[~leaf] for x in (alo, ahi, blo, bhi, dist))
        if not len(alo):
            continue
        amid, bmid = middle(value, alo, ahi, d), middle(value, blo, bhi, d)
        same = alo == blo
        kids = []
        for x0, x1, y0, y1, more, ok in (
            (alo, amid, bmid, bhi, 1, None),
            (amid, ahi, blo, bmid, 1, ~same),
            (alo, amid, blo, bmid, 0, None),
            (amid, ahi, bmid, bhi, 0, None),
        ):
            pick = (x1 > x0) & (y1 > y0) & (dist + more <= budget)
            pick &= ~((x0 == y0) & (x1 - x0 == 1))
            if ok is not None:
                pick &= ok
            kids.append((d + 1, x0[pick], x1[pick], y0[pick], y1[pick], dist[pick] + more))
        stack += [k for k in kids if len(k[1])]  # equal bits are popped first: they link most
    return joined.of


def middle(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First position of each range whose bit at this depth is set."""
    lo, hi = lo.copy(), hi.copy()
    bit = np.uint64(63 - depth)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        set_ = ((value[np.minimum(mid, len(value) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)
    return lo


def trie_edges(nodes: DataFrame, n: int, budget: int) -> DataFrame:
    """Edges (u, v) that span, pass by pass, the components of the distinct nodes (fp, node)."""
    passes = choices(n, budget)
    masks = block_masks(budget + len(passes[0]))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tops = [signed(sum(masks[k] for k in first)) for first in passes]
    dealt = nodes.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(t)).alias("bucket")) for c, t in enumerate(tops)])).alias("to")).select("fp", "node", "to.c", "to.bucket")
    large = table(dealt.groupBy("c", "bucket").count().where(F.col("count") > MOST).select("c", "bucket", F.ceil(F.col("count") / MOST).cast("int").alias("chunks")), "large-buckets")
    if large.take(1):
        cut = dealt.join(large, ["c", "bucket"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
        meets = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.least(x, "own") * F.col("chunks") + F.greatest(x, "own")))
        dealt = cut.select("fp", "node", "c", "bucket", F.explode(meets).alias("meet"))
    else:
        dealt = dealt.withColumn("meet", F.lit(0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        fp, node, c, bucket, meet = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(5))
        fp = fp.view(np.uint64)
        for k, first in enumerate(passes):
            at = np.flatnonzero(c == k)
            if len(at) < 2:
                continue
            value, depth = permuted(fp[at], masks, first)
            order = np.lexsort((value, bucket[at], meet[at]))
            at, value = at[order], value[order]
            starts = np.flatnonzero(np.r_[True, (bucket[at][1:] != bucket[at][:-1]) | (meet[at][1:] != meet[at][:-1])])
            of = trie_components(value, starts, depth, budget)
            hung = np.flatnonzero(of != np.arange(len(of)))
            if len(hung):
                yield pa.record_batch([pa.array(node[at[hung]]), pa.array(node[at[of[hung]]])], names=["u", "v"])

    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(passes) // PER_TASK)
    return dealt.select("fp", "node", "c", "bucket", "meet").repartition(tasks, "c", "bucket", "meet").mapInArrow(run, "u long, v long")


def groups(prints: DataFrame, budget: int = 4) -> DataFrame:
    """doc_id, fp, component (smallest id reachable; NO_ID or more: none has an id) for a stored table of (doc_id, fp)."""
    nodes = table(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.col("fp").bitwiseAND(F.lit(NO_ID - 1))).alias("node"), F.count("*").alias("n")), "fp-nodes")
    linked = components(trie_edges(nodes.select("fp", "node"), nodes.count(), budget))
    of_fp = table(nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "n"), "fp-components")
    return lookup(prints, of_fp, "fp", fair_share(prints.count(), prints), "inner").select("doc_id", "fp", "component")


def near_duplicates(df: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = groups(table(fingerprints(df, words), "fingerprints"), budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))
