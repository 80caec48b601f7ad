"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

Both tokenizers' tokens of a text are nodes of a bipartite graph, with an edge
where their byte ranges overlap. Its connected components, found by union-find, are
the smallest groups whose two sides cover the same bytes: they are cut exactly where
tokens of both end. The members of each component whose ranges end together are the
links, and id pairs are counted over the links of all documents.

Tasks align many documents at a time, since documents whose two sides spell the same
bytes can be laid end to end. Every document keeps its distinct id pairs, so counting
and looking the counts up again read small stored tables, not texts. Pairs are summed
within a task before they are shuffled. Counts come back by a broadcast of the
``MOST_PAIRS`` most frequent pairs; all others, if there are any, by a join. Best
counts are one for each id of the second vocabulary.

Edge cases: texts that are null, empty, or that either tokenizer doesn't spell byte
for byte (after the space that stands before each text) have no tokens: all numbers are
0 and ``groups_sha256`` is ''. Special tokens' strings are plain text. Texts of any length
are handled whole; repeated rows and null ids keep a row each; ties for the best count
all count; an empty table gives no rows. Only the id and the text are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.bpe import SLAB, ForcedBoundaryBPE, slabs
from rankloom.llm.chunked import pack
from rankloom.llm.lookups import largest_counts
from rankloom.llm.memo import PieceMemo
from rankloom.llm.work import id_text, table

MEMO = 300_000  # pieces of text a worker remembers for each tokenizer
UNIT = 1 << 21  # characters aligned at a time
ITEMS = 1 << 20  # tokens written out at a time
MOST_PAIRS = 1 << 20  # id pairs that tasks are sent
PAIRS = 1 << 21  # pairs a task sums at a time


class BytePairs:
    """A byte-level BPE file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.codec = ForcedBoundaryBPE(path, MEMO)
        self.codec.special_split = None
        self.token_bytes = self.codec.token_bytes

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.codec.encode_many(texts)]


class Pieces:
    """A SentencePiece model that puts a space before each text, which the texts given here already have.

    No piece holds a space after another character, or a line end beside one, so
    texts are cut there and a bounded memo supplies the repeats. Other models get texts whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        probe = "ａ ﬁ  x\t"
        kept = b"".join(self.token_bytes[i] for i in self.sp.encode(probe)) == (" " + probe).encode()
        self.blank = self.sp.piece_to_id("▁")  # the library gives no id for the space before nothing
        self.cut = kept and not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        self.chunks = re.compile(r"(?: +|\n)[^ \n]*").findall
        self.memo = PieceMemo(self._encode_chunks, MEMO)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        found = self.sp.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [pack([self.blank] if c == " " else ids if c[0] == " " else ids[1:]) for c, ids in zip(chunks, found)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            return [np.array(self.sp.encode(t[1:]), dtype="<u4") for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        where: list[list[bytes]] = []
        lists: list[list[str]] = []
        size = 0

        def flush() -> None:
            for to, ids in zip(where, self.memo.join(lists)):
                to.append(ids)
            where.clear()
            lists.clear()

        for to, t in zip(out, texts):
            for slab in slabs(t):
                where.append(to)
                lists.append(self.chunks(slab))
                size += len(slab)
                if size > SLAB:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(x), "<u4") for x in out]


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by union-find: all roots that an edge joins are hooked at once, then all paths are cut short."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further


@dataclass
class Aligned:
    """Tokens of documents laid end to end: group of each token (numbered in order), and the tokens of each link."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """From the tokens' sizes in bytes, whose sums are equal; no token is empty."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    of_b = np.searchsorted(end_a, end_b)  # the token of a in which each token of b ends
    both = end_a[of_b] == end_b
    ends_a, ends_b = np.ones(len(end_a) + int((~both).sum()), dtype=bool), np.zeros(len(end_a) + int((~both).sum()), dtype=bool)
    alone = of_b[~both] + np.arange(int((~both).sum()))  # all ends in order: those of a, with those that only b has in between
    ends_a[alone], ends_b[alone] = False, True
    ends_b[np.flatnonzero(ends_a)[of_b[both]]] = True
    i, j = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # between two ends one token of each side overlap
    root = components(len(end_a) + len(end_b), i, j + len(end_a))
    first = root[: len(end_a)] == np.arange(len(end_a))  # every component has a token of a, and its smallest node is its first one
    number = np.cumsum(first) - 1
    group_a, group_b = number[root[: len(end_a)]], number[root[len(end_a) :]]
    together = ends_a & ends_b
    return Aligned(group_a, group_b, i[together], j[together])


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePairs(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.token_bytes], dtype=np.int64) for t in (self.a, self.b))
        self.written = [b"%d%c" % (i, end) for sizes, ends in ((self.size_a, b",|"), (self.size_b, b",;")) for i in range(len(sizes)) for end in ends]

    def run(self, texts: list[str | None], groups: bool) -> list[tuple]:
        """For each text (n_a, n_b, n_groups, n_links, groups_sha256, groups, keys, times); see :func:`align_documents`."""
        spaced = [" " + t for t in texts if t]
        ids_a, ids_b = self.a.encode_many(spaced), self.b.encode_many(spaced)
        # byte-level tokens are cuts of the text's bytes; pieces may spell another text
        fine = [spelled(b, self.b.token_bytes, t.encode("utf-8", "replace")) and int(self.size_a[a].sum()) == int(self.size_b[b].sum()) for t, a, b in zip(spaced, ids_a, ids_b)]
        ids_a, ids_b = ([x for x, ok in zip(ids, fine) if ok] for ids in (ids_a, ids_b))
        found = iter(self.aligned(ids_a, ids_b, groups) if ids_a else ())
        fine = iter(fine)
        none = (0, 0, 0, 0, "", "" if groups else None, b"", b"")
        return [next(found) if t and next(fine) else none for t in texts]

    def aligned(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], groups: bool) -> Iterator[tuple]:
        a, b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        x = align(self.size_a[a], self.size_b[b])
        at_a, at_b = (np.cumsum([0, *map(len, ids)]) for ids in (ids_a, ids_b))
        at_link = np.searchsorted(x.link_a, at_a)
        key = a[x.link_a] << 32 | b[x.link_b]
        n_a, n_b = np.bincount(x.group_a), np.bincount(x.group_b)
        place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[x.group_a]
        place_b = np.arange(len(b)) + np.cumsum(n_a)[x.group_b]
        items = np.empty(len(a) + len(b), dtype=np.int64)
        items[place_a] = 2 * a + np.r_[x.group_a[1:] != x.group_a[:-1], True]
        items[place_b] = 2 * (b + len(self.size_a)) + np.r_[x.group_b[1:] != x.group_b[:-1], True]
        for d in range(len(ids_a)):
            digest, text = hashlib.sha256(), []
            for part in self.write(items[at_a[d] + at_b[d] : at_a[d + 1] + at_b[d + 1]]):
                digest.update(part)
                if groups:
                    text.append(part)
            keys, times = np.unique(key[at_link[d] : at_link[d + 1]], return_counts=True)
            n_groups = int(x.group_a[at_a[d + 1] - 1] - x.group_a[at_a[d]]) + 1
            yield (len(ids_a[d]), len(ids_b[d]), n_groups, int(at_link[d + 1] - at_link[d]), digest.hexdigest(), b"".join(text).decode() if groups else None, np.diff(keys, prepend=0).astype("<i8").tobytes(), times.astype("<u4").tobytes())

    def write(self, items: np.ndarray) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` in parts."""
        for i in range(0, len(items), ITEMS):
            part = b"".join(map(self.written.__getitem__, items[i : i + ITEMS].tolist()))
            yield part if i + ITEMS < len(items) else part[:-1]


def spelled(ids: np.ndarray, token_bytes: list[bytes], raw: bytes) -> bool:
    """Whether the tokens' bytes, one after the other, are ``raw``."""
    at = 0
    for i in range(0, len(ids), ITEMS):
        part = b"".join(map(token_bytes.__getitem__, ids[i : i + ITEMS].tolist()))
        if raw[at : at + len(part)] != part:
            return False
        at += len(part)
    return at == len(raw)


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def align_documents(df: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (``a1,a2|b1;a3|b2,b3`` where asked for), and the distinct id pairs of the links.

    ``row`` tells rows apart. ``keys`` holds a << 32 | b of the pairs in order, each less the one before, and ``times`` how many links have each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in units(batch):
                found = list(zip(*both.run(part.column(1).to_pylist(), groups)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()] * 2
                columns = [pa.array(np.arange(row, row + part.num_rows)), part.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))]
                row += part.num_rows
                yield pa.record_batch(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "keys", "times"])

    out = id_text(df).mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, keys binary, times binary")
    return out if groups else out.drop("groups")


def units(batch: pa.RecordBatch, size: int = UNIT) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, a row at least."""
    start, total = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        total += n
        if total >= size:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def stored_pairs(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(keys, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key, a, b, n: how many links of all documents hold each id pair."""

    def summed(held: list) -> pa.RecordBatch:
        key, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return pa.record_batch([pa.array(key[first]), pa.array(np.add.reduceat(n, first))], names=["key", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if keys:
                    held.append(stored_pairs(keys, times))
                    size += len(held[-1][0])
                if size >= PAIRS:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    counted = aligned.select("keys", "times").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.select("key", F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n")


def link_sums(aligned: DataFrame, pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """row, doc_id, ..., n_best, count_sum: the documents with what the counts of their links' pairs say."""
    spark = aligned.sparkSession
    best = pairs.groupBy("b").agg(F.max("n").alias("best"))  # a row for each id of the second vocabulary
    marked = table(pairs.join(F.broadcast(best), "b").select("key", "n", (F.col("n") == F.col("best")).alias("best")), "pairs")
    common = largest_counts(marked, "n", most_pairs)
    held = common.select("key", "n", "best").toArrow().sort_by("key")  # most_pairs rows at most
    sent = spark.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("key", "n", "best")))
    others = marked.count() - held.num_rows

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row of the batch, key, times, place among the sent pairs and whether it is there, of all pairs of a batch of (keys, times)."""
        found = [stored_pairs(k, t) for k, t in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist())]
        key, times = (np.concatenate(x) for x in zip(*found))
        row, top = np.repeat(np.arange(len(found)), [len(k) for k, _ in found]), sent.value[0]
        place = np.minimum(np.searchsorted(top, key), max(len(top) - 1, 0))
        return row, key, times, place, top[place] == key if len(top) else np.zeros(len(key), bool)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = sent.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                row, _, times, place, there = of(batch)
                total = np.zeros((2, batch.num_rows), np.int64)
                np.add.at(total[0], row[there], times[there] * best[place[there]])
                np.add.at(total[1], row[there], times[there] * n[place[there]])
                yield pa.record_batch([batch.column(c) for c in kept] + [pa.array(x) for x in total], names=[*kept, "n_best", "count_sum"])

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                row, key, times, _, there = of(batch)
                yield pa.record_batch([pa.array(batch.column("row").to_numpy()[row[~there]]), pa.array(key[~there]), pa.array(times[~there])], names=["row", "key", "times"])

    kept = [c for c in aligned.columns if c not in ("keys", "times")]
    kinds = dict(aligned.dtypes)
    out = aligned.mapInArrow(sums, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best long, count_sum long")
    if not others:
        return out
    rare = marked.join(common.select("key"), "key", "left_anti")
    more = aligned.select("row", "keys", "times").mapInArrow(rest, "row long, key long, times long").join(rare, "key")
    more = more.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_b"), F.sum(F.col("times") * F.col("n")).alias("_n"))
    whole = out.join(more, "row", "left")
    return whole.select(*kept, (F.col("n_best") + F.coalesce("_b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_n", F.lit(0))).alias("count_sum"))


def alignment_report(df: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    aligned = table(align_documents(df, path_a, path_b), "aligned")
    found = link_sums(aligned, pair_counts(aligned), most_pairs)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
