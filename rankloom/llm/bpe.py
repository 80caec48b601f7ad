"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up inside one
output token, so a cut between its two bytes is certain. Texts are cut at such
pairs first, fragments are encoded independently of each other and the ids are
concatenated. Fragments repeat heavily, so each worker keeps a bounded memo.

A fragment's own pre-tokens come from the byte-level splitting pattern. A cut is
taken on the whole text only where that pattern breaks as well (a visible byte
before white space, a letter before a mark) or can't be affected (between two
ASCII letters); all other forced pairs are cut inside the pre-tokens. White space
beyond ASCII isn't visible: no cut is taken after it.

Edge cases: a null or empty text has no ids and decodes to the empty text. A
literal special token in a text becomes its id, as the tokenizer's own default
does. Texts of any length are handled whole; equal texts get equal results;
repeated rows stay repeated; a null id stays null; an empty table gives no rows.
Only the id and the text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.memo import PieceMemo
from rankloom.llm.work import id_text

# The byte-level pre-tokeniser's pattern; white space is spelled out.
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

SLAB = 1 << 20  # characters of one text worked on at a time
MEMO = 400_000  # fragments a worker remembers, in two generations
NEVER = np.iinfo(np.int64).max
WIDE_BLANKS = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, by the rule of byte-level BPE vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        inside = np.zeros(65536, dtype=bool)
        ids = {}
        for token, i in vocab.items():
            if token in special:
                continue
            raw = bytes(alphabet[c] for c in token)
            self.token_bytes[i], ids[raw] = raw, i
            for a, b in zip(raw, raw[1:]):
                inside[a << 8 | b] = True
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = (bytes(alphabet[c] for c in x) for x in (left, right))
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])

        self.forced = ~inside
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        letter = np.zeros(256, dtype=bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        mark = np.zeros(256, dtype=bool)
        mark[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"]] = True
        stop = np.zeros(256, dtype=bool)
        stop[[ord(","), ord(".")]] = True
        high = np.arange(256) >= 128
        safe = (~space[:, None] & space[None, :]) | (letter[:, None] & (letter | mark)[None, :]) | (high[:, None] & stop[None, :])
        self.cut_here = self.forced & safe.reshape(-1)
        # a mark after white space beyond ASCII: the pattern looks ahead there, so that place is no certain cut
        blank = np.zeros(256, dtype=bool)
        blank[[c.encode()[-1] for c in WIDE_BLANKS]] = True
        self.doubt = (blank[:, None] & stop[None, :]).reshape(-1)
        self.before_blank = np.zeros(256, dtype=bool)
        self.before_blank[[c.encode()[-2] for c in WIDE_BLANKS]] = True
        self.split = regex.compile(PATTERN).findall
        self.letter = letter
        self.latin = np.zeros(256, dtype=bool)  # second bytes of Latin-1 letters
        self.latin[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        order = sorted(self.merge.items(), key=lambda m: m[0][0] << 32 | m[0][1])
        self.pair = np.array([a << 32 | b for (a, b), _ in order] + [1 << 62], dtype=np.int64)
        self.rank = np.array([m[0] for _, m in order] + [NEVER], dtype=np.int64)
        self.made = np.array([m[1] for _, m in order] + [0], dtype=np.int64)
        self.of_byte = np.array(self.byte_id, dtype=np.int64)
        self.memo = PieceMemo(self._encode_fragments, memo)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        where: list[list[bytes]] = []
        lists: list[list[bytes]] = []
        size = 0

        def flush() -> None:
            for to, ids in zip(where, self.memo.join(lists)):
                to.append(ids)
            where.clear()
            lists.clear()

        for to, text in zip(out, texts):
            parts = self.special_split(text) if self.special_split and any(s in text for s in self.special) else [text]
            for i, part in enumerate(parts):
                if i % 2:
                    flush()
                    to.append(self.special[part].to_bytes(4, "little"))
                    continue
                for slab in slabs(part):
                    where.append(to)
                    lists.append(self.fragments(slab.encode("utf-8", "replace")))
                    size += len(slab)
                    if size > SLAB:
                        flush()
                        size = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def fragments(self, raw: bytes) -> list[bytes]:
        """The text's bytes cut at every forced pair that the splitting pattern can't be affected by."""
        if len(raw) < 2:
            return [raw] if raw else []
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint16)
        pair = (b[:-1] << 8) | b[1:]
        at = np.flatnonzero(self.cut_here[pair])
        doubt = self.doubt[pair[at]]
        if doubt.any():
            at = at[~(doubt & self.before_blank[b[at - 1]])]
        # a byte that UTF-8 doesn't have stands at each cut
        parted = np.full(len(raw) + len(at), 255, dtype=np.uint8)
        own = np.ones(len(parted), dtype=bool)
        own[at + np.arange(1, len(at) + 1)] = False
        parted[own] = b
        return parted.tobytes().split(b"\xff")

    def _plain(self, byte: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which fragments are letters of ASCII or Latin-1 after at most one space, so one pre-token."""
        after, before = np.r_[byte[1:], np.uint8(0)], np.r_[np.uint8(0), byte[:-1]]
        wide = (byte == 0xC3) & self.latin[after]
        odd = ~(self.letter[byte] | wide | ((before == 0xC3) & self.latin[byte]))
        width = np.diff(np.r_[first, len(byte)])
        odd[first[(byte[first] == 32) & (width > 1)]] = False
        return ~np.logical_or.reduceat(odd, first)

    def _encode_fragments(self, fragments: list[bytes]) -> list[bytes]:
        """Cut the fragments' pre-tokens again at all forced pairs and merge every piece side by side.

        In each round every piece applies its lowest-ranked pair; only pairs
        beside a merge are looked up anew. Finished pieces leave the arrays.
        """
        if not fragments:
            return []
        raw = b"".join(fragments)
        sizes = list(map(len, fragments))
        byte = np.frombuffer(raw, dtype=np.uint8)
        first = np.cumsum([0, *sizes[:-1]])
        starts = np.zeros(len(raw), dtype=bool)
        starts[first] = True
        odd = np.flatnonzero(~self._plain(byte, first))
        for i, start in zip(odd.tolist(), first[odd].tolist()):
            tokens = [len(t.encode("utf-8")) for t in self.split(fragments[i].decode("utf-8"))]
            starts[list(accumulate(tokens[:-1], initial=start))] = True
        pair16 = (byte[:-1].astype(np.uint16) << 8) | byte[1:]
        starts[1:] |= self.forced[pair16]

        done_at, done_ids = [], []
        first = np.flatnonzero(starts)
        width = np.diff(np.r_[first, len(raw)])
        long = width > 256
        for i, w in zip(first[long].tolist(), width[long].tolist()):
            ids = self._merge_long([self.byte_id[x] for x in raw[i : i + w]])
            done_ids.append(np.array(ids, dtype=np.int64))
            done_at.append(np.full(len(ids), i))
        keep = ~np.repeat(long, width)
        at = np.arange(len(raw))[keep]
        ids, starts = self.of_byte[byte[keep]], starts[keep]
        slot = self._slots(ids)
        while len(ids):
            first = np.flatnonzero(starts)
            width = np.diff(np.r_[first, len(ids)])
            slot[first[1:] - 1] = slot[-1] = len(self.pair) - 1  # the last of a piece has no right neighbour
            rank = self.rank[slot]
            lowest = np.minimum.reduceat(rank, first)
            done = np.repeat(lowest == NEVER, width)
            done_at.append(at[done])
            done_ids.append(ids[done])
            take = (rank == np.repeat(lowest, width)) & ~done
            if (take[1:] & take[:-1]).any():  # a pair of equal ids overlaps itself: every second one of a run, from the left
                pos = np.arange(len(take))
                begin = np.maximum.accumulate(np.where(take & ~np.r_[False, take[:-1]], pos, 0))
                take &= (pos - begin) % 2 == 0
            ids[take] = self.made[slot[take]]
            stale = take | np.r_[take[1:], False]
            keep = ~(np.r_[False, take[:-1]] | done)
            ids, at, starts, slot, stale = ids[keep], at[keep], starts[keep], slot[keep], stale[keep]
            where = np.flatnonzero(stale)
            if len(where):
                slot[where] = self._slots(ids, where)
        at, ids = np.concatenate(done_at), np.concatenate(done_ids)
        order = np.argsort(at, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = (4 * np.searchsorted(at[order], np.cumsum(sizes))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def _slots(self, ids: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """Where the pairs of ids[where] and their right neighbours stand in the merge table (its end: nowhere)."""
        where = np.arange(len(ids)) if where is None else where
        key = (ids[where] << 32) | ids[np.minimum(where + 1, len(ids) - 1)]
        slot = np.searchsorted(self.pair, key)
        slot[self.pair[slot] != key] = len(self.pair) - 1
        return slot

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, lowest rank and then leftmost first, over a linked list with a heap."""
        n, alive = len(ids), [True] * len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, ok in zip(ids, alive) if ok]


def slabs(text: str, size: int = SLAB) -> Iterator[str]:
    """Parts of about ``size`` characters; each ends between a visible ASCII byte and a blank, a certain cut."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and not (text[at] in " \n" and "!" <= text[at - 1] <= "~"):
            at += 1
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


_loaded: dict[str, ForcedBoundaryBPE] = {}


def codec(path: str) -> ForcedBoundaryBPE:
    """One codec per worker process and file."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def encode_documents(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (packed little-endian uint32), n_tokens for every row; partitions are streamed, nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            for part in small(batch):
                ids = bpe.encode_many(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return id_text(df).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def round_trip_digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and the digest of the text decoded from the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            for part in small(batch):
                n, of_ids, of_text = [], [], []
                for ids in bpe.encode_many(part.column(1).to_pylist()):
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
