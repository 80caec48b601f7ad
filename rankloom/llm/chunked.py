"""Whole-text encoding with the tokenizers library, one white-space-bounded chunk at a time.

Two families of tokenizer files never let a token cross the place between a
visible character and white space: byte-level BPE (its pattern always breaks
there) and word BPE that drops white space. For these the library encodes each
distinct chunk once per worker and a bounded memo supplies the repeats. Distinct
words of letters alone are encoded many to a text and told apart by the tokens
that end a word. Any other file, and texts holding separators that count as white space to Python
only, go to the library whole. Literal special tokens in a text are split off
first, as the library does.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from rankloom.llm.memo import PieceMemo

MEMO = 1_200_000  # chunks a worker remembers, in two generations
UNIT = 1 << 20  # characters worked on at a time
TOGETHER = 200  # words encoded as one text
# Fixed value: the pattern of word BPE files whose words may be cut before marks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkEncoder:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, words)) + ")").split if words else None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        kinds = [x["type"] for x in pre.get("pretokenizers", [pre])]
        self.chunks = None
        if kinds == ["ByteLevel"] and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.chunks = re.compile(r"\s*\S+|\s+").findall
        elif kinds == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert") and {x["type"] for x in (norm or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
            self.chunks = str.split
        steps = {x["type"] for x in (norm or {}).get("normalizers", [])}
        self.fold = self.chunks is str.split and "Lowercase" in steps and pre["pretokenizers"][0]["pattern"] == {"Regex": WORDS}
        suffix = spec["model"].get("end_of_word_suffix") if self.fold else None
        self.ends_word = np.array([bool(suffix) and (self.tok.id_to_token(i) or "").endswith(suffix or "") for i in range(max(self.tok.get_vocab().values()) + 1)])
        self.odd = re.compile("[\x1c-\x1f]").search
        self.memo = PieceMemo(self._encode_chunks, memo)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        where: list[list[bytes]] = []
        lists: list[list[str]] = []
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
                    to.append(pack([self.special[part]]))
                elif self.chunks is None or self.odd(part):
                    flush()
                    to.append(pack(self.tok.encode(part, add_special_tokens=False).ids))
                else:
                    for unit in units(part):
                        where.append(to)
                        lists.append(self.chunks(folded(unit) if self.fold else unit))
                        size += len(unit)
                        if size > UNIT:
                            flush()
                            size = 0
        flush()
        return [b"".join(x) for x in out]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if not self.ends_word.any():
            return self._each(chunks)
        words, others = [c for c in chunks if c.isalpha()], [c for c in chunks if not c.isalpha()]
        found = dict(zip(words, self._together(words))) | dict(zip(others, self._each(others)))
        return [found[c] for c in chunks]

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [pack(e.ids) for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Each has at least one token that ends a word, so if there are as many of these as words, each has one."""
        texts = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.fromiter((i for e in self.tok.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids), dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            return self._each(words)
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]


#: Latin-1 bytes by kind: 0 letters and digits, 1 blanks, 2 marks, 4 anything whose case or composition needs care.
KIND = np.full(256, 4, dtype=np.uint8)
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xDF), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 0
KIND[[9, 10, 11, 12, 13, 32]] = 1
KIND[[b for b in range(0x21, 0x7F) if KIND[b] == 4]] = 2
LOWER = np.frombuffer("".join(map(chr, range(256))).lower().encode("latin-1"), dtype=np.uint8)


def folded(text: str) -> str:
    """The same tokens from fewer distinct chunks: lower case, and marks set apart from the letter or digit before them, where the pattern always breaks."""
    try:
        raw = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        return text
    kind = KIND[raw]
    if not len(kind) or kind.max() == 4:
        return text
    at = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 0)) + 1
    return np.insert(LOWER[raw], at, 32).tobytes().decode("latin-1")


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def units(text: str, size: int = UNIT):
    """Parts of about ``size`` characters that end between a visible ASCII character and a blank."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and not (text[at] in " \n" and "!" <= text[at - 1] <= "~"):
            at += 1
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


_loaded: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]
