"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch retains every 48-bit shingle hash below one fixed fraction of the hash
range, the same for all documents, so sketches of any two documents, however
unequal, can be compared and merged: what both retain is a fair sample of both.
With it goes a hash of the whole shingle set, by which equal sets are known to be
equal even where a short text's sample is small or empty.

A fingerprint is the exponent of the fraction, the whole set's hash (``-`` for a
merged sketch) and the retained hashes in hex: ``1.00..:0a1b...`` keeps a half.

Edge cases: null text is empty; without a word the shingle set is empty and alike
only to other empty ones (likeness 1); fewer than five words make one shingle;
unequal sets of which nothing is retained have likeness 0. Equal texts have equal
fingerprints. The order is by doc_id, null ids first, and by text where ids
repeat; a single document follows itself; an empty table gives no rows. Whole
texts count. Only doc_id and text are read, so extra columns of any name do no
harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.work import id_text

WORDS = 5
EXPONENT = 1  # half of all shingle hashes
RANGE = 48
EMPTY = 0
MEMO = 400_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
NULL_KEY = -(1 << 63)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of word hashes spread evenly."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Distinct shingle hashes of a text; a bounded memo supplies the hashes of repeated words."""

    def __init__(self, most: int = MEMO):
        import xxhash

        self.of_word = xxhash.xxh64_intdigest
        self.memo: dict[str, int] = {}
        self.most = most

    def word_hashes(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        found = list(map(self.memo.get, words))
        if None in found:
            new = {w: self.of_word(w.encode("utf-8")) for w, h in zip(words, found) if h is None}
            self.memo.update(new)
            found = [new[w] if h is None else h for w, h in zip(words, found)]
        return np.array(found, dtype=np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = self.word_hashes(words)
        n = max(1, len(h) - WORDS + 1)
        total = np.full(n, min(len(h), WORDS), dtype=np.uint64)
        for k in range(min(WORDS, len(h))):
            total += h[k : k + n] * ODD[k]
        return np.unique(mix(total) >> np.uint64(64 - RANGE))

    def sketch(self, text: str) -> Sketch:
        h = self.shingles(text)
        return Sketch(EXPONENT, below(h, EXPONENT), self.of_word(h.tobytes()) | 1 if len(h) else EMPTY)


class Sketch(NamedTuple):
    exponent: int
    hashes: np.ndarray  # retained, sorted
    whole: int | None  # of all shingles; EMPTY: there are none, None: not known


def below(h: np.ndarray, exponent: int) -> np.ndarray:
    return h[: np.searchsorted(h, np.uint64(1 << (RANGE - exponent)))]


def text_of(sketch: Sketch) -> str:
    exponent, h, whole = sketch
    raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex() if len(h) else ""
    return f"{exponent}.{'-' if whole is None else format(whole, '016x')}:{raw}"


def parse(fingerprint: str) -> Sketch:
    head, _, raw = fingerprint.partition(":")
    exponent, _, whole = head.partition(".")
    return Sketch(int(exponent), np.array([int(raw[i : i + 12], 16) for i in range(0, len(raw), 12)], dtype=np.uint64), None if whole == "-" else int(whole, 16))


def common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Hashes of a, of b and of both below the smaller threshold."""
    e = max(a.exponent, b.exponent)
    x, y = below(a.hashes, e), below(b.hashes, e)
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def same(a: Sketch, b: Sketch) -> bool:
    return a.whole is not None and a.whole == b.whole


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of common shingles among all of both, 0 to 1; equal sets give 1."""
    if same(a, b):
        return 1.0
    x, y, both = common(a, b)
    return both / (x + y - both) if x + y - both else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b holds, 0 to 1; the empty set is held by all."""
    if same(a, b) or a.whole == EMPTY:
        return 1.0
    x, _, both = common(a, b)
    return both / x if x else 0.0


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents' shingles together."""
    e = max(a.exponent, b.exponent)
    return Sketch(e, np.union1d(below(a.hashes, e), below(b.hashes, e)), a.whole if same(a, b) else None)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(df: DataFrame) -> DataFrame:
    """Texts dealt by doc_id ranges and sorted; each range also gets the first text of the range after it.

    Range bounds are doc_ids of the table itself, so they name the rows to copy:
    one per range, which keeps this at a single shuffle. Columns: key, last, text.
    """
    spark = df.sparkSession
    keyed = id_text(df).select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(parts)]
    found = keyed.agg(F.percentile_approx("key", shares, max(10_000, 20 * parts)).alias("at"), F.min("key").alias("least")).first()
    heads = sorted({found.least, *(found.at or [])} - {None}) or [0]
    bounds = np.array(heads[1:], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("boolean")
    def is_head(key: pd.Series) -> pd.Series:
        return pd.Series(np.isin(key.to_numpy(), np.array(heads, dtype=np.int64)))

    own = keyed.withColumns({"part": part_of("key"), "head": is_head("key")})
    before = F.pmod(F.col("part") - 1, F.lit(len(heads)))
    places = F.when(F.col("head"), F.array(F.struct("part", F.lit(False).alias("last")), F.struct(before.alias("part"), F.lit(True).alias("last")))).otherwise(F.array(F.struct("part", F.lit(False).alias("last"))))
    dealt = own.select("key", "text", F.explode(places).alias("to")).select("key", "text", "to.part", "to.last")
    return dealt.repartitionById(len(heads), F.col("part")).sortWithinPartitions("last", "key", "text").select("key", "last", "text")


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        held, ended = None, False
        out: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                for key, last, text in zip(*(c.to_pylist() for c in rows.columns)):
                    if ended:
                        continue
                    sketch = shingler.sketch(text)
                    if held is not None:
                        doc, before, own = held
                        new = edited(before, text)
                        changed = shingler.sketch(new)
                        out.append((None if doc == NULL_KEY else doc, len(before), hashlib.sha256(new.encode("utf-8")).hexdigest(), text_of(own), text_of(changed), likeness(own, changed), likeness(own, sketch)))
                    held, ended = (key, text, sketch), last
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out.clear()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df).mapInArrow(run, schema)
