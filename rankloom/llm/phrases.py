"""Phrase collocation mining: dictionary-encoded words, fixed-width n-gram keys, radix sort and run-length count.

Texts are cut at punctuation and line ends into pieces and those into words; a
phrase lies within one piece. Every count is exact and per language:

1. Words are counted. A phrase of ``least`` occurrences holds only words of as
   many, so the frequent words get ids by frequency (one dictionary for all
   languages: a word of another language is another id) and pieces break at every
   other word. The encoded runs are stored.
2. For 2, 3 and 4 words: every window of a run is a key of four 32-bit ids in two
   longs. A task radix-sorts its keys digit by digit and counts runs of equal
   ones, the counts are range-partitioned by key, and each range is radix-sorted
   and summed once more. A window is left out where one of its two shorter windows
   isn't frequent, told by a bitmap of at most ``MOST_BITS`` bits that never says
   no wrongly.
3. Frequent phrases are scored by their cuts, those that a longer candidate mostly
   explains go, and the first ``top`` of each language are ranked.

The dictionary is what tasks are sent, so it is bounded: ``MOST_WORDS`` words of at
most ``LONGEST`` bytes. Frequent words beyond it are counted just as exactly, by a
plain grouping of the phrases that hold at least one of them as text; this second
pass over the texts runs where there are such words.

Edge cases: null and empty texts have no words; a null language is ``und``; texts
and words of any length are handled whole; repeated rows count each time; a word
is any bytes but blanks, tabs and the separators, so other control characters and
white space beyond ASCII are parts of words; ties in score go by count and then by
the phrase's bytes; an empty table gives no rows; only lang and text are read, so
extra columns of any name do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.lookups import largest_counts
from rankloom.llm.sketches import mix
from rankloom.llm.work import drop, table

MOST_WORDS, LONGEST = 1 << 18, 64
MOST_BITS, BITS_A_PHRASE = 1 << 28, 16
SLAB = 1 << 22  # bytes of text worked on at a time
DISTINCT = 400_000  # words a task counts before it hands them on
WINDOWS = 1 << 22  # keys sorted at a time
PER_RANGE = 1 << 20  # counts of one range, on average
WORDS = 4  # of the longest phrase

# A-Z are lower-cased, a tab is a blank, marks and line ends separate pieces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def tokens(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words and ``\\n`` for every border of a piece, in lists of about SLAB bytes; may hold empty ones. Texts don't touch."""
    flat = b"\n".join(texts).translate(FOLD)
    start = 0
    while start < len(flat):
        end = flat.find(b" ", start + SLAB) if len(flat) - start > SLAB else len(flat)
        end = len(flat) if end < 0 else end
        yield flat[start:end].replace(b"\n", b" \n ").split(b" ")
        start = end + 1


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about SLAB bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] > SLAB or sum(size.values()) > 4 * SLAB:
                yield lang, held.pop(lang)
                del size[lang]
    yield from held.items()


def lang_text(df: DataFrame) -> DataFrame:
    return df.where(F.col("text").isNotNull()).select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def count_words(df: DataFrame) -> DataFrame:
    """lang, word, n, summed over all texts; a null word has the number of all words of its language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(b"", None)
                found.pop(b"\n", None)
                words, n = list(found), list(found.values())
                yield pa.record_batch([pa.array([lang] * (len(n) + 1), pa.string()), pa.array([*words, None], pa.binary()), pa.array([*n, sum(n)], pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for lang, texts in by_language(batches):
            for part in tokens(texts):
                counts.setdefault(lang, Counter()).update(part)
                if sum(map(len, counts.values())) > DISTINCT:
                    yield from flush()
        yield from flush()

    return lang_text(df).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Ids(dict):
    """word -> id; 0 for a border or a word without an id, -1 for the nothing between two blanks."""

    def __missing__(self, word: bytes) -> int:
        return 0


def encode(df: DataFrame, dictionary) -> DataFrame:
    """ids: runs of little-endian 32-bit word ids with a 0 between them; cut at zeros only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {lang: Ids([*zip(words, numbers), (b"", -1)]) for lang, (words, numbers) in dictionary.value.items()}
        for lang, texts in by_language(batches):
            if lang not in ids:
                continue
            get = ids[lang].__getitem__
            found = [np.fromiter(map(get, part), np.int32, len(part)) for part in tokens(texts)]
            x = np.concatenate(found) if found else np.zeros(0, np.int32)
            x = x[x >= 0]
            x = x[(x != 0) | np.r_[False, x[:-1] != 0]]
            yield pa.record_batch([pa.array([x.astype("<i4").tobytes()], pa.binary())], names=["ids"])

    return lang_text(df).mapInArrow(run, "ids binary")


def windows(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit keys, as two longs, of all windows of so many words that lie in one run."""
    last = len(ids) - words + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = [ids[i : i + last] for i in range(words)]
    whole = part[0] != 0
    for p in part[1:]:
        whole &= p != 0
    part = [p[whole].astype(np.int64) for p in part] + [np.zeros(int(whole.sum()), np.int64)] * (WORDS - words)
    return part[0] << 32 | part[1], part[2] << 32 | part[3]


def shorter(hi: np.ndarray, lo: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys without their last word, and without their first one."""
    low = np.int64(0xFFFFFFFF)
    return [(hi, lo & ~low if words == WORDS else lo * 0), ((hi & low) << 32 | lo >> 32, (lo & low) << 32)]


def spread(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi.view(np.uint64)) + lo.view(np.uint64))


def has(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(bits - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by the keys, the first one first: stable counting sorts of 16-bit digits, the last digit first; digits that all rows share are skipped."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> np.int64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each is there (or the sum of its n)."""
    if not len(hi):
        return hi, lo, np.zeros(0, np.int64)
    order = radix_order(hi, lo)
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    found = np.diff(np.r_[first, len(hi)]) if n is None else np.add.reduceat(n[order], first)
    return hi[first], lo[first], found.astype(np.int64)


def long_column(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def key_counts(runs: DataFrame, words: int, bitmap, bits: int) -> DataFrame:
    """hi, lo, n of every window, counted within a task's share; windows that hold no frequent shorter one are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found = run_lengths(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.record_batch([pa.array(x) for x in found], names=["hi", "lo", "n"])

        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), "<i4")
                for at in range(0, len(ids), WINDOWS // 4):  # a window belongs to the slice it starts in
                    hi, lo = windows(ids[at : at + WINDOWS // 4 + words - 1], words)
                    for side in (0, 1) if bits else ():
                        keep = has(bitmap.value, bits, spread(*shorter(hi, lo, words)[side]))
                        hi, lo = hi[keep], lo[keep]
                    held.append((hi, lo))
                    size += len(hi)
                    if size >= WINDOWS:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return runs.mapInArrow(run, "hi long, lo long, n long")


def sum_ranges(counts: DataFrame, rows: int, words: int, least: int, dictionary) -> DataFrame:
    """hi, lo, n, lang, phrase of every key found ``least`` times or more: ranges of keys, each sorted and summed in one task."""
    ranges = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PER_RANGE + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[long_column(b, i) for i in range(3)] for b in batches]
        if not held:
            return
        hi, lo, n = run_lengths(*(np.concatenate(x) for x in zip(*held)))
        hi, lo, n = (x[n >= least] for x in (hi, lo, n))
        if not len(hi):
            return
        word = {i: (lang, w) for lang, (ws, numbers) in dictionary.value.items() for w, i in zip(ws, numbers)}
        ids = np.stack([hi >> 32, hi & 0xFFFFFFFF, lo >> 32, lo & 0xFFFFFFFF][:words], axis=1)
        for i in range(0, len(hi), 1 << 16):
            found = [[word[x] for x in row] for row in ids[i : i + (1 << 16)].tolist()]
            phrases = [b" ".join(w for _, w in row) for row in found]
            yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in (hi, lo, n)] + [pa.array([row[0][0] for row in found], pa.string()), pa.array(phrases, pa.binary())], names=["hi", "lo", "n", "lang", "phrase"])

    dealt = counts.repartitionByRange(ranges, "hi", "lo")
    return dealt.mapInArrow(run, "hi long, lo long, n long, lang string, phrase binary").withColumn("phrase", F.col("phrase").cast("string"))


def bitmap_of(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of ``n`` values of the long ``hash``, MOST_BITS at most, and its size in bits."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_A_PHRASE * n):
        bits *= 2
    at = F.pmod("hash", F.lit(bits))
    parts = hashes.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(0x7FFF)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r.bucket << 12 : (r.bucket + 1) << 12] = np.frombuffer(r.m, np.uint8)
    return out, bits


def key_hashes(keys: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(spread(long_column(b, 0), long_column(b, 1)).view(np.int64))], names=["hash"])

    return keys.select("hi", "lo").mapInArrow(run, "hash long")


def text_counts(df: DataFrame, dictionary, rest, least: int) -> DataFrame:
    """lang, phrase, n of the phrases that hold a frequent word beyond the dictionary: windows of text, grouped as they are.

    ``rest`` is a broadcast (bitmap, bits) of such words; a word that is told to be one wrongly only makes a phrase that isn't frequent.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {lang: Ids(zip(words, numbers)) for lang, (words, numbers) in dictionary.value.items()}
        bitmap, bits = rest.value
        for lang, texts in by_language(batches):
            known, found = ids.get(lang, Ids()), Counter()
            kept: list[tuple[bytes, bool]] = []  # the last words of the run, and whether each is of the rest
            for part in tokens(texts):
                for w in part:
                    if not w:
                        continue
                    of_rest, h = w not in known, word_hash(w) & (bits - 1)
                    if w == b"\n" or of_rest and not bitmap[h >> 3] >> (h & 7) & 1:
                        kept = []
                        continue
                    kept = [*kept[-(WORDS - 1) :], (w, of_rest)]
                    for k in range(2, len(kept) + 1):
                        if any(x[1] for x in kept[-k:]):
                            found[b" ".join(x[0] for x in kept[-k:])] += 1
                if len(found) > DISTINCT:
                    yield phrase_batch(lang, found)
                    found = Counter()
            yield phrase_batch(lang, found)

    counted = lang_text(df).mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("lang", F.col("phrase").cast("string").alias("phrase"), "n")


def phrase_batch(lang: str, found: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "n"])


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 42)  # what Spark's xxhash64 gives for binary


def phrase_counts(df: DataFrame, least: int = 30, most_words: int = MOST_WORDS, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, n: every phrase of 1 to 4 words found ``least`` times or more in its language, and a null phrase with the number of all its words."""
    spark = df.sparkSession
    words = table(count_words(df).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    frequent = words.where(F.col("word").isNotNull())
    short = frequent.where(F.length("word") <= longest)
    chosen = sorted(((-r.n, r.lang, bytes(r.word)) for r in largest_counts(short, "n", most_words).collect()))  # most_words of at most ``longest`` bytes
    by_lang: dict[str, tuple[list[bytes], list[int]]] = {}
    for i, (_, lang, word) in enumerate(chosen, 1):
        of = by_lang.setdefault(lang, ([], []))
        of[0].append(word)
        of[1].append(i)
    dictionary = spark.sparkContext.broadcast(by_lang)
    of_words = words.select("lang", F.col("word").cast("string").alias("phrase"), F.when(F.col("word").isNotNull(), 1).alias("words"), "n")

    parts, runs = [of_words], table(encode(df, dictionary), "runs")
    bitmap, bits = spark.sparkContext.broadcast(np.zeros(0, np.uint8)), 0
    for k in range(2, WORDS + 1):
        counts = table(key_counts(runs, k, bitmap, bits), f"keys{k}")
        found = table(sum_ranges(counts, counts.count(), k, least, dictionary), f"phrases{k}")
        drop(counts)
        parts.append(found.select("lang", "phrase", F.lit(k).alias("words"), "n"))
        n = found.count()
        if k < WORDS:
            now, bits = bitmap_of(key_hashes(found), n)
            bitmap = spark.sparkContext.broadcast(now)
    drop(runs)

    n_rest = frequent.count() - len(chosen)
    if n_rest:
        known = largest_counts(short, "n", most_words).select("lang", "word")
        rest = spark.sparkContext.broadcast(bitmap_of(frequent.join(known, ["lang", "word"], "left_anti").select(F.xxhash64("word").alias("hash")), n_rest))
        more = table(text_counts(df, dictionary, rest, least), "rest")
        parts.append(more.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def whole(c: str) -> Column:
    return F.col(c).cast("decimal(25,0)")


def score_by_cuts(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more: its lowest-scoring cut, the earliest of equals.

    score is floor(2000000 a / (l + r)), in decimals, so no product overflows.
    """
    candidates = counts.where(F.col("words") >= 2)
    split = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"), split.alias("w"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("part")), F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("part")))
    parts = cuts.select("lang", "phrase", "words", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "words", "a", "cut", "s.side", "s.part")
    found = parts.join(counts.where(F.col("phrase").isNotNull()).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    at = lambda cut, side: F.sum(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f"))).alias(f"f{cut}{side}")
    wide = found.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), *(at(c, s) for c in range(1, WORDS) for s in (0, 1)))
    scored = [F.when(F.col(f"f{c}0").isNotNull(), F.struct(F.expr(f"(cast(a AS decimal(25,0)) * 2000000) div (cast(f{c}0 AS decimal(25,0)) + cast(f{c}1 AS decimal(25,0)))").alias("score"), F.lit(c).alias("cut"), F.col(f"f{c}0").alias("l"), F.col(f"f{c}1").alias("r"))) for c in range(1, WORDS)]
    return wide.withColumn("best", F.least(*scored)).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def unexplained(scored: DataFrame, share: int = 80) -> DataFrame:
    """Without the phrases that lie in a longer one found at least ``share`` per cent as often."""
    longer = scored.where(F.col("words") >= 3).select("lang", "a", "words", F.split("phrase", " ").alias("w"))
    inside = longer.select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k")).select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("at"))
    most = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * share)).drop("longer")


def first_of_each(scored: DataFrame, top: int) -> DataFrame:
    """With rank, the first ``top`` of each language by score, count and phrase: of each share first, then of what is left."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_n") <= top).drop("_n", "_share")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(df: DataFrame, least: int = 30, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 4 words."""
    counts = phrase_counts(df, least, **options)
    ranked = first_of_each(unexplained(table(score_by_cuts(counts), "scored")), top)
    totals = counts.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents WHERE text IS NOT NULL),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     q AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
     g AS (SELECT lang, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS words
           FROM q, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
     f AS (SELECT lang, k, array_to_string(words, ' ') AS phrase, count(*) AS n FROM g GROUP BY ALL),
     total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 30),
     cut AS (SELECT c.*, unnest(range(1, k)) AS j FROM c),
     scored AS (SELECT cut.lang, cut.phrase, cut.k, a, j, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score
                FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:j], ' ')
                         JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
     best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
     part AS (SELECT lang, a, w, k, unnest(range(2, k)) AS j FROM c),
     inner_ AS (SELECT lang, a, array_to_string(w[s:s + j - 1], ' ') AS phrase
                FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM part)),
     longer AS (SELECT lang, phrase, max(a) AS b FROM inner_ GROUP BY ALL),
     kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase)
              WHERE place = 1 AND (b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
