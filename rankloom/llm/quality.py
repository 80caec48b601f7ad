"""Quality rules: base counts and divergence from language references, in DataFrame operations only.

A document's shares of character classes and of common words are compared with
those of each language by Jensen-Shannon distance (base 2, 0 to 1); its nearest
language counts, so a wrong or missing label does no harm. The references are
fitted on all documents of the table, one pass, and are a few dozen numbers a
language whatever the table's size. Short documents say little about their
distribution: classes are judged from ``LEAST_CHARS`` visible characters on,
words from ``LEAST_WORDS`` words on. Documents in a language without a word list
are not judged by words, nor is anything if no reference could be fitted.

Edge cases: null and empty texts have no words and fail the base rule. Whole
texts are counted; repeated rows are repeated; an empty table gives no rows.
Documents that tie with a limit are kept. Extra columns of any name are kept by
:func:`keep` and not read by :func:`report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The commonest function words of each language.
COMMON = {
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als".split(),
    "en": "the of and to a in is that it for was on with as be by are this at from".split(),
    "es": "de la que el en y los las se del un por con no una su para es al lo".split(),
    "fr": "de la le et les en des un du une que est pour par dans avec qui pas sur au".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
BLANK = r"[\x20\x09-\x0D]+"
#: Removed one after the other, so each class counts what the earlier ones left; the rest is the last class.
CLASSES = (("lower", "[a-z]+"), ("blank", BLANK), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("stop", r"[.,;:!?'\"()\-]+"), ("symbol", "[#*$%&|<>]+"))
NAMES = (*(name for name, _ in CLASSES), "rest")
LEAST_CHARS, LEAST_WORDS = 60, 100
CLASS_DISTANCE, WORD_DISTANCE = 0.25, 0.32
FLOOR = 1e-6  # a word unseen in a language counts as this rare


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's argument is never computed again."""
    return F.transform(F.array(value), use)[0]


def with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.array_remove(F.split("text", BLANK), ""))


def with_classes(df: DataFrame) -> DataFrame:
    """How many characters of each class; the long runs go first, the later patterns see what is left."""
    left = F.col("text")
    for name, pattern in CLASSES:
        rest = f"after_{name}"
        df = df.withColumn(rest, F.regexp_replace(left, pattern, ""))
        df = df.withColumn(f"n_{name}", (F.length(left) - F.length(rest)).cast("long"))
        left = F.col(rest)
    return df.withColumn("n_rest", F.length(left).cast("long")).drop(*(f"after_{name}" for name, _ in CLASSES))


def common_words(words: Column) -> Column:
    return F.transform(F.filter(words, lambda w: F.lower(w).isin(WORDS)), F.lower)


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Windows are told apart by a hash of their words' hashes. They are sorted with
    their positions, so equal ones are neighbours, and neighbours of equal hashes
    are compared word by word; the sorted positions of those found then cover
    five words each, less their overlap.
    """
    none = F.lit(0).cast("long")
    five = lambda x: F.slice(words, x["i"] + 1, 5)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.size(h) - 4), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, 5))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5))))
        return F.aggregate(steps, none, lambda a, x: a + x)

    def positions(s: Column) -> Column:
        equal = lambda x, y: x["w"].eqNullSafe(y["w"]) & (five(x) == five(y))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: equal(x, F.get(s, k - 1)) | equal(x, F.get(s, k + 1))), lambda x: x["i"]))

    def counted(w: Column) -> Column:
        listed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        # without two equal hashes there are no equal windows, and most texts need no more than that
        return F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(let(let(listed, positions), covered))

    return F.when(F.size(words) < 5, none).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted))


def references(df: DataFrame) -> dict[str, tuple[dict[str, float], dict[str, float]]]:
    """Shares of character classes and of common words (and other words, '') for each language of COMMON."""
    known = with_classes(with_words(df.where(F.col("lang").isin(sorted(COMMON)))))
    counts = [F.struct(F.lit(f"#{n}").alias("key"), F.col(f"n_{n}").alias("n")) for n in NAMES]
    counts.append(F.struct(F.lit("#words").alias("key"), F.size("words").cast("long").alias("n")))
    listed = F.transform(common_words(F.col("words")), lambda w: F.struct(w.alias("key"), F.lit(1).cast("long").alias("n")))
    # a row a class and common word of each document, but at most one a language and key leaves each task
    sums = known.select("lang", F.explode(F.concat(F.array(*counts), listed)).alias("c")).groupBy("lang", "c.key").agg(F.sum("c.n").alias("n"))
    seen: dict[str, dict[str, int]] = {}
    for r in sums.collect():  # languages x (classes and common words)
        seen.setdefault(r.lang, {})[r.key] = r.n
    out = {}
    for lang, n in seen.items():
        total, words = sum(n[f"#{x}"] for x in NAMES), n["#words"]
        if total and words:
            share = {w: max(n.get(w, 0) / words, FLOOR) for w in WORDS}
            out[lang] = ({x: n[f"#{x}"] / total for x in NAMES}, share | {"": max(1 - sum(share.values()), FLOOR)})
    return out


def half(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))


def class_distance(ref: dict[str, float], counts: dict[str, Column], total: Column) -> Column:
    out = F.lit(0.0)
    for n in NAMES:
        p, q = counts[n] / total, F.lit(float(ref[n]))
        out = out + half(p, (p + q) / 2) + half(q, (p + q) / 2)
    return F.sqrt(F.greatest(out / 2, F.lit(0.0)))


def word_distance(ref: dict[str, float], present: Column, n_words: Column) -> Column:
    """``present``: a (word, count) for every common word of the document; absent words add half their share."""
    of = F.create_map(*[F.lit(x) for w, q in ref.items() for x in (w, float(q))])
    start = F.struct(F.lit(0.0).alias("d"), F.lit(1.0).alias("left"), F.lit(0.0).alias("seen"))

    def add(a: Column, x: Column) -> Column:
        p, q = x["n"] / n_words, F.element_at(of, x["w"])
        return F.struct((a["d"] + half(p, (p + q) / 2) + half(q, (p + q) / 2)).alias("d"), (a["left"] - q).alias("left"), (a["seen"] + p).alias("seen"))

    def finish(a: Column) -> Column:
        p, q = F.greatest(1 - a["seen"], F.lit(0.0)), F.lit(float(ref[""]))
        return F.sqrt(F.greatest((a["d"] + half(p, (p + q) / 2) + half(q, (p + q) / 2) + F.greatest(a["left"] - q, F.lit(0.0))) / 2, F.lit(0.0)))

    return F.aggregate(present, start, add, finish)


def judged(df: DataFrame) -> DataFrame:
    """All columns of ``df`` (text, lang among them) in ``doc``, with the base counts, distances and ``kept``."""
    whole = df.select(F.struct(*df.columns).alias("doc"))
    source = whole.select("doc", F.coalesce("doc.text", F.lit("")).alias("text"), F.col("doc.lang").alias("lang"))
    refs = references(source.select("text", "lang"))
    d = with_classes(with_words(source))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc", "lang", *(f"n_{n}" for n in NAMES),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("n_blank")).cast("long").alias("word_chars"),
        F.col("n_symbol").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        common_words(F.col("words")).alias("common"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("present", F.transform(F.array_distinct("common"), lambda w: F.struct(w.alias("w"), F.size(F.filter("common", lambda x: x == w)).alias("n"))))
    total = F.col("word_chars") + F.col("n_blank")
    counts = {n: F.col(f"n_{n}") for n in NAMES}
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    zero = F.lit(0.0)
    far_class = F.when(F.col("word_chars") >= LEAST_CHARS, least([class_distance(c, counts, total) for c, _ in refs.values()])) if refs else zero
    known = F.col("lang").isNull() | F.col("lang").isin(sorted(refs))
    far_words = F.when((F.col("n_words") >= LEAST_WORDS) & known, least([word_distance(w, F.col("present"), F.col("n_words")) for _, w in refs.values()])) if refs else zero
    d = d.withColumn("class_distance", F.coalesce(far_class, zero)).withColumn("word_distance", F.coalesce(far_words, zero))
    kept = ~F.col("base_failed") & (F.col("class_distance") <= CLASS_DISTANCE) & (F.col("word_distance") <= WORD_DISTANCE)
    return d.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")


def report(df: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document."""
    return judged(df.select("doc_id", "text", "lang")).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass, with their own columns."""
    # a filter would be pushed below the counts and compute them again; one that asks for a row number stays above
    found = judged(df).select("doc", "kept", F.monotonically_increasing_id().alias("row"))
    return found.where(F.col("kept") & (F.col("row") >= 0)).select("doc.*")


def _sql() -> str:
    """The same counts and verdict in DuckDB SQL."""
    left, steps = "t", []
    for name, pattern in CLASSES:
        quoted = pattern.replace("'", "''")
        steps.append((name, left, quoted))
        left = f"regexp_replace({left}, '{quoted}', '', 'g')"
    classes = ", ".join(f"length({x}) - length(regexp_replace({x}, '{p}', '', 'g')) AS n_{n}" for n, x, p in steps) + f", length({left}) AS n_rest"
    words = "', '".join(WORDS)
    langs = "', '".join(sorted(COMMON))
    unpivot = ", ".join(f"n_{n}" for n in NAMES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang FROM documents),
    c AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, {classes} FROM d),
    u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM c),
    win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS x
            FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
    again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win WHERE x IS NOT NULL) WHERE n > 1),
    cover AS (SELECT rid, count(DISTINCT i + k) AS n_repeat FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
    hist AS (SELECT rid, CASE WHEN lower(w) IN ('{words}') THEN lower(w) ELSE '' END AS w, count(*) AS n FROM u GROUP BY ALL),
    b AS (SELECT c.*, len(ws) AS n_words, t_len - n_blank AS word_chars, len(ls) - len(list_distinct(ls)) AS n_dup, coalesce(n_repeat, 0) AS n_rep
          FROM (SELECT *, length(t) AS t_len FROM c) c LEFT JOIN cover USING (rid)),
    lang_chars AS (SELECT lang, cls, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
                   FROM (UNPIVOT (SELECT lang, {unpivot} FROM b WHERE lang IN ('{langs}')) ON {unpivot} INTO NAME cls VALUE n) GROUP BY lang, cls),
    langs AS (SELECT lang, sum(n_words) AS total FROM b WHERE lang IN ('{langs}') GROUP BY lang HAVING sum(n_words) > 0),
    voc AS (SELECT unnest(['{words}']) AS w),
    seen AS (SELECT lang, h.w, sum(n) AS n FROM hist h JOIN b USING (rid) GROUP BY ALL),
    named AS (SELECT langs.lang, voc.w, greatest(coalesce(seen.n, 0) / total, {FLOOR}) AS q
              FROM langs CROSS JOIN voc LEFT JOIN seen ON seen.lang = langs.lang AND seen.w = voc.w),
    lang_words AS (SELECT * FROM named UNION ALL SELECT lang, '', greatest(1 - sum(q), {FLOOR}) FROM named GROUP BY lang),
    doc_chars AS (SELECT rid, cls, n / t_len AS p FROM (UNPIVOT (SELECT rid, t_len, {unpivot} FROM b WHERE word_chars >= {LEAST_CHARS}) ON {unpivot} INTO NAME cls VALUE n)),
    far_c AS (SELECT rid, min(js) AS js FROM (SELECT rid, lang, sqrt(greatest(0, sum(
                CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
              FROM doc_chars JOIN lang_chars USING (cls) GROUP BY rid, lang) GROUP BY rid),
    far_w AS (SELECT rid, min(js) AS js FROM (SELECT rid, l.lang, sqrt(greatest(0, sum(
                CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
              FROM (SELECT b.rid, l.lang, l.w, q, coalesce(h.n, 0) / n_words AS p FROM b CROSS JOIN lang_words l LEFT JOIN hist h ON h.rid = b.rid AND h.w = l.w
                    WHERE n_words >= {LEAST_WORDS} AND (b.lang IS NULL OR b.lang IN (SELECT lang FROM langs))) l GROUP BY rid, l.lang) GROUP BY rid),
    f AS (SELECT b.*, n_words < 10 OR 100 * n_rep > 20 * n_words AS failed, coalesce(far_c.js, 0) AS jc, coalesce(far_w.js, 0) AS jw
          FROM b LEFT JOIN far_c USING (rid) LEFT JOIN far_w USING (rid))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbol AS BIGINT) AS n_symbols,
           CAST(n_dup AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
           NOT failed AND jc <= {CLASS_DISTANCE} AND jw <= {WORD_DISTANCE} AS kept
    FROM f"""


SQL = _sql()
