"""Text cleaning, typed parsing and name folding as Column expressions; only decomposition and entities are Arrow-batched UDFs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Footnote marks, titles won, win counts.
FOOTNOTE = r"\s*\[[^\]]*\]\s*"
TITLE_IN_BRACKETS = r"(?i)\s*\(\d+(st|nd|rd|th)\s+title\)\s*"
TITLE_AT_END = r"(?i)\s*\d+(st|nd|rd|th)\s+[^,]*title.*$"
WIN_COUNT = r"\s*\(\d+\)\s*"


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Null to empty; no-break spaces, footnotes and runs of blanks to one blank."""
    plain = F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(" "), F.lit(" "))
    return collapsed(F.regexp_replace(plain, FOOTNOTE, " "))


def clean_team(c: Column) -> Column:
    """As clean_text, without '(15th title)' or a trailing 'Nth ... title'."""
    c = F.regexp_replace(clean_text(c), TITLE_IN_BRACKETS, "")
    return collapsed(F.regexp_replace(c, TITLE_AT_END, ""))


def parse_rank(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    s = F.regexp_replace(F.regexp_replace(s, "(st|nd|rd|th)$", ""), r"\.0+$", "")
    return F.when(F.rlike(s, F.lit(r"^[+-]?\d+$")), s.try_cast("int"))


def parse_points(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")), "%+$", ""))
    return F.when(~F.lower(s).isin("", "nan", "none", "-", "—"), s.try_cast("double"))


def parse_int(c: Column) -> Column:
    """Integers, or numbers cut to their whole part; footnotes go, anything else is null."""
    s = F.trim(F.regexp_replace(F.trim(c.cast("string")), FOOTNOTE, ""))
    return F.when(~s.isin("", "-", "—", "nan", "None"), F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint")))


def parse_minutes(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")), FOOTNOTE, ""))
    return F.when(F.rlike(s, F.lit(r"^[+-]?\d+$")), s.try_cast("bigint"))


def falsy_to_null(c: Column, kind: str) -> Column:
    return F.nullif(c.cast("string"), F.lit("")).try_cast(kind)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", "_"), r"_?\[[^\]]*\]_?", "")


@F.pandas_udf(StringType())
def without_entities(names: pd.Series) -> pd.Series:
    return names.map(lambda s: html.unescape(s or ""))


@F.pandas_udf(StringType())
def unaccented(names: pd.Series) -> pd.Series:
    """Canonically decomposed, without the combining marks; null is empty."""
    return names.map(lambda s: "".join(x for x in unicodedata.normalize("NFD", s or "") if not unicodedata.combining(x)))


# Letters that canonical decomposition leaves whole.
ONE_LETTER = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Ð": "D", "ð": "d"}
TWO_LETTERS = {"Æ": "AE", "æ": "ae", "ß": "ss", "Þ": "TH", "þ": "th"}


def normalize_name(c: Column | str, entities: bool = True, letters: bool = True, drop_apostrophes: bool = True) -> Column:
    """Lower-case words of plain letters, the form that all matchers compare; switches cover their differences. Null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    s = unaccented(without_entities(c) if entities else c)
    if letters:
        s = F.translate(s, "".join(ONE_LETTER), "".join(ONE_LETTER.values()))
        for old, new in TWO_LETTERS.items():
            s = F.replace(s, F.lit(old), F.lit(new))
    if drop_apostrophes:
        s = F.replace(s, F.lit("'"), F.lit(""))
    marks = F.regexp_replace(F.lower(s), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(marks, r"(?U)\s+", " "))


def normalize_award_name(c: Column | str) -> Column:
    """As the award tables are compared: without footnotes, win counts such as '(3)' and accents. Null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return unaccented(F.regexp_replace(F.lower(clean_text(c)), WIN_COUNT, ""))


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / total length, bit-parallel in the length of ``a``."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sort_ratio_of(a: str | None, b: str | None) -> float:
    return indel_ratio(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())))


@F.pandas_udf(DoubleType())
def token_sort_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio_of(a, b) for a, b in zip(left, right)], dtype=float)


# a filter on the score would else be pushed below it and compute it again
token_sort_ratio = token_sort_ratio.asNondeterministic()
