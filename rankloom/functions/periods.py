"""Seasons, evaluation periods and eras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_years(c: Column) -> Column:
    """struct(start, end) of '2022-23', '1999/2000' or '2008' (end null); null for anything else."""
    s = F.trim(F.regexp_replace(c, r"\[[^\]]*\]", ""))
    long = F.regexp_extract(s, r"^(\d{4})[-–/](\d{4}|\d{2})$", 1)
    tail = F.regexp_extract(s, r"^(\d{4})[-–/](\d{4}|\d{2})$", 2)
    start, two = long.try_cast("int"), tail.try_cast("int")
    century = (F.floor(start / 100) * 100).cast("int") + two
    end = F.when(F.length(tail) == 4, two).otherwise(F.when(century < start, century + 100).otherwise(century))
    single = F.regexp_extract(s, r"^(\d{4})$", 1).try_cast("int")
    none = F.lit(None).cast("int")
    return F.when(long != "", F.struct(start.alias("start"), end.alias("end"))).when(single.isNotNull(), F.struct(single.alias("start"), none.alias("end")))


def season_in_period(season: Column, year: Column, kind: Column) -> Column:
    """Season awards: the season ends that year; calendar awards: either end is that year."""
    start, end = season["start"], season["end"]
    return F.coalesce(F.when(kind == "season", end == year).otherwise((start == year) | (F.coalesce(end, start) == year)), F.lit(False))


def international_year_in_period(played: Column, year: Column, kind: Column) -> Column:
    y = F.regexp_extract(F.trim(played), r"^(\d{4})$", 1).try_cast("int")
    return F.coalesce((y == year) | ((kind == "season") & (y == year - 1)), F.lit(False))


def period_seasons(year: Column, kind: Column) -> Column:
    """Start years of the league seasons an evaluation period covers."""
    return F.when(kind == "season", F.array(year - 1)).otherwise(F.array(year - 1, year))


def eval_period(year: Column) -> Column:
    """struct(kind, start, end): August to July from 2022 on, calendar years before."""
    season = year >= 2022
    return F.struct(
        F.when(season, F.lit("season")).otherwise(F.lit("calendar_year")).alias("kind"),
        F.when(season, F.make_date(year - 1, F.lit(8), F.lit(1))).otherwise(F.make_date(year, F.lit(1), F.lit(1))).alias("start"),
        F.when(season, F.make_date(year, F.lit(7), F.lit(31))).otherwise(F.make_date(year, F.lit(12), F.lit(31))).alias("end"),
    )


# How introductions name an evaluation period.
SEASON_NAMED = r"(?i)(\d{4})[-–](\d{2,4})\s+(?:European\s+)?season"
DATES_NAMED = r"(?i)(\d{1,2}\s+\w+\s+\d{4})\s+to\s+(\d{1,2}\s+\w+\s+\d{4})"


def detect_period(intro: Column) -> Column:
    """struct(kind, start, end, first_day, last_day) of what an introduction says: a season's years, two dates, or nothing."""
    start = F.regexp_extract(intro, SEASON_NAMED, 1).try_cast("int")
    tail = F.regexp_extract(intro, SEASON_NAMED, 2)
    years = season_years(F.concat(start.cast("string"), F.lit("-"), tail))
    first, last = (F.nullif(F.regexp_extract(intro, DATES_NAMED, k), F.lit("")) for k in (1, 2))
    kind = F.when(start.isNotNull(), F.lit("season")).when(first.isNotNull(), F.lit("season_explicit_dates"))
    dates = kind == "season_explicit_dates"
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), start.alias("start"), F.coalesce(years["end"], F.when(start.isNotNull(), tail.try_cast("int"))).alias("end"), F.when(dates, first).otherwise(none).alias("first_day"), F.when(dates, last).otherwise(none).alias("last_day"))


def verification(year: Column, rule: Column, found: Column) -> Column:
    """Whether what an introduction says (see :func:`detect_period`) agrees with the rule's kind for that year."""
    agrees = (rule == "season") & ((found["kind"] == "season_explicit_dates") | ((found["start"] == year - 1) & (found["end"] == year)))
    return F.when(found["kind"].isNull(), F.lit("inferred_from_rule")).when(F.coalesce(agrees, F.lit(False)), F.lit("verified")).otherwise(F.lit("discrepancy"))


# The first years of the eras after the first one.
ERAS = {1995: "pre_merger", 2010: "fifa_merger", 2016: "post_split"}


def era(year: Column) -> Column:
    out = F.lit("classical")
    for first, name in ERAS.items():
        out = F.when(year >= first, name).otherwise(out)
    return F.when(year.isNull(), "post_split").otherwise(out)


def short_season(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0"))


# The titles of competitions' pages, by season or by year; the club cup's older name ends with 1991.
SEASON_PAGES = {"england": "Premier League", "spain": "La Liga", "italy": "Serie A", "germany": "Bundesliga", "france": "Ligue 1"}
YEAR_PAGES = {"world_cup": "{} FIFA World Cup", "euro": "UEFA Euro {}", "copa": "{} Copa América"}
CUP_PAGES = ("European Cup", "UEFA Champions League", 1992)


def page_name(competition: str, year: Column) -> Column:
    """Title of a competition's page for the year a season starts or a tournament is held."""
    if competition in YEAR_PAGES:
        before, after = YEAR_PAGES[competition].split("{}")
        return F.concat(F.lit(before), year.cast("string"), F.lit(after))
    old, new, since = CUP_PAGES
    name = F.when(year < since, old).otherwise(new) if competition == "ucl" else F.lit(SEASON_PAGES[competition])
    return F.concat(short_season(year), F.lit(" "), name)
