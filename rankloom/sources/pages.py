"""What cached pages say: rankings, careers, international careers, results, top threes, introductions.

Python turns a page's tables into cells named by role; typing, filters and
de-duplication are Column expressions on those cells. Pages are fetched into a
versioned table by a few tasks, or one by one into a folder; the fetcher is passed in.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import periods, text
from rankloom.operators.aggregates import without_totals
from rankloom.sources.landing import HEADERS, tables_of
from rankloom.sources.versions import VersionedTable

MISS = None


def cached(path: str, fetch: Callable[[], str | None], least: int = 1000, attempts: int = 3, delay: float = 1.5, backoff: str = "double", sleep: Callable[[float], None] = time.sleep, required: bool = True) -> str | None:
    """The page at ``path`` if that file is larger than ``least`` bytes, else what ``fetch`` gives, stored atomically.

    A failed attempt waits delay * 2**attempt, or delay * attempt with ``backoff="linear"``.
    After the last one the error is raised, or None returned if the page isn't required.
    """
    if os.path.exists(path) and os.path.getsize(path) > least:
        with open(path, encoding="utf-8") as f:
            return f.read()
    for attempt in range(1, attempts + 1):
        try:
            page = fetch()
            if page is not None:
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                with open(f"{path}.part", "w", encoding="utf-8") as f:
                    f.write(page)
                os.replace(f"{path}.part", path)
            return page
        except Exception:
            if attempt == attempts:
                if required:
                    raise
                return MISS
            sleep(delay * (2**attempt if backoff == "double" else attempt))
    return MISS


def fetch_missing(keys: Iterable[str], folder: str, fetch: Callable[[str], str | None], first: int = 0, last: int | None = None, **options) -> dict[str, str]:
    """key -> cached, fetched or missing, for a range of a list of pages; what is cached already is never fetched again."""
    out = {}
    for key in list(keys)[first:last]:
        path = f"{folder}/{key}.json"
        had = os.path.exists(path) and os.path.getsize(path) > options.get("least", 1000)
        page = cached(path, lambda key=key: fetch(key), required=False, **options)
        out[key] = "cached" if had else "missing" if page is None else "fetched"
    return out


def fetch_table(keys: DataFrame, key: str, table: VersionedTable, fetch: Callable[[str], str | None], connections: int = 4, least: int = 1000, attempts: int = 3, delay: float = 1.5) -> int:
    """Fetches the pages of all keys that ``table`` doesn't hold and adds them as a version; returns its number.

    The keys are a table of any length. Each of the ``connections`` tasks fetches one
    page at a time and waits ``delay`` between two, so that many requests a ``delay``
    reach the site at most; a failed attempt waits twice as long as the one before it.
    Rows: key, content, status (ok, small, missing or failed), error; only ok ones
    count as held, so the others are tried again by the next call.
    """
    have = table.read().where("status = 'ok'").select(key) if table.current() else None
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct()
    todo = asked if have is None else asked.join(have, key, "left_anti")

    def one(k: str) -> tuple:
        for attempt in range(1, attempts + 1):
            try:
                page = fetch(k)
                return k, page, "missing" if page is None else "ok" if len(page) > least else "small", None
            except Exception as e:  # told in the row
                if attempt == attempts:
                    return k, None, "failed", f"{type(e).__name__}: {e}"
                time.sleep(delay * 2**attempt)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, k in enumerate(pdf[key]):
                if i:
                    time.sleep(delay)
                yield pd.DataFrame([one(k)], columns=[key, "content", "status", "error"])

    return table.add(todo.repartition(connections).mapInPandas(run, f"{key} string, content string, status string, error string"))


def api_html(content):
    """The page's html inside an API answer; null for an error payload."""
    return F.from_json(content, "parse struct<text: struct<`*`: string>>").getField("parse").getField("text").getField("*")


# Words by which a table's headers name what a column holds.
MEASURES = {"apps": ("apps", "appearances", "matches", " mp"), "goals": ("goals", "gls"), "assists": ("assists",), "minutes": ("min",)}
BARE = {"apps": {"apps", "appearances", "matches", "mp"}, "goals": {"goals", "gls"}, "assists": {"assists", "ast"}, "minutes": {"minutes", "min", "mins"}}
ABROAD = ("continental", "europe")
COMPETITION = ("competition", "cup", "tournament", "name", "type")
PLAIN = {"years": "season", "season": "season", "year": "season", "team": "club", "club": "club", "clubs": "club"}
NO_DATA = ("navbox", "nowraplinks", "infobox")


def bare(header: str) -> str:
    return re.sub(r"\[[^\]]*\]", "", header).strip().lower()


def career_role(header: str) -> str | None:
    """Which part of a career a column tells; continental columns before league ones, headers without a prefix are league."""
    if header in PLAIN:
        return PLAIN[header]
    says = lambda words: any(w in header for w in words)
    measure = next((m for m, words in MEASURES.items() if says(words)), None)
    if says(ABROAD) and says(COMPETITION):
        return "continental_competition"
    for prefix, named in (("continental", says(ABROAD)), ("league", "league" in header)):
        if named:
            return f"{prefix}_{measure}" if measure else None
    return next((f"league_{m}" for m, words in BARE.items() if header in words), None)


def international_role(header: str) -> str | None:
    if header in ("year", "years"):
        return "year"
    if header in ("team", "national team"):
        return "team"
    return "apps" if header in BARE["apps"] | {"caps"} else "goals" if header in BARE["goals"] else None


def ranking_role(header: str) -> str | None:
    return HEADERS.get(re.sub(r"\(s\)", "", header).strip(), header)


def head_rows(rows: list) -> int:
    return next((i for i, r in enumerate(rows) if not r or not all(h for h, _ in r)), len(rows))


def headers(table: dict, levels: str = "joined") -> list[str]:
    """One name a column from one or several header rows: their distinct parts joined, or the lowest that isn't empty."""
    heads = table["rows"][: max(head_rows(table["rows"]), 1)]
    out = []
    for k in range(max(map(len, heads), default=0)):
        parts = [bare(r[k][1]) for r in heads if k < len(r) and r[k][1]]
        parts = list(dict.fromkeys(parts))
        out.append("" if not parts else parts[-1] if levels == "lowest" else " ".join(parts))
    return out


def body(table: dict) -> list[list[str]]:
    """The cells of the rows below the header; rows without any text go."""
    return [[c for _, c in r] for r in table["rows"][max(head_rows(table["rows"]), 1) :] if any(c for _, c in r)]


def first_names(table: dict, n: int) -> str:
    return " ".join(bare(c) for c in [c for r in table["rows"] for h, c in r if h][:n])


def data_tables(tables: list[dict]) -> list[dict]:
    return [t for t in tables if not any(x in t["class"].split() for x in NO_DATA)]


def international_table(tables: list[dict]) -> list[dict]:
    """By caption, else by header."""
    some = data_tables(tables)
    for t in some:
        caption = t["caption"].lower()
        if "appearances and goals by national" in caption or "international" in caption and "goals" in caption:
            return [t]
    return [t for t in some if "national team" in first_names(t, 8) or "international career" in first_names(t, 8)][:1]


def career_table(tables: list[dict]) -> list[dict]:
    """By caption or title cell, else the first whose headers name a time, a club and a count, and no national team."""
    some, other = data_tables(tables), international_table(tables)
    for t in some:
        caption, title = t["caption"].lower(), t["rows"][0][0][1].lower() if t["rows"] and t["rows"][0] else ""
        if "senior career" in caption or "senior career" in title or "appearances and goals by club" in caption:
            return [t]
    for t in some:
        if any(t is x for x in other):
            continue
        names = first_names(t, 12)
        says = lambda *words: any(w in names for w in words)  # noqa: B023, E731
        if says("years", "season") and says("team", "club") and says("apps", "appearances", "goals", "division", "matches") and not says("international", "national team"):
            return [t]
    return []


def ranking_tables(tables: list[dict]) -> list[dict]:
    """The ranking, in one table or split in two: a first part of at most four rows and a second one of as many columns."""
    wide = lambda t: len([1 for r in t["rows"] for h, _ in r if h]) <= 40
    found = [t for t in tables if "wikitable" in t["class"] and "rank" in first_names(t, 8) and ("player" in first_names(t, 8) or "name" in first_names(t, 8)) and wide(t)]
    if len(found) > 1 and len(body(found[0])) <= 4 and body(found[1]) and len(headers(found[0])) == len(headers(found[1])):
        return found[:2]
    return found[:1]


def top_table(tables: list[dict]) -> list[dict]:
    return [t for t in tables if "wikitable" in t["class"] and all(w in first_names(t, 8) for w in ("year", "rank", "player"))][:1]


def page_rows(pages: DataFrame, key: str, content: str, pick: Callable[[list[dict]], list[dict]], role: Callable[[str], str | None], levels: str = "joined") -> DataFrame:
    """key, row_no, cells: the rows of the picked tables one after the other, cells named by role; of two columns of a role the first counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, page in zip(pdf[key], pdf[content]):
                n = 0
                for t in pick(tables_of(page)):
                    names = [role(h) for h in headers(t, levels)]
                    first = {name: i for i, name in reversed(list(enumerate(names))) if name}
                    for r in body(t):
                        out.append((k, n, {name: r[i] for name, i in first.items() if i < len(r)}))
                        n += 1
            yield pd.DataFrame(out, columns=[key, "row_no", "cells"])

    some = pages.where(F.contains(F.lower(content), F.lit("<table"))).select(key, content)
    return some.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, row_no int, cells map<string,string>")


def cell(name: str):
    return F.col("cells")[name]


def rankings(pages: DataFrame, year: str, content: str) -> DataFrame:
    """Typed ranking rows of each year's page; ``rank`` or ``player_name_raw`` is null where it can't be read (see parsed_or_skipped)."""
    rows = page_rows(pages, year, content, ranking_tables, ranking_role, "lowest")
    known = {"club": "club_at_time", "nationality": "nation_team", "position": "position_raw"}
    return rows.select(
        F.col(year).cast("string").alias("season_id"), F.col(year).cast("int").alias("award_year"), "row_no", text.parse_rank(cell("rank")).alias("rank"),
        F.nullif(text.clean_text(cell("player")), F.lit("")).alias("player_name_raw"), *(text.clean_text(cell(c)).alias(n) for c, n in known.items()), text.parse_points(cell("points")).alias("points"),
    )


def careers(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, row_no, season, season_raw, club and the counts of each season of a career; sums over seasons go."""
    rows = page_rows(pages, key, content, career_table, career_role)
    span = periods.season_years(cell("season"))
    season = F.when(span["end"].isNull(), span["start"].cast("string")).otherwise(F.concat_ws("-", span["start"], span["end"]))
    counts = [f"{p}_{m}" for p in ("league", "continental") for m in MEASURES]
    typed = rows.select(
        key, "row_no", season.alias("season"), F.trim(cell("season")).alias("season_raw"), F.trim(F.coalesce(cell("club"), F.lit(""))).alias("club"),
        *((text.parse_minutes if c.endswith("minutes") else text.parse_int)(cell(c)).alias(c) for c in counts), F.trim(F.coalesce(cell("continental_competition"), F.lit(""))).alias("continental_competition"),
    )
    return without_totals(typed.where("season IS NOT NULL"), ["season_raw", "club"])


def international_careers(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, row_no, year, team, apps, goals of each year played for a nation."""
    rows = page_rows(pages, key, content, international_table, international_role)
    typed = rows.select(key, "row_no", F.trim(cell("year")).alias("year"), F.trim(F.coalesce(cell("team"), F.lit(""))).alias("team"), text.parse_int(cell("apps")).alias("apps"), text.parse_int(cell("goals")).alias("goals"))
    return without_totals(typed.where(F.rlike("year", F.lit(r"^\d{4}"))), ["team"])


def top_three(pages: DataFrame, key: str, content: str) -> DataFrame:
    """award_year, rank, player of a page that lists the first three of many years."""
    rows = page_rows(pages, key, content, top_table, lambda h: h)
    typed = rows.select(text.parse_int(cell("year")).cast("int").alias("award_year"), text.parse_rank(cell("rank")).alias("rank"), text.clean_text(cell("player")).alias("player"))
    return typed.where("award_year IS NOT NULL AND rank <= 3")


def results(pages: DataFrame, key: str, content: str, league: bool = False) -> DataFrame:
    """key, stage, team from label and value cells of the first table that names a winner or runner-up.

    League pages name a winner only, the first one.
    """
    winners = ("winners", "winner") if league else ("winners", "winning team", "winner")

    def said(page: str) -> list[tuple[str, str]]:
        for t in tables_of(page):
            if any(x in t["class"].split() for x in NO_DATA[:2]):
                continue
            found = []
            for r in t["rows"]:
                label, value = (" ".join(re.sub(r"\s*\[[^\]]*\]\s*", " ", c).split()) for _, c in r[:2]) if len(r) > 1 else ("", "")
                low = label.lower()
                if not low or not value:
                    continue
                if "champion" in low or low in winners:
                    found.append(("winner", value))
                elif "runner" in low and not league:
                    found.append(("runner_up", value))
            if found:
                return found[:1] if league else found
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(k, stage, team) for k, page in zip(pdf[key], pdf[content]) for stage, team in said(page)], columns=[key, "stage", "team"])

    some = pages.where(F.contains(F.lower(content), F.lit("<table"))).select(key, content)
    found = some.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, stage string, team string")
    return found.withColumn("team", text.clean_team(F.col("team")))


def introductions(pages: DataFrame, key: str, content: str, least: int = 50) -> DataFrame:
    """key, intro: the first paragraph of more than ``least`` characters, empty if there is none. No Python."""
    paragraphs = F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1))
    plain = F.transform(paragraphs, lambda p: text.collapsed(F.regexp_replace(F.regexp_replace(p, r"(?s)<[^>]*>", ""), "&nbsp;|&#160;", " ")))
    return pages.select(key, F.coalesce(F.get(F.filter(plain, lambda p: F.length(p) > least), F.lit(0)), F.lit("")).alias("intro"))


def overview(pages: DataFrame, key: str, content: str, peek: int = 2) -> DataFrame:
    """key, table_no, heading, caption, class, n_rows, n_columns, columns, first_rows of every table of every page."""
    columns: Sequence[str] = [key, "table_no", "heading", "caption", "class", "n_rows", "n_columns", "columns", "first_rows"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, page in zip(pdf[key], pdf[content]):
                for n, t in enumerate(tables_of(page)):
                    rows, names = body(t), headers(t)
                    out.append((k, n, t["heading"], t["caption"], t["class"], len(rows), max([len(names), *map(len, rows)]), names, [" | ".join(r) for r in rows[:peek]]))
            yield pd.DataFrame(out, columns=columns)

    some = pages.where(F.contains(F.lower(content), F.lit("<table"))).select(key, content)
    return some.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, table_no int, heading string, caption string, class string, n_rows int, n_columns int, columns array<string>, first_rows array<string>")
