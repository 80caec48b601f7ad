"""Landing-file sources and sinks: JSON lines, page files, HTML tables, TSV, YAML, Parquet versions."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with ``_file`` and ``_line``; a malformed line is kept in ``_bad`` instead of failing the scan.

    ``_line`` grows down each file (it is the byte order of a task's range of the file, not a count), which is what
    "first in file order" needs.
    """
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("_line"))


def page_files(spark: SparkSession, folder: str, least: int = 1000, skip: tuple[str, ...] = ("2020",)) -> DataFrame:
    """stem, content of cached pages; files too small to be a page are misses."""
    raw = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.col("value").alias("content"))
    return raw.where((F.octet_length("content") > least) & ~F.col("stem").isin(list(skip)))


def tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).option("sep", "\t").option("comment", "#").csv(path)


def yaml_map(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A small YAML map as rows; a missing file gives none."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
    except FileNotFoundError:
        found = {}
    return spark.createDataFrame([{key: str(k), **v} for k, v in sorted(found.items())], schema)


class TableParser(HTMLParser):
    """Tables of a page as grids, whatever end tags are missing; rowspan and colspan are expanded, damaged counts read as 1.

    Open tables form a stack, each with its open cell. A cell ends at its end tag, at
    the next cell, row or row group, or with its table; a row likewise. A table that
    begins in no cell of the open one ends that one; one that begins in a cell is a
    table of its own, and the cell goes on after it with its own text. Tables still
    open at the page's end count.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.heading = ""
        self.title: list[str] | None = None  # an open heading's text
        self.silent = 0  # scripts and styles

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        t = self.open[-1] if self.open else None
        if tag == "table":
            self._end_heading()
            if t and t["cell"] is None and t["said"] is None:
                self._end_table()
            self.open.append({"class": a.get("class") or "", "caption": "", "heading": self.heading, "rows": [], "spans": {}, "in_row": False, "cell": None, "said": None})
        elif tag in ("script", "style"):
            self.silent += 1
        elif t is None:
            if tag in ("h2", "h3", "h4"):
                self._end_heading()
                self.title = []
        elif tag == "caption":
            self._end_row(t)
            t["said"] = []
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row(t)
            if tag == "tr":
                self._begin_row(t)
        elif tag in ("td", "th"):
            self._end_cell(t)
            if not t["in_row"]:
                self._end_row(t)
                self._begin_row(t)
            count = lambda k: min(int(d), 1000) if (d := "".join(c for c in (a.get(k) or "1") if c.isascii() and c.isdigit())) and int(d) > 0 else 1
            t["cell"] = {"head": tag == "th", "wide": count("colspan"), "tall": count("rowspan"), "text": []}
        elif tag == "br":
            self.handle_data(" ")

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")

    def handle_data(self, data):
        if self.silent:
            return
        if not self.open:
            if self.title is not None:
                self.title.append(data)
            return
        t = self.open[-1]
        if t["cell"] is not None:
            t["cell"]["text"].append(data)
        elif t["said"] is not None:
            t["said"].append(data)

    def handle_endtag(self, tag):
        t = self.open[-1] if self.open else None
        if tag in ("script", "style"):
            self.silent = max(self.silent - 1, 0)
        elif t is None:
            if tag in ("h2", "h3", "h4"):
                self._end_heading()
        elif tag in ("td", "th"):
            self._end_cell(t)
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row(t)
        elif tag == "caption":
            self._end_caption(t)
        elif tag == "table":
            self._end_table()

    def close(self):
        super().close()
        self._end_heading()
        while self.open:
            self._end_table()

    def _end_heading(self):
        if self.title is not None:
            self.heading, self.title = plain("".join(self.title)), None

    @staticmethod
    def _end_caption(t):
        if t["said"] is not None:
            t["caption"], t["said"] = plain("".join(t["said"])), None

    @staticmethod
    def _begin_row(t):
        t["rows"].append([])
        t["in_row"] = True

    def _end_cell(self, t):
        self._end_caption(t)
        if t["cell"] is None:
            return
        c, t["cell"] = t["cell"], None
        said, row, at = (c["head"], plain("".join(c["text"]))), t["rows"][-1], len(t["rows"]) - 1
        self._spanned(t, row, at)
        for _ in range(c["wide"]):
            for k in range(1, c["tall"]):
                t["spans"][at + k, len(row)] = said
            row.append(said)

    def _end_row(self, t):
        self._end_cell(t)
        if t["in_row"]:
            self._spanned(t, t["rows"][-1], len(t["rows"]) - 1)
            t["in_row"] = False

    def _end_table(self):
        self._end_row(self.open[-1])
        self.tables.append(self.open.pop())

    @staticmethod
    def _spanned(t, row, at):
        while (at, len(row)) in t["spans"]:
            row.append(t["spans"][at, len(row)])


def plain(text: str) -> str:
    return " ".join(text.split())


def tables_of(page: str) -> list[dict]:
    p = TableParser()
    p.feed(page or "")
    p.close()
    return p.tables


def flat_header(rows: list[list[tuple[bool, str]]]) -> tuple[list[str], list[list[str]]]:
    """Header rows merged into unique names, and the body."""
    n = next((i for i, r in enumerate(rows) if not r or not all(h for h, _ in r)), len(rows))
    heads = rows[: max(n, 1)]
    names: list[str] = []
    for k in range(max(map(len, heads), default=0)):
        parts = list(dict.fromkeys(r[k][1] for r in heads if k < len(r) and r[k][1]))
        name = " ".join(parts) or f"column_{k}"
        names.append(name if name not in names else f"{name}_{k}")
    return names, [[c for _, c in r] for r in rows[max(n, 1) :] if any(c for _, c in r)]


def html_tables(pages: DataFrame, key: str, content: str, caption: str | None = None, header: tuple[str, ...] = ()) -> DataFrame:
    """key, table_no, heading, caption, row_no, cells (map of header to text) of tables that match; navigation boxes don't.

    Pages without a table never reach the Python workers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, page in zip(pdf[key], pdf[content]):
                for n, t in enumerate(tables_of(page)):
                    names, body = flat_header(t["rows"])
                    low = " ".join(names).lower()
                    if "navbox" in t["class"] or "infobox" in t["class"] or caption and caption.lower() not in t["caption"].lower() or not all(h.lower() in low for h in header):
                        continue
                    out += [(k, n, t["heading"], t["caption"], i, dict(zip(names, r))) for i, r in enumerate(body)]
            yield pd.DataFrame(out, columns=[key, "table_no", "heading", "caption", "row_no", "cells"])

    some = pages.where(F.contains(F.lower(content), F.lit("<table"))).select(key, content)
    return some.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, table_no int, heading string, caption string, row_no int, cells map<string,string>")


def infobox(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, label, value of two-cell infobox rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            out = [(k, r[0][1], r[1][1]) for k, page in zip(pdf[key], pdf[content]) for t in tables_of(page) if "infobox" in t["class"] for r in t["rows"] if len(r) == 2]
            yield pd.DataFrame(out, columns=[key, "label", "value"])

    return pages.where(F.contains(F.col(content), F.lit("infobox"))).select(key, content).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, label string, value string")


# Header words by the column they name.
HEADERS = {
    "rank": "rank", "pos": "position", "position": "position", "player": "player", "name": "player", "nationality": "nationality", "nation": "nationality", "country": "nationality", "national team": "nationality",
    "club": "club", "team": "club", "clubs": "club", "points": "points", "pts": "points", "total": "points", "percent": "points", "votes": "total_votes", "total votes": "total_votes",
}


def canonical_columns(names: list[str]) -> list[str]:
    """Known names for known headers; of a name that comes twice the first keeps it."""
    out: list[str] = []
    for n in names:
        low = re.sub(r"\[[^\]]*\]|\(s\)", "", n.lower()).strip()
        new = HEADERS.get(low, low)
        out.append(new if new not in out else f"{new}_{len(out)}")
    return out


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Parquet under a new version folder: a table is never overwritten while it is read."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").option("compression", "snappy").parquet(path)
    return path


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).distinct().orderBy(*columns).write.mode("overwrite").option("sep", "\t").csv(path)


def first_columns(df: DataFrame) -> DataFrame:
    """Canonical names; of columns that get one name the first stays (``df``'s own names are unique)."""
    named = canonical_columns(df.columns)
    plain = [HEADERS.get(bare, bare) for bare in (re.sub(r"\[[^\]]*\]|\(s\)", "", c.lower()).strip() for c in df.columns)]
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n, p in zip(df.columns, named, plain) if n == p))


def split_by_status(df: DataFrame, good: str, bad: str, status: str = "status") -> None:
    """Rows by status in two tables; the input is computed once, kept while both are written."""
    held = df.persist()
    try:
        held.where(F.col(status) == "ok").write.mode("append").json(good)
        held.where(F.coalesce(F.col(status), F.lit("")) != "ok").write.mode("append").json(bad)
    finally:
        held.unpersist()


def replace_json_lines(df: DataFrame, folder: str) -> None:
    """All rows anew; readers see the old table or the new one, as the job's commit renames whole files.

    ``df`` must not read ``folder`` itself.
    """
    df.write.mode("overwrite").json(folder)


def write_small(path: str, content: str) -> str:
    """A driver-side artifact, replaced atomically."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(f"{path}.part", path)
    return path


def json_artifact(data: dict) -> str:
    return json.dumps(data, indent=2, default=str)


def yaml_artifact(data: dict, comments: tuple[str, ...] = (), in_order: bool = True) -> str:
    """A YAML document with leading comment lines; keys sorted unless their order means something."""
    import yaml

    return "".join(f"# {c}\n" for c in comments) + yaml.safe_dump(data, sort_keys=in_order, allow_unicode=True)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report table of an aggregate; rows beyond ``most`` are counted in a last line, not hidden."""
    rows = df.limit(most + 1).collect()
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else unescape(str(v))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows[:most])]
    if len(rows) > most:
        lines.append(f"\n... and {df.count() - most} more")
    return "\n".join(lines)
