import pytest
from pyspark.sql import functions as F

from rankloom.operators import aggregates
from rankloom.sources import landing, pages

RANKING = """<table class="navbox"><tr><th>Rank</th><th>Player</th></tr></table>
<table class="wikitable"><tr><th rowspan=2>Rank[2]</th><th rowspan=2>Player</th><th rowspan=2>Club(s)</th><th colspan=2>Votes by place</th><th rowspan=2>Points</th><th rowspan=2>Points</th></tr><tr><th>1st</th><th>2nd</th></tr>
<tr><td>1st</td><td>Ann&nbsp;A[note 1]</td><td>X FC</td><td>3</td><td>1</td><td>1,234</td><td>9</td></tr><tr><td>2</td><td>Bob B</td><td>Y</td><td></td><td></td><td>12.5%</td><td>8</td></tr><tr><td></td><td></td></tr></table>
<table class="wikitable"><tr><th>Rank</th><th>Name[3]</th><th>Team</th><th>1st</th><th>2nd</th><th>Pts</th><th>x</th></tr><tr><td>3</td><td>Cy</td><td>Z</td><td></td><td></td><td>-</td><td></td></tr><tr><td>—</td><td>Nobody</td><td></td></tr></table>"""
CAREER = """<table class="infobox"><tr><th>Season</th><th>Club</th><th>Apps</th></tr></table>
<table><caption>Senior career*</caption><tr><th rowspan=2>Season</th><th rowspan=2>Club</th><th colspan=2>League</th><th colspan=2>Europe</th></tr><tr><th>Apps</th><th>Goals</th><th>Competition</th><th>Apps</th></tr>
<tr><td>1999–00</td><td>X</td><td>30[a]</td><td>7</td><td>Cup</td><td>4</td></tr><tr><td>2001</td><td>Y</td><td>—</td><td>2.0</td><td></td><td></td></tr><tr><td>2002-03</td><td>Career total</td><td>9</td><td>9</td><td></td><td></td></tr><tr><td>Total</td><td></td><td>39</td><td>9</td><td></td><td></td></tr></table>
<table><caption>Appearances and goals by national team and year</caption><tr><th>National team</th><th>Year</th><th>Apps</th><th>Goals</th></tr><tr><td>Utopia</td><td>2000</td><td>5</td><td>1</td></tr><tr><td>Total</td><td>2001</td><td>5</td><td>1</td></tr></table>"""
RESULT = '<table class="navbox"><tr><th>Champions</th><td>No</td></tr></table><table class="infobox"><tr><th>Champions</th><td>X FC (3rd title)</td></tr><tr><th>Runners-up</th><td>Y FC</td></tr></table><table><tr><th>Winners</th><td>Z</td></tr></table>'


def page(spark, html, key=2010):
    return spark.createDataFrame([(key, html), (key + 1, None), (key + 2, "<p>no</p>")], "page int, html string")


def test_rankings_from_split_tables(spark):
    rows = pages.rankings(page(spark, RANKING), "page", "html")
    good, skipped = aggregates.parsed_or_skipped(rows, ["rank", "player_name_raw"])
    got = [(r.rank, r.player_name_raw, r.club_at_time, r.points) for r in good.orderBy("rank").collect()]
    assert got == [(1, "Ann A", "X FC", 1234.0), (2, "Bob B", "Y", 12.5), (3, "Cy", "Z", None)]
    assert skipped.first().skipped == 1


def test_careers(spark):
    got = pages.careers(page(spark, CAREER), "page", "html").orderBy("row_no").collect()
    assert [(r.season, r.club, r.league_apps, r.league_goals, r.continental_apps, r.continental_competition) for r in got] == [("1999-2000", "X", 30, 7, 4, "Cup"), ("2001", "Y", None, 2, None, "")]
    got = pages.international_careers(page(spark, CAREER), "page", "html").collect()
    assert [(r.year, r.team, r.apps, r.goals) for r in got] == [("2000", "Utopia", 5, 1)]


@pytest.mark.parametrize("header, role", [("league apps", "league_apps"), ("goals", "league_goals"), ("europe competition", "continental_competition"), ("continental goals", "continental_goals"), ("league europe apps", "continental_apps"), ("mins", "league_minutes"), ("flag", None)])
def test_roles(header, role):
    assert pages.career_role(header) == role


def test_results_stop_at_the_first_table(spark):
    got = sorted((r.stage, r.team) for r in pages.results(page(spark, RESULT), "page", "html").collect())
    assert got == [("runner_up", "Y FC"), ("winner", "X FC")]
    assert [(r.stage, r.team) for r in pages.results(page(spark, RESULT), "page", "html", league=True).collect()] == [("winner", "X FC")]


def test_top_three_intro_overview(spark):
    top = '<table class="wikitable"><tr><th>Year</th><th>Rank</th><th>Player</th></tr><tr><td rowspan=2>1956</td><td>1st</td><td>A[1]</td></tr><tr><td>4th</td><td>B</td></tr></table>'
    assert [tuple(r) for r in pages.top_three(page(spark, top), "page", "html").collect()] == [(1956, 1, "A")]
    text = f"<p>short</p><P class=x>The <b>award</b> of the 2022–23 season{' and so on' * 9}</P>"
    got = {r.page: r.intro for r in pages.introductions(page(spark, text), "page", "html").collect()}
    assert got[2010].startswith("The award of the 2022–23 season and") and got[2011] == got[2012] == ""
    seen = pages.overview(page(spark, CAREER), "page", "html").orderBy("table_no").collect()
    assert [(r.n_rows, r.n_columns) for r in seen] == [(0, 3), (4, 6), (2, 4)] and seen[1].caption == "Senior career*" and len(seen[1].first_rows) == 2


def test_cache_and_retry(tmp_path):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("503")
        return "x" * 2000

    path = str(tmp_path / "a" / "1999.json")
    assert pages.cached(path, flaky, sleep=waits.append) == "x" * 2000 and waits == [3.0, 6.0]
    assert pages.cached(path, lambda: 1 / 0) == "x" * 2000
    with pytest.raises(ZeroDivisionError):
        pages.cached(str(tmp_path / "b"), lambda: 1 / 0, sleep=waits.append)
    assert pages.cached(str(tmp_path / "b"), lambda: 1 / 0, backoff="linear", sleep=waits.append, required=False) is None and waits[-2:] == [1.5, 3.0]
    assert pages.fetch_missing(["1999", "2000", "2001"], str(tmp_path / "a"), lambda k: None if k == "2000" else "y" * 1500) == {"1999": "cached", "2000": "missing", "2001": "fetched"}


def test_landing_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1}\nnot json\n{"k": 3}\n{"k": 2}\n')
    rows = landing.json_lines(spark, str(tmp_path / "x.jsonl"), "k int").orderBy("_line").collect()
    assert [r.k for r in rows] == [1, None, 3, 2] and rows[1]._bad == "not json"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1999.json").write_text('{"parse": {"text": {"*": "<p>hi</p>"}}}' + " " * 1000)
    (tmp_path / "p" / "2000.json").write_text("{}")
    (tmp_path / "p" / "2020.json").write_text("{}" + " " * 2000)
    got = landing.page_files(spark, str(tmp_path / "p")).withColumn("html", pages.api_html(F.col("content"))).collect()
    assert [(r.stem, r.html) for r in got] == [("1999", "<p>hi</p>")]
    (tmp_path / "n.tsv").write_text("# c\nA B\ta_b\nC\tc\n")
    assert sorted(tuple(r) for r in landing.tsv(spark, str(tmp_path / "n.tsv"), "name string, slug string").collect()) == [("A B", "a_b"), ("C", "c")]
    assert landing.yaml_map(spark, str(tmp_path / "no.yaml"), "y string, kind string", "y").count() == 0
    landing.write_small(str(tmp_path / "w.yaml"), landing.yaml_artifact({"2001": {"kind": "season"}, "1999": {"kind": "calendar_year"}}, ("made",)))
    assert [tuple(r) for r in landing.yaml_map(spark, str(tmp_path / "w.yaml"), "y string, kind string", "y").collect()] == [("1999", "calendar_year"), ("2001", "season")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "ok"), ("a", "ok"), ("a", "ok"), ("c", None)], "name string, status string")
    landing.split_by_status(df, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "good")).count() == 3 and spark.read.json(str(tmp_path / "bad")).count() == 1
    landing.write_tsv(df, str(tmp_path / "t"), ["name"])
    assert [r[0] for r in spark.read.csv(str(tmp_path / "t")).collect()] == ["a", "b", "c"]
    path = landing.write_version(df, str(tmp_path / "v"), "1")
    assert spark.read.parquet(path).count() == 4
    landing.replace_json_lines(df, str(tmp_path / "j"))
    landing.replace_json_lines(df.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert landing.markdown(df.select("name"), most=3).endswith("and 1 more") and landing.markdown(df.limit(1)).count("\n") == 2
    wide = spark.createDataFrame([(1, 2, 3)], "`Rank[1]` int, rank_2 int, `Club(s)` int")
    assert landing.first_columns(wide).columns == ["rank", "rank_2", "club"]


def test_fetching_a_table_of_pages(spark, tmp_path):
    from rankloom.sources.versions import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/pages", ["k"])
    log = tmp_path / "log"

    def fetch(k):
        with open(log, "a") as f:
            f.write(k + "\n")
        if k == "bad":
            raise OSError("gone")
        return None if k == "none" else k * (10 if k == "s" else 600)

    keys = spark.createDataFrame([("aa",), ("bb",), ("aa",), ("s",), ("none",), ("bad",), (None,)], "k string")
    assert pages.fetch_table(keys, "k", table, fetch, connections=2, attempts=2, delay=0.0) == 1
    got = {r.k: (r.status, r.error) for r in table.read().collect()}
    assert got == {"aa": ("ok", None), "bb": ("ok", None), "s": ("small", None), "none": ("missing", None), "bad": ("failed", "OSError: gone")}
    assert sorted(log.read_text().split()) == ["aa", "bad", "bad", "bb", "none", "s"]
    log.unlink()
    pages.fetch_table(keys, "k", table, lambda k: fetch(k) if k != "bad" else "z" * 2000, connections=2, attempts=1, delay=0.0)
    assert sorted(log.read_text().split()) == ["none", "s"] and {r.k: r.status for r in table.read().collect()}["bad"] == "ok"
