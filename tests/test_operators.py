import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import solve_logistic
from rankloom.operators import aggregates, joins, ranking, windows
from rankloom.sources import landing


def test_midrank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "p int, v double")
    got = [r[0] for r in df.select(windows.midrank_percentile(F.col("v"), ["p"]).alias("x"), "v").orderBy("v").select("x").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1 / 6, 2 / 3, 2 / 3])


def test_strict_lag_ignores_the_future(spark):
    rows = [("A", 2000, 1), ("A", 2001, 4), ("A", 2003, 1), ("B", 2000, 2)]
    calc = lambda rs: {(r.p, r.y): (r.wins, r.gap) for r in spark.createDataFrame(rs, "p string, y int, rank int").select("p", "y", windows.prior_count(F.col("rank") == 1, ["p"], "y").alias("wins"), windows.years_since(F.col("rank") == 1, ["p"], "y").alias("gap")).collect()}
    full, cut = calc(rows), calc([r for r in rows if r[1] <= 2001])
    assert full["A", 2000] == (0, 999) and full["A", 2001] == (1, 1) and full["A", 2003] == (1, 3)
    assert all(full[k] == v for k, v in cut.items())


def test_rank_correlations(spark):
    rows = list(zip(["s"] * 8, range(8), [0.9, 0.5, 0.5, 0.4, 0.3, 0.2, 0.2, 0.1], [-2, -1, -3, -3, -5, -6, -8, -7]))
    df = spark.createDataFrame(rows, "g string, k int, s double, r int")
    assert windows.spearman(df, ["g"], "s", "r").first().spearman == pytest.approx(0.903047, abs=1e-6)
    assert windows.kendall(df, ["g"], "s", "r").first().kendall == pytest.approx(0.792594, abs=1e-6)


def test_pairs_are_antisymmetric_and_fit_the_objective(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), i, i + 1, *map(float, rng.normal(size=2) - 0.1 * i)) for g in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "g int, k int, rank int, a double, b double")
    p = joins.pairwise(df, ["g"], ["rank"], "k", ["a", "b"]).toPandas()
    assert len(p) == 6 * 56 and abs(p[["a", "b"]].sum()).max() < 1e-9
    m = ranking.train_linear(df, "g", ["rank"], "k", ["a", "b"])
    x = p[["a", "b"]].to_numpy() / np.array(m.scale)
    w, b = solve_logistic(x, p.label.to_numpy(float))
    assert np.allclose(w, m.coefficients, atol=1e-4)
    s = df.withColumn("s", m.score()).withColumn("c", F.aggregate(m.contributions(), F.lit(m.intercept), lambda t, c: t + c["contribution"])).toPandas()
    assert np.allclose(s.s, s.c)


def test_dedupe_and_substring(spark):
    df = spark.createDataFrame([("A", "no_career_table", 1), ("A", "ok", 2), ("B", "odd", 3)], "n string, s string, i int")
    got = windows.first_by_priority(df, ["n"], windows.priority_of(F.col("s"), ["ok", "no_career_table"]), ["i"]).orderBy("n").collect()
    assert [r.s for r in got] == ["ok", "odd"]
    left = spark.createDataFrame([(1, 2020, "Manchester City F.C."), (2, 2020, "")], "id int, y int, club string")
    right = spark.createDataFrame([(2020, "Manchester City", "winner", 1), (2020, "Manchester City", "runner_up", 2)], "y int, team string, stage string, line int")
    got = joins.substring_match(left, right, ["y"], "club", "team", ["id"], ["line"]).collect()
    assert [(r.id, r.stage) for r in got] == [(1, "winner")]


def test_cascade_orders(spark):
    known = spark.createDataFrame([("T1", "john smith", 1), ("T2", "mary jones", 2)], "target string, norm string, pos int")
    aliases = spark.createDataFrame([("JS", "T1"), ("X", "gone")], "name string, canonical string")
    names = spark.createDataFrame([("a", "john smith"), ("JS", "js"), ("X", "x"), ("b", "jones maryy"), ("c", "nobody at all")], "name string, norm string")
    got = {r.name: (r.target, r.method) for r in joins.cascade(names, known, aliases).collect()}
    assert got == {"a": ("T1", "exact"), "JS": ("T1", "alias"), "X": (None, "alias_needs_refetch"), "b": ("T2", "fuzzy"), "c": (None, "failed")}


def test_blocking_loses_no_match(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcde"), size=rng.integers(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    from rankloom.functions.text import token_sort_ratio_of

    got = {r.i: r.score for r in joins.best_match(df, df.select(F.col("i").alias("j"), F.col("w").alias("v")).where("j % 2 = 0"), "w", "v", "i", "j", 60.0).collect()}
    for i, w in enumerate(words):
        best = max(token_sort_ratio_of(w, v) for v in words[::2])
        assert (got.get(i) == pytest.approx(best)) if best >= 60 else i not in got


def test_quality_checks(spark):
    rows = [(2000, r, f"p{r}", "c", "n", float(100 - r)) for r in range(1, 10)] + [(2001, 1, "q", None, "n", 10.0), (2001, 2, "q", "c", "n", 20.0), (2001, 7, "r", "c", "", None)]
    df = spark.createDataFrame(rows, "award_year int, rank int, player_name_raw string, club_at_time string, nation_team string, points double")
    got = {(r.check, r.key) for r in aggregates.quality_checks(df, [1999, 2000]).collect()}
    assert {("missing_years", "1999"), ("extra_years", "2001"), ("rank_gaps", "2001"), ("duplicate_players", "2001"), ("points_not_falling", "2001"), ("missing_points", "2001"), ("missing_nation_team", "2001"), ("low_row_count", "2000"), ("low_row_count", "2001")} <= got


def test_array_sums(spark):
    df = spark.createDataFrame([(1, [("A", 1), ("B", None), ("A", 4)]), (2, [("A", None)])], "i int, s array<struct<club:string, goals:bigint>>")
    got = df.select("i", *aggregates.array_sums("s", lambda x: F.lit(True), ["goals"], "club")).orderBy("i").collect()
    assert [(r.goals, r.clubs, r.n_matched) for r in got] == [(5, ["A", "B"], 3), (None, ["A"], 1)]


def test_html_tables(spark):
    page = '<table class="wikitable"><caption>Career</caption><tr><th rowspan=2>Season</th><th colspan="2">League</th></tr><tr><th>Apps</th><th>Goals</th></tr><tr><td rowspan="2">2001</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>'
    df = spark.createDataFrame([(1, page), (2, "none"), (3, None)], "k int, html string")
    got = landing.html_tables(df, "k", "html", caption="career").orderBy("row_no").collect()
    assert [r.cells for r in got] == [{"Season": "2001", "League Apps": "1", "League Goals": "2"}, {"Season": "2001", "League Apps": "3", "League Goals": "4"}]
    assert landing.canonical_columns(["Rank", "Pos", "Player[a]", "Club(s)", "Pts"]) == ["rank", "position", "player", "club", "points"]


def test_ingest_is_idempotent(spark, tmp_path):
    from rankloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":1,"status":"ok"}\n{"k":2,"status":"page_missing"}\n')
    go = lambda: ingest(spark, str(tmp_path / "in"), "k int, status string", ["k"], str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    go()
    (tmp_path / "in" / "b.json").write_text('{"k":1,"status":"ok"}\n{"k":3,"status":"ok"}\n')
    go()
    go()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 3]
    assert [r.k for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]
