"""Operators of any pool size against brute force, replayed ingestion, rankers, reports, and the library without its training-data part."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import lambdas, solve_logistic
from rankloom.functions import numeric, periods, text
from rankloom.operators import aggregates, boosting, joins, ranking, windows
from rankloom.plans import catalog, reports

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_kendall_in_strips_equals_whole_pools(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(a), float(b)) for g in "xy" for a, b in rng.integers(0, 40, (300, 2))] + [("z", 1.0, 2.0), ("z", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    for strip in (50, 10**6):
        got = {r.g: r.kendall for r in windows.kendall(df, ["g"], "a", "b", strip).collect()}
        for g in "xy":
            a, b = (np.array(v) for v in zip(*[(x, y) for k, x, y in rows if k == g]))
            u, v = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
            assert got[g] == pytest.approx((u * v).sum() / np.sqrt(np.abs(u).sum() * np.abs(v).sum()))
        assert got["z"] is None


def test_midrank_by_ranges_equals_the_window(spark):
    rng = np.random.default_rng(5)
    rows = [(int(p), None if i % 9 == 0 else float(v)) for i, (p, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500)))]
    df = spark.createDataFrame(rows, "p int, v double")
    one = windows.midrank_by_ranges(df, ["p"], "v", "x", ranges=7).select("p", "v", F.round("x", 9))
    two = df.select("p", "v", F.round(windows.midrank_percentile(F.col("v"), ["p"]), 9))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, [tuple(r) for r in two.collect()])) or sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)


def test_rank_gaps(spark):
    df = spark.createDataFrame([("a", r) for r in (1, 2, 2, 5, 9)] + [("b", 3)], "g string, r int")
    got = {r.g: (r.n, r.max_rank, r.n_missing, r.missing) for r in aggregates.rank_gaps(df, ["g"], "r", most=4).collect()}
    assert got == {"a": (5, 9, 5, [3, 4, 6, 7]), "b": (1, 3, 2, [1, 2])}


def test_folds_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(6)
    rows = [(y, i, i + 1, *map(float, rng.normal(size=2) - 0.2 * i)) for y in range(2000, 2005) for i in range(7)]
    df = spark.createDataFrame(rows, "y int, k int, rank int, a double, b double")
    pairs = joins.pairwise(df, ["y"], ["rank"], "k", ["a", "b"])
    pdf = pairs.toPandas()
    for kind in ("loso", "expanding"):
        for y, (scale, w, b) in ranking.fold_models(df, "y", ["rank"], "k", range(2001, 2005), ["a", "b"], kind).items():
            train = pdf[pdf.y != y] if kind == "loso" else pdf[pdf.y < y]
            x = train[["a", "b"]].to_numpy()
            assert scale == pytest.approx(x.std(axis=0))
            want, intercept = solve_logistic(x / x.std(axis=0), train.label.to_numpy(float))
            assert w == pytest.approx(want, abs=1e-6) and b == pytest.approx(intercept, abs=1e-6)
    scored = ranking.cross_validate(df, "y", ["rank"], "k", "rank", ["a", "b"], "expanding", skip=2)
    assert sorted({r.y for r in scored.collect()}) == [2002, 2003, 2004]


def test_listwise_ranker(spark):
    rng = np.random.default_rng(7)
    rows = []
    for y in range(30):
        x = rng.normal(size=(12, 3))
        x[rng.random(x.shape) < 0.1] = np.nan
        order = np.argsort(-(2 * np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 1])))
        rows += [(y, f"p{i}", int(np.flatnonzero(order == i)[0]) + 1, *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "y int, k string, rank int, a double, b double, c double")
    model = ranking.train_listwise(df, "y", "rank", "k", ["a", "b", "c"], rounds=60)
    assert [n for n, _ in ranking.importance(model, ["a", "b", "c"])][:2] == ["a", "b"]
    pdf = df.withColumn("s", model.score()).toPandas()
    assert pdf.s.to_numpy() == pytest.approx(model.predict(pdf[["a", "b", "c"]].to_numpy(float)))
    best = pdf.loc[pdf.groupby("y").s.idxmax()]["rank"]
    assert (best <= 3).mean() > 0.8
    held = ranking.cross_validate_listwise(df, "y", "k", "rank", ["a", "b", "c"], rounds=30).toPandas()
    assert len(held) == 360 and (held.loc[held.groupby("y").score.idxmax()]["rank"] <= 4).mean() > 0.6
    g, h = boosting.gradients(np.zeros((1, 3)), np.array([3.0, 2.0, 1.0]))
    assert g[0, 0] < 0 < g[0, 2] and abs(g.sum()) < 1e-12 and (h > 0).all()
    for n in (1, 2, 40):
        gain, score = np.maximum(32.0 - np.sort(rng.integers(1, 40, n)), 1), rng.normal(size=(3, n)).round(1)
        for k, pair in enumerate(zip(*boosting.gradients(score, gain))):
            assert np.allclose(pair, lambdas(score[k], gain, np.zeros(n)))


def test_ingest_survives_a_replay_and_prefers_good_rows(spark, tmp_path):
    from rankloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":1,"status":"page_missing"}\n{"k":1,"status":"ok"}\n{"k":2,"status":"ok"}\n{"k":2,"status":"ok"}\n')
    go = lambda: ingest(spark, str(tmp_path / "in"), "k int, status string", ["k"], str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    stored = lambda: sorted(r.k for r in spark.read.parquet(str(tmp_path / "good")).collect())
    go()
    assert stored() == [1, 2]
    for name in os.listdir(tmp_path / "cp" / "good" / "commits"):
        os.remove(tmp_path / "cp" / "good" / "commits" / name)
    go()
    assert stored() == [1, 2]


def test_fuzzy_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    names = sorted({r.p_name for r in spark.read.parquet(f"{d}/part.parquet").select("p_name").collect()})
    got = {r.p_name: (r.target, r.score) for r in catalog.QUERIES["fuzzy_best_match"](spark, d).collect()}
    for n in names:
        asked = " ".join(reversed(n.split(" ")))
        score, target = min((-text.token_sort_ratio_of(asked, x), x) for x in names)
        assert (got[n][0], got[n][1]) == (target, pytest.approx(-score, abs=1e-3)) if -score >= 80 else n not in got


def test_letters_never_lose_a_match(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdé ß1"), size=rng.integers(1, 12))) for _ in range(50)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r.i: r.score for r in joins.best_match(df, df.select(F.col("i").alias("j"), F.col("w").alias("v")).where("j % 2 = 1"), "w", "v", "i", "j", 70.0).collect()}
    for i, w in enumerate(words):
        best = max(text.token_sort_ratio_of(w, v) for v in words[1::2])
        assert (got.get(i) == pytest.approx(best)) if best >= 70 else i not in got


def test_cascade_orders_ties_and_one_pass(spark):
    known = spark.createDataFrame([("T2", "ann lee", 2), ("T1", "ann lee", 1)], "target string, norm string, pos int")
    aliases = spark.createDataFrame([("Ann", "T2")], "name string, canonical string")
    names = spark.createDataFrame([("Ann", "ann lee"), ("Bo", "ann lees")], "name string, norm string")
    for order, want in ((("exact", "alias", "fuzzy"), "T1"), (("alias", "exact", "fuzzy"), "T2")):
        found = joins.cascade(names, known, aliases, order)
        assert {r.name: r.target for r in found.collect()} == {"Ann": want, "Bo": "T1"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_tiers_sign_audit_and_explanation():
    model = ranking.LinearRanker(("a", "b"), (1.0, -0.5), (1.0, 1.0), 0.0, 10)
    assert model.signs({"a": 1, "b": 1}) == [("a", 1.0, True), ("b", -0.5, False)]
    assert ranking.choose_tier({"top1": 0.3, "top3": 0.4}, {"top1": 0.4, "top3": 0.5}) == "C" and ranking.choose_tier({"top1": 0.3, "top3": 0.4}, {"top1": 0.4, "top3": 0.42}) == "B"
    assert ranking.keep_features({"top3": 0.1, "spearman": 0.0}) and not ranking.keep_features({"top3": 0.1, "spearman": -0.1})
    doc = '{"rankings":[{"rank":1,"player":"P","score":1.5,"top_contributing_features":[{"feature":"a_x","contribution":2.0},{"feature":"b","contribution":-0.5}]}]}'
    assert ranking.explain_prediction(doc, {"b": "tiers"}) == "1. P (+1.500) ↑ a x ↓ tiers"
    assert ranking.explain_prediction('{"error":"none"}', {}) == "none"


def test_names_and_periods(spark):
    df = spark.createDataFrame([("Łukasz&amp;Ø'Neil [1] (3)", 2023)], "s string, y int")
    got = df.select(text.normalize_name("s").alias("a"), text.normalize_award_name("s").alias("b"), text.unaccented("s").alias("c"), periods.international_year_in_period(F.lit("2022"), F.col("y"), F.lit("season")).alias("d"), numeric.gated(F.lit(None).cast("boolean"), F.lit(3)).alias("e")).first()
    assert got.a.startswith("lukasz oneil") and "(3)" not in got.b and got.c.startswith("Łukasz") and got.d and got.e == 0


def test_compare_feature_sets(spark):
    rng = np.random.default_rng(9)
    rows = [(y, f"k{i}", i + 1, float(rng.normal()), float(-i + rng.normal() * 0.1)) for y in range(5) for i in range(8)]
    df = spark.createDataFrame(rows, "y int, k string, rank int, a double, b double")
    got = {r.metric: r.change for r in ranking.compare_feature_sets(df, "y", ["rank"], "k", "rank", ["a"], ["b"]).collect()}
    assert got["spearman"] > 0.2 and set(got) == {"top1", "top3", "top5", "spearman", "kendall"}


def test_reports(spark):
    rows = [(2000, r, f"p{r}", "c", "n", float(100 - r), "ok" if r % 2 else "page_missing", "pre_merger", r) for r in range(1, 13)]
    df = spark.createDataFrame(rows, "award_year int, rank int, player_name_raw string, club_at_time string, nation_team string, points double, stats_status string, era_tag string, goals int")
    expected = spark.createDataFrame([(2000, "p1", "goals", 1.0), (2000, "p2", "goals", 9.0)], "award_year int, player_name_raw string, feature string, value double")
    text_ = reports.features_report(df, ["goals"], expected)
    assert "| 2000 | p1 | goals | 1.000 | 1.000 | True |" in text_ and "| 2000 | p2 | goals | 9.000 | 2.000 | False |" in text_
    assert "All checks pass." in reports.ground_truth_report(df, [2000]) and "missing_years" in reports.ground_truth_report(df, [1999, 2000])
    stats = spark.createDataFrame([("p1", "ok", [1], [2])], "player_name_raw string, status string, career_stats array<int>, international_stats array<int>")
    assert "poor" in reports.stats_report(df, stats)
    resolved = spark.createDataFrame([("a", "A", "exact", 100.0), ("b", "B", "fuzzy", 91.0), ("c", None, "failed", None)], "name string, target string, method string, score double")
    gaps = spark.createDataFrame([("c",)], "name string")
    assert reports.resolution_exit(resolved, gaps).first().passes and [r.name for r in reports.resolution_review(resolved).collect()] == ["c", "b"]
    assert "fuzzy" in reports.resolution_report(resolved, gaps) and "66.7%" in reports.matching_report(resolved)
    main = spark.createDataFrame([(2000, 1, "P1 [2]"), (2000, 2, "other")], "award_year int, rank int, player string")
    compared = reports.cross_verification(main, df, [2000])
    assert {(r["rank"], r.verdict) for r in compared.collect()} == {(1, "match"), (2, "mismatch"), (3, "main_missing")} and "main_missing" in reports.cross_report(compared)
    metrics = spark.createDataFrame([(0.3, 0.5, 0.6, 0.4, 0.3, 7)], "top1 double, top3 double, top5 double, spearman double, kendall double, n_years int")
    assert "30.0%" in reports.validation_report({"LOSO B": metrics, "LOSO C": metrics}) and reports.validation_report({"LOSO B": metrics, "LOSO C": metrics}).endswith("B\n")
    changes = spark.createDataFrame([("top3", 0.5, 0.6, 0.1), ("spearman", 0.4, 0.4, 0.0)], "metric string, base double, more double, change double")
    assert "+0.100" in reports.comparison_report(changes) and reports.comparison_report(changes).endswith("keep\n")


def test_the_library_without_its_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    say = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_ranking' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            os.remove(copy / name)
        subprocess.run([sys.executable, "-B", "-c", say], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_tables.py", "tests/test_functions.py", "-k", "not spans"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)
