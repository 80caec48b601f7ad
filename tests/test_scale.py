"""Operators whose work is spread over blocks, ranges and indexes, against plain in-memory versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import fit_listwise, solve_logistic
from rankloom.functions.text import token_sort_ratio_of
from rankloom.operators import aggregates, boosting, fuzzy, joins, pairs, ranking, sums, windows
from rankloom.sources.versions import VersionedTable


def pools(spark, years, n, seed=7, width=3):
    rng = np.random.default_rng(seed)
    rows = []
    for y in range(years):
        x = rng.normal(size=(n, width)).round(2)
        x[rng.random(x.shape) < 0.1] = np.nan
        order = np.argsort(-(2 * np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 1])), kind="stable")
        rank = np.empty(n, dtype=int)
        rank[order] = np.arange(1, n + 1)
        rows += [(y, f"p{i:03}", int(rank[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "y int, k string, rank int, a double, b double, c double")


def in_memory(df, features, cuts, rounds, keep=lambda y: True):
    pdf = df.withColumn("pool", F.xxhash64("y")).toPandas().sort_values(["y", "rank", "k"])
    pdf = pdf[pdf.y.map(keep)]
    hashes = {y: int(p) for y, p in zip(pdf.y, pdf.pool)}
    sampled = lambda r: np.concatenate([boosting.uniform(boosting.SEED, r, hashes[y], n) < 0.8 for y, n in pdf.groupby("y").size().items()])
    columns = lambda r: np.sort(np.random.default_rng([boosting.SEED, r]).choice(len(features), round(0.8 * len(features)), replace=False))
    score = fit_listwise(pdf[features].to_numpy(float), pdf["rank"].to_numpy(float), pdf.y.to_numpy(), sampled, columns, cuts, rounds)
    return dict(zip(zip(pdf.y, pdf.k), score))


def test_listwise_over_tasks_equals_one_in_memory(spark, monkeypatch):
    df, features = pools(spark, 12, 15), ["a", "b", "c"]
    cuts = boosting.feature_cuts(df, features)
    want = in_memory(df, features, cuts, 6)
    for keep, rows, direct in ((16, 50_000, 16), (2, 20, 2)):  # one task, and many tasks whose sums meet in groups, with states in between
        monkeypatch.setattr(boosting, "KEEP", keep)
        monkeypatch.setattr(boosting, "ROWS_A_TASK", rows)
        monkeypatch.setattr(sums, "DIRECT", direct)
        model = boosting.train_listwise(df.repartition(7), "y", "rank", "k", features, rounds=6)
        got = {(r.y, r.k): r.s for r in df.withColumn("s", model.score()).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_listwise_folds_are_fitted_together(spark):
    df, features = pools(spark, 5, 12), ["a", "b", "c"]
    cuts = boosting.feature_cuts(df, features)
    folds = [str(y) for y in range(5)]
    for kind, keep in (("loso", lambda f: lambda y: y != f), ("expanding", lambda f: lambda y: y < f)):
        models = boosting.fit_folds(df, "y", "rank", "k", features, folds, kind, cuts, rounds=4)
        for f, model in enumerate(models):
            if kind == "expanding" and f == 0:
                assert set(sum(model.leaves, ())) == {0.0}
                continue
            want = in_memory(df, features, cuts, 4, keep(f))
            got = {(r.y, r.k): r.s for r in df.withColumn("s", model.score()).collect()}
            assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-9)
    held = boosting.cross_validate_listwise(df, "y", "k", "rank", features, rounds=4).collect()
    assert len(held) == 60
    models = boosting.fit_folds(df, "y", "rank", "k", features, folds, "loso", cuts, rounds=4)
    one = {(r.y, r.k): r.s for r in df.withColumn("s", models[3].score()).where("y = 3").collect()}
    assert {(r.y, r.k): r.score for r in held if r.y == 3} == pytest.approx(one, abs=1e-12)


def test_listwise_model_is_saved_and_loaded(spark, tmp_path):
    df = pools(spark, 4, 8)
    model = ranking.train_listwise(df, "y", "rank", "k", ["a", "b", "c"], rounds=3)
    path = ranking.save_ranker(spark, model, f"file://{tmp_path}/model.json")
    assert ranking.load_ranker(spark, path) == model
    ranking.save_ranker(spark, model, path)  # replaced as a whole
    assert ranking.load_ranker(spark, path).features == ("a", "b", "c")
    none = ranking.train_listwise(df.where("y > 99"), "y", "rank", "k", ["a"], rounds=3)
    assert none.leaves == () and ranking.importance(none, ["a"]) == [("a", 0.0)]


def test_listwise_on_a_million_rows(spark):
    df = spark.range(1_000_000).select((F.col("id") % 4000).cast("int").alias("y"), F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("double").alias("b"))
    df = df.withColumn("rank", F.row_number().over(windows.Window.partitionBy("y").orderBy(F.desc(F.col("a") + 0.2 * F.col("b")), "k")))
    model = ranking.train_listwise(df, "y", "rank", "k", ["a", "b"], rounds=3)
    assert len(model.leaves) == 3 and ranking.importance(model, ["a", "b"])[0][0] == "a"
    assert df.select(F.corr(model.score(), -F.col("rank"))).first()[0] > 0.5


def test_blocks_of_pools_give_the_sums_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(y, f"k{i}", int(i + 1), *map(float, rng.normal(size=2) - 0.05 * i), 4.0) for y, n in ((1, 23), (2, 7), (3, 1), (4, 16)) for i in range(n)]
    df = spark.createDataFrame(rows, "y int, k string, rank int, a double, b double, same double")
    pdf = joins.pairwise(df, ["y"], ["rank"], "k", ["a", "b", "same"]).toPandas()
    for kind, folds in (("loso", (None,)), ("loso", (1, 2, 4)), ("expanding", (2, 3, 4))):
        for block in (2048, 5):
            for f, (scale, w, b, n) in zip(folds, pairs.fit_folds(df, "y", ["rank"], "k", ["a", "b", "same"], folds, kind, block=block)):
                train = pdf if f is None else pdf[pdf.y != f] if kind == "loso" else pdf[pdf.y < f]
                x = train[["a", "b", "same"]].to_numpy()
                deviation = np.where(x.std(axis=0) < 1e-12, 1, x.std(axis=0))
                want, intercept = solve_logistic(x / deviation, train.label.to_numpy(float))
                assert n == len(train) and scale == pytest.approx(deviation) and w == pytest.approx(want, abs=1e-6) and b == pytest.approx(intercept, abs=1e-6)
    empty = ranking.train_linear(df.where("y > 99"), "y", ["rank"], "k", ["a"])
    assert empty.coefficients == (0.0,) and empty.n_pairs == 0


def test_pair_sums_without_a_step_a_pair(monkeypatch):
    rng, exp, weighed = np.random.default_rng(14), np.exp, []
    for n, d, spread in ((5000, 3, 1.0), (5000, 3, 8.0), (900, 4, 400.0), (161, 2, 1.0), (1, 2, 1.0)):
        x, w = rng.normal(size=(n, d)) + 40, rng.normal(size=d)
        x, w = x[np.argsort(-(x @ w) - rng.normal(size=n), kind="stable")], w * spread
        weighed.clear()
        monkeypatch.setattr(np, "exp", lambda v: weighed.append(np.size(v)) or exp(v))
        whole, apart = pairs.pair_sums(x, x, w, True), pairs.pair_sums(x[: n // 3], x[n // 3 :], w, False) if n > 3 else None
        monkeypatch.setattr(np, "exp", exp)
        assert spread > 100 or sum(weighed) < 400 * n + 10**5
        for found, split in ((whole, None), (apart, n // 3)):
            if found is None:
                continue
            z, g, h = x - x.mean(axis=0), np.zeros(d), np.zeros((d, d))
            for i in range(n if split is None else split):
                diff = z[i] - z[i + 1 if split is None else split :]
                p = 1 / (1 + exp(-np.clip(diff @ w, -500, 500)))
                g += 2 * (p - 1) @ diff
                h += 2 * (diff.T * (p * (1 - p))) @ diff
            assert found[0] == pytest.approx(g, rel=1e-9, abs=1e-7) and found[1] == pytest.approx(h, rel=1e-8, abs=1e-6)


def test_a_few_blocks_of_much_work_are_dealt_to_tasks(spark):
    df = spark.range(12_000).select((F.col("id") % 6).cast("int").alias("y"), F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("a"))
    blocks = lambda: pairs.stored(pairs.packed_blocks(df, "y", ["a"], "k", ["a"], pairs.FIT_BLOCK).coalesce(1), "blocks")
    assert pairs.dealt(blocks(), 1).frame.rdd.getNumPartitions() == 1
    many = pairs.dealt(blocks(), 6).frame
    assert many.rdd.getNumPartitions() == 4 and many.agg(F.sum("n")).first()[0] == 12_000


def test_row_numbers_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(g, None if i % 11 == 0 else float(v), f"t{i}") for g, n in (("x", 900), (None, 300), ("z", 3)) for i, v in enumerate(rng.integers(0, 12, n))]
    df = spark.createDataFrame(rows, "g string, v double, t string")
    for per_range in (40, 10**6):
        order = [*windows.falling("v"), "t"]
        found = windows.row_numbers(df, ["g"], order, "n", per_range)
        got = {(r.g, r.t): r.n for r in found.collect()}
        for g in ("x", None, "z"):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
            assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))
        n = windows.ranged(df, ["g"], order, per_range).groupBy("g", "_range").count().collect()
        assert len(n) == 3 if per_range > 1000 else max(r["count"] for r in n) < 200 and len(n) > 20


def test_best_place_counts_what_stands_before(spark):
    rows = [("x", 5.0, "a", 0), ("x", 5.0, "b", 1), ("x", None, "c", 1), ("x", 9.0, "d", 0), ("y", None, "a", 1), ("y", None, "b", 0), (None, 1.0, "a", 1), ("w", 1.0, "a", 0)]
    df = spark.createDataFrame(rows, "g string, s double, t string, won int")
    assert {r.g: r.winner_at for r in windows.best_place(df, ["g"], "s", ["t"], F.col("won") == 1).collect()} == {"x": 3, "y": 1, None: 1}


def test_spearman_by_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [("x", float(a), float(b)) for a, b in rng.integers(0, 9, (200, 2))] + [("y", 1.0, 2.0), ("y", 1.0, 3.0), ("y", None, 9.0)]
    got = {r.g: r.spearman for r in windows.spearman(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b").collect()}
    rank = lambda v: np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])
    a, b = zip(*[r[1:] for r in rows if r[0] == "x"])
    assert got["x"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1]) and got["y"] is None


def test_kendall_with_few_values_leaves_them_out_of_tasks(spark):
    rng = np.random.default_rng(9)
    rows = [("x", float(a), float(b)) for a, b in zip(rng.integers(0, 16, 700), rng.normal(size=700))]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    a, b = (np.array(v) for v in zip(*[r[1:] for r in rows]))
    u, v = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    (got,) = windows.kendall(df, ["g"], "a", "b", 100).collect()
    assert got.kendall == pytest.approx((u * v).sum() / np.sqrt(np.abs(u).sum() * np.abs(v).sum()))


@pytest.mark.parametrize("least", [55.0, 70.0, 80.0, 90.0, 100.0])
def test_the_gram_index_loses_no_pair(spark, least):
    rng = np.random.default_rng(int(least))
    words = ["".join(rng.choice(list("abcdé ß"), size=rng.integers(0, 13))) for _ in range(80)]
    words += ["".join(c for c in w if rng.random() > 0.12) for w in words] + ["", " ", "a  b", "b a"]
    left, right = (spark.createDataFrame([(w,) for w in ws] + [(None,)], "name string") for ws in (words, words[::2]))
    got = {(r.a, r.b): r.score for r in fuzzy.similar_names(left, right, least).collect()}
    want = {(a, b): s for a in set(words) for b in set(words[::2]) if (s := token_sort_ratio_of(a, b)) >= least}
    assert got == pytest.approx(want)
    assert fuzzy.candidates(left.dropna().distinct(), right.dropna().distinct(), least).count() < len(set(words)) * len(set(words[::2])) * (0.95 if least < 60 else 0.5 if least < 85 else 0.15)


def test_bounds_of_the_index():
    with pytest.raises(ValueError):
        fuzzy.Bounds(0)
    assert fuzzy.Bounds(90).long == 3 and fuzzy.Bounds(60).long is None and math.isclose(fuzzy.common(90.0, 20), 9)


def test_names_that_hold_each_other(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("ab c"), size=rng.integers(0, 6)))
    left = [(i, int(i % 3), word() if i % 9 else None) for i in range(120)]
    right = [(i, int(i % 4), word().upper() if i % 7 else None) for i in range(90)]
    a = spark.createDataFrame(left, "i int, g int, name string")
    b = spark.createDataFrame(right, "line int, g int, other string")
    want = {}
    for i, g, name in left:
        for line, h, other in right:
            x, y = (name or "").strip(" ").lower(), (other or "").strip(" ").lower()
            if g == h and x and y and (x in y or y in x):
                want.setdefault(i, (line, other))
    for match in (joins.substring_match, joins.few_substrings):
        got = {r.i: (r.line, r.other) for r in match(a, b, ["g"], "name", "other", ["i"], ["line"]).collect()}
        assert got == want and len(want) > 20


def test_rows_of_equal_names_never_meet(spark, monkeypatch):
    names = F.element_at(F.array(*map(F.lit, ("hot bolt", " Hot Bolt", "bolt", "ring", ""))), (F.col("id") % 5 + 1).cast("int"))
    left = spark.range(3000).select(F.col("id").alias("i"), F.lit(1).alias("g"), names.alias("name"))
    right = spark.range(3000).select((3000 - F.col("id")).alias("line"), F.lit(1).alias("g"), names.alias("other"))
    met, first_match = [], joins.first_match
    monkeypatch.setattr(joins, "first_match", lambda df, *args: met.append(df) or first_match(df, *args))
    got = {r.i: (r.line, r.other) for r in joins.substring_match(left, right, ["g"], "name", "other", ["i"], ["line"]).collect()}
    lines = sorted((3000 - i, ("hot bolt", " Hot Bolt", "bolt", "ring", "")[i % 5]) for i in range(3000))
    first = {want: next(x for x in lines if x[1].strip().lower() in want) for want in (("bolt", "hot bolt"), ("ring",))}
    assert got == {i: first["ring",] if i % 5 == 3 else first["bolt", "hot bolt"] for i in range(3000) if i % 5 < 4}
    assert met[0].count() <= 3000


def test_what_if_equals_a_full_recomputation(spark):
    rng = np.random.default_rng(8)
    rows = [(p, f"{p}{i}", *(None if rng.random() < 0.15 else float(v) for v in rng.integers(0, 12, 2))) for p in "xyz" for i in range(40)]
    full = lambda rows: windows.midrank_by_ranges(windows.midrank_by_ranges(spark.createDataFrame(rows, "pool string, k string, a double, b double"), ["pool"], "a", "a_pct"), ["pool"], "b", "b_pct")
    new = {("x1", "a"): 3.0, ("x1", "b"): None, ("x2", "a"): 11.0, ("x9", "a"): None, ("x30", "b"): 0.0, ("y5", "b"): 5.0, ("y6", "b"): 5.0}
    changes = spark.createDataFrame([(k, f, v) for (k, f), v in new.items()], "k string, feature string, value double")
    told = joins.what_if(full(rows), changes, "pool", "k", ["a", "b"]).collect()
    after = [(p, k, new.get((k, "a"), a), new.get((k, "b"), b)) for p, k, a, b in rows]
    want = {r.k: (r.a, r.b, r.a_pct, r.b_pct) for r in full(after).collect()}
    assert len(told) == 120
    for r in told:
        assert (r.a, r.b) == want[r.k][:2] and (r.a_pct, r.b_pct) == tuple(x if x is None else pytest.approx(x) for x in want[r.k][2:])


def test_order_statistics_of_any_values(spark):
    rng = np.random.default_rng(10)
    lists = [rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000), np.repeat([5.0, -1.0], [900, 3]), np.arange(2000.0), np.array([0.0, 1e-300, -1e300, 7.0]), -(2.0 ** rng.normal(size=500))]
    for values in lists:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        places = [0, len(values) // 3, len(values) // 2, len(values) - 1]
        assert aggregates.order_statistics(df, "x", places) == [float(np.sort(values)[p]) for p in places]
    whole = spark.createDataFrame([(v,) for v in (3, 1, 2, 2, 9)], "x long")
    assert aggregates.order_statistics(whole, "x", [0, 2, 4]) == [1, 2, 9] and aggregates.order_statistics(whole.where("x > 99"), "x", [0]) == [None]


def test_versions_merge_and_no_writer_loses_rows(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    root = f"file://{tmp_path}/t"
    one, two = VersionedTable(spark, root, ["k"]), VersionedTable(spark, root, ["k"])
    assert one.current() == 0
    with pytest.raises(FileNotFoundError):
        one.read()
    assert one.add(rows((1, "a"), (2, "b"))) == 1
    current = one.current
    behind = iter([1])  # the first writer has seen version 1 when the second one is done
    monkeypatch.setattr(one, "current", lambda: next(behind, None) or current())
    assert two.add(rows((3, "c"), (1, "new"))) == 2
    assert one.add(rows((4, "d"))) == 3
    read = lambda version=None: {r.k: r.v for r in two.read(version).collect()}
    assert read() == {1: "new", 2: "b", 3: "c", 4: "d"} and read(1) == {1: "a", 2: "b"}
    assert two.compact() == 4 and read() == {1: "new", 2: "b", 3: "c", 4: "d"} and len(two.parts(4)) == 1 and two.versions() == [1, 2, 3, 4]
    plain = VersionedTable(spark, f"file://{tmp_path}/u")
    plain.add(rows((1, "a")))
    plain.add(rows((1, "a")))
    assert plain.read().count() == 2


def test_ingest_reads_nothing_that_is_stored(spark, tmp_path):
    import shutil

    from rankloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    go = lambda: ingest(spark, str(tmp_path / "in"), "k int, status string", ["k"], str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    (tmp_path / "in" / "a.json").write_text('{"k":1,"status":"ok"}\n{"k":2,"status":"ok"}\n')
    go()
    shutil.rmtree(tmp_path / "good")
    (tmp_path / "in" / "b.json").write_text('{"k":2,"status":"ok"}\n{"k":3,"status":"ok"}\n{"k":4,"status":"gone"}\n')
    go()
    assert [r.k for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [3] and [r.k for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [4]


def test_pair_accuracy_over_blocks(spark):
    rng = np.random.default_rng(12)
    rows = [(y, f"k{i:02}", int(i + 1), float(v)) for y, n in ((1, 23), (2, 6), (3, 1)) for i, v in enumerate(rng.integers(0, 9, n))]
    df = spark.createDataFrame(rows, "y int, k string, rank int, a double")
    for intercept in (0.0, 0.5, -1.5):
        model = ranking.LinearRanker(("a",), (-1.0,), (2.0,), intercept, 0)
        right = [d for y in (1, 2) for p in rows for q in rows if p[0] == q[0] == y and p[2] < q[2] for d in ((q[3] - p[3]) / 2 + intercept > 0, not (p[3] - q[3]) / 2 + intercept > 0)]
        assert ranking.pair_accuracy(df, "y", ["rank"], "k", model) == pytest.approx(sum(right) / len(right))
        assert pairs.accuracy(df, "y", ["rank"], "k", -F.col("a") / 2, intercept, block=4) == pytest.approx(sum(right) / len(right))
    assert ranking.pair_accuracy(df.where("y = 3"), "y", ["rank"], "k", model) is None
