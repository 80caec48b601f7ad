"""Joins: priority lookups, membership, substring, fuzzy and cascade matching, pairs within a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import periods
from rankloom.operators.fuzzy import similar_names
from rankloom.operators.substrings import holding
from rankloom.sources.shared import kept_table


def with_default(left: DataFrame, right: DataFrame, on: Sequence[str], column: str, default) -> DataFrame:
    """Left join of one attribute with a constant where it is missing."""
    out = left.join(right.select(*on, F.col(column).alias("_v")), list(on), "left")
    return out.withColumn(column, F.coalesce("_v", F.lit(default))).drop("_v")


def substring_match(left: DataFrame, right: DataFrame, on: Sequence[str], name: str, other: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First right row, in file order, of the same group whose name equals, holds or is held by the left one's.

    Distinct names meet through the index of :mod:`rankloom.operators.substrings`. Of
    right rows of one name only the first can be the first of a match, so each distinct
    left name gets one row before left rows are joined: rows of equal names never meet.
    """
    text = lambda c: F.lower(F.trim(F.col(c)))
    rest = [c for c in right.columns if c not in on]
    per_other = right.withColumn("b", text(other)).groupBy(*on, "b").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_right"))
    per_other = kept_table(per_other, "first-rows")
    names = kept_table(left.select(*on, text(name).alias("text")).distinct(), "names")
    found = holding(names, per_other.select(*on, F.col("b").alias("text")), on)
    place = F.struct(*(F.col(c) if c in on else F.col("_right")[c] for c in order))
    per_name = found.join(per_other, [*on, "b"]).groupBy(*on, "a").agg(F.min_by("_right", place).alias("_right"))
    met = left.withColumn("a", text(name)).join(per_name.hint("shuffle_hash"), [*on, "a"]).drop("a")  # never all rows of the left to each task
    return first_match(met.select("*", "_right.*").drop("_right"), key, order)


def few_substrings(left: DataFrame, right: DataFrame, on: Sequence[str], name: str, other: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As :func:`substring_match`, where a group's right rows are a handful by nature (a season's titles): they are tried one by one."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(other))
    met = left.join(right, list(on)).where((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))
    return first_match(met, key, order)


def first_match(met: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in met.columns if c not in key]
    first = met.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*key, "_first.*")


def first_substring(name: Column, entries: Sequence[str]) -> Column:
    """The first of a few literal entries that holds or is held by the name: a CASE, no join."""
    a = F.lower(F.trim(name))
    return reduce(lambda otherwise, x: F.when((a != "") & (F.contains(a, F.lit(x)) | F.contains(F.lit(x), a)), F.lit(x)).otherwise(otherwise), reversed(entries), F.lit(None).cast("string"))


def best_match(left: DataFrame, right: DataFrame, name: str, other: str, key: str, order: str, least: float = 90.0) -> DataFrame:
    """The right row of the highest token-sort ratio per left key (first in order among equals), if it reaches ``least``.

    Distinct names are matched once, through the index of :mod:`rankloom.operators.fuzzy`; the best row of each is an aggregate.
    """
    found = similar_names(left.select(F.col(name).alias("name")), right.select(F.col(other).alias("name")), least)
    best = F.min_by(F.struct(*right.columns), F.struct(-F.col("score"), F.col(order)))
    per_name = found.join(right, F.col("b") == F.col(other)).groupBy("a").agg(best.alias("_row"), F.max("score").alias("score"))
    met = left.join(per_name, F.col(name) == F.col("a")).select(*(left[c] for c in left.columns), "_row.*", "score")
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cascade(names: DataFrame, known: DataFrame, aliases: DataFrame, order: Sequence[str] = ("exact", "alias", "fuzzy"), least: float = 90.0) -> DataFrame:
    """name, target, method, score: each name by the first step that finds it.

    ``known``: target (unique), norm, pos. ``names``: name, norm. ``aliases``: name, canonical.
    Each step is a left join whose result counts for the names still open, so
    nothing is computed twice. Of targets with equal norms the first by pos counts.
    An alias without a known target needs a refetch; what no step finds has failed.
    """
    targets = known.groupBy("norm").agg(F.min_by("target", "pos").alias("_t"), F.min("pos").alias("_pos"))
    none = F.lit(None).cast("string")
    state = names.select("name", "norm", none.alias("target"), none.alias("method"), F.lit(None).cast("double").alias("score"))
    open_ = F.col("method").isNull()

    def taken(met: DataFrame, hit: Column, target: Column, method: Column, score: Column) -> DataFrame:
        now = open_ & hit
        return met.select("name", "norm", F.when(now, target).otherwise(F.col("target")).alias("target"), F.when(now, score).otherwise(F.col("score")).alias("score"), F.when(now, method).otherwise(F.col("method")).alias("method"))

    for step in order:
        if step == "exact":
            met = state.join(targets, "norm", "left")
            state = taken(met, F.col("_t").isNotNull(), F.col("_t"), F.lit("exact"), F.lit(100.0))
        elif step == "alias":
            said = aliases.groupBy("name").agg(F.min("canonical").alias("_c"))
            met = state.join(said, "name", "left").join(known.select(F.col("target").alias("_c"), F.lit(True).alias("_has")).distinct(), "_c", "left")
            has = F.coalesce("_has", F.lit(False))
            state = taken(met, F.col("_c").isNotNull(), F.when(has, F.col("_c")), F.when(has, "alias").otherwise("alias_needs_refetch"), F.lit(None).cast("double"))
        else:
            asked = state.where(open_).select(F.col("norm").alias("_asked")).distinct()
            found = best_match(asked, targets.withColumnRenamed("norm", "_norm"), "_asked", "_norm", "_asked", "_pos", least).select(F.col("_asked").alias("norm"), F.col("_t").alias("_found"), F.col("score").alias("_score"))
            met = state.join(found, "norm", "left")
            state = taken(met, F.col("_found").isNotNull(), F.col("_found"), F.lit("fuzzy"), F.col("_score"))
    return state.select("name", "target", F.coalesce("method", F.lit("failed")).alias("method"), "score")


def with_stats(candidates: DataFrame, stats: DataFrame, on: str, values: Sequence[str], status: str = "status", empty: str = "no_record") -> DataFrame:
    """Every candidate once: the values where its record's status is ok, nulls and the status elsewhere (J1, J2)."""
    held = stats.select(on, F.col(status).alias("stats_status"), *values)
    met = candidates.join(held, on, "left").withColumn("stats_status", F.coalesce("stats_status", F.lit(empty)))
    return met.withColumns({v: F.when(F.col("stats_status") == "ok", F.col(v)) for v in values} | {"has_stats": F.col("stats_status") == "ok"})


def with_fallbacks(left: DataFrame, right: DataFrame, on: Sequence[str], column: str, default="") -> DataFrame:
    """The right side's value, else the left's own, else ``default`` (J5)."""
    met = left.join(right.select(*on, F.col(column).alias("_v")), list(on), "left")
    own = [F.col(column)] if column in left.columns else []
    return met.withColumn(column, F.coalesce("_v", *own, F.lit(default))).drop("_v")


def with_eval_window(df: DataFrame, windows: DataFrame, on: str = "season_id") -> DataFrame:
    """The season's evaluation period, null where the season has none (J6). ``windows``: a row a season."""
    names = ["eval_period_type", "eval_period_start", "eval_period_end"]
    return df.drop(*names).join(windows.select(on, *names), on, "left")


def with_canonical(df: DataFrame, resolved: DataFrame, name: str) -> DataFrame:
    """``canonical``: the resolved title of each name, or the name itself (J7). ``resolved``: name, title."""
    return df.join(resolved.select(F.col("name").alias(name), "title"), name, "left").withColumn("canonical", F.coalesce("title", name)).drop("title")


def career_in_period(df: DataFrame, rows: str, season: str, year: str, kind: str) -> DataFrame:
    """A row per entry of the array of structs ``rows`` whose season falls into the evaluation period (J8)."""
    each = df.withColumn("_row", F.explode(rows))
    span = periods.season_years(F.col(f"_row.{season}"))
    return each.where(periods.season_in_period(span, F.col(year), F.col(kind))).withColumnRenamed("_row", "entry")


def international_in_period(df: DataFrame, rows: str, played: str, year: str, kind: str) -> DataFrame:
    """A row per entry of ``rows`` played in a year of the evaluation period (J9)."""
    each = df.withColumn("_row", F.explode(rows))
    return each.where(periods.international_year_in_period(F.col(f"_row.{played}"), F.col(year), F.col(kind))).withColumnRenamed("_row", "entry")


def league_seasons(df: DataFrame, stats: DataFrame, key: str, year: str, kind: str, season: str) -> DataFrame:
    """Rows of ``stats`` (key, season: the year it starts) in the seasons that each row's evaluation period covers (J10)."""
    asked = df.withColumn("_season", F.explode(periods.period_seasons(F.col(year), F.col(kind))))
    return asked.join(stats.withColumnRenamed(season, "_season"), [key, "_season"]).withColumnRenamed("_season", season)


def pairwise(df: DataFrame, group: Sequence[str], order: Sequence[str], key: str, features: Sequence[str], include_ties: bool = True, rank: str | None = None) -> DataFrame:
    """Both directions of every pair of a group: (difference, 1) from the better to the worse, (its negative, 0) back.

    Pairs are what a pairwise ranker learns from, so they grow with the square of
    a pool; pools are seasons' candidate lists, a few dozen rows each.
    """
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    rows = df.select(*group, key, n.alias("n"), *([rank] if rank and rank not in (*group, key) else []), *features)
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [F.col("a.n") < F.col("b.n")]
    if not include_ties and rank:
        on.append(F.col(f"a.{rank}") < F.col(f"b.{rank}"))
    diff = lambda s: [(s * (F.col(f"a.{x}") - F.col(f"b.{x}"))).alias(x) for x in features]
    one = F.struct(F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"), F.lit(1).alias("label"), *diff(1))
    two = F.struct(F.col(f"b.{key}").alias("first"), F.col(f"a.{key}").alias("second"), F.lit(0).alias("label"), *diff(-1))
    both = a.join(b, on).select(*[F.col(f"a.{g}").alias(g) for g in group], F.explode(F.array(one, two)).alias("p"))
    return both.select(*group, "p.*")


def compare_full(mine: DataFrame, main: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison: match, mismatch, mine_missing or main_missing per key."""
    a = mine.select(*on, F.col(value).alias("mine"))
    b = main.select(*on, F.col(value).alias("main"))
    verdict = F.when(F.col("mine").isNull(), "mine_missing").when(F.col("main").isNull(), "main_missing").when(F.col("mine") == F.col("main"), "match").otherwise("mismatch")
    return a.join(b, list(on), "full_outer").where("mine IS NOT NULL OR main IS NOT NULL").withColumn("verdict", verdict)


def folds(rows: DataFrame, year: str, kind: str = "loso") -> DataFrame:
    """Training rows of every fold: all other years, or only earlier ones."""
    years = F.broadcast(rows.select(F.col(year).alias("fold")).distinct())  # a row a year
    return rows.join(years, F.col(year) != F.col("fold") if kind == "loso" else F.col(year) < F.col("fold"))


def override(base: DataFrame, changes: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """What-if: cells named in changes (key, feature, value) replace the base's."""
    wide = changes.groupBy(*key).pivot("feature", list(features)).agg(F.first("value"))
    renamed = wide.select(*key, *[F.col(f).alias(f"_{f}") for f in features])
    out = base.join(renamed, list(key), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in features else F.col(c) for c in base.columns])


def what_if(base: DataFrame, changes: DataFrame, pool: str, key: str, features: Sequence[str]) -> DataFrame:
    """``base`` with the changed cells and the mid-rank percentiles ``<feature>_pct`` that follow from them.

    ``base``: pool, key, features and their percentiles as they are; ``changes``: key,
    feature, value. A changed cell moves every row of its pool by what it does between
    its old and its new value, so rows that don't change get their percentiles from
    the old ones and the pool's few changes; only the changed cells' own places are
    counted in their pool. Pools without a change are as they were.
    """
    cell = lambda f: F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), F.col(f"{f}_pct").alias("pct"))
    asked = changes.select(key, "feature", F.col("value").cast("double").alias("new"))
    own = base.join(asked.select(key).distinct(), key, "left_semi").select(pool, key, F.explode(F.array(*map(cell, features))).alias("c")).select(pool, key, "c.feature", F.col("c.v").alias("old"))
    changed = own.join(asked, [key, "feature"]).select(pool, key, "feature", "old", "new")
    events = changed.groupBy(pool, "feature").agg(F.collect_list(F.struct("old", "new")).alias("events"))  # the changes asked for in a pool
    touched = base.join(events.select(pool).distinct(), pool, "left_semi").select(pool, key, F.explode(F.array(*map(cell, features))).alias("c")).select(pool, key, "c.*")
    known = touched.groupBy(pool, "feature").agg(F.count("v").alias("known"))
    below = lambda x, y: F.when(x < y, F.lit(1.0)).when(x == y, F.lit(0.5)).otherwise(F.lit(0.0))
    total = lambda of: F.aggregate(F.col("events"), F.lit(0.0), lambda s, e: s + of(e))
    moved = lambda x: total(lambda e: F.when(e["new"].isNull(), F.lit(0.0)).otherwise(below(e["new"], x)) - F.when(e["old"].isNull(), F.lit(0.0)).otherwise(below(e["old"], x)))
    count = F.col("known") + total(lambda e: e["new"].isNotNull().cast("double") - e["old"].isNotNull().cast("double"))
    place = changed.where("new IS NOT NULL").select(pool, "feature", F.col(key).alias("_key"), "new").join(touched.where("v IS NOT NULL").select(pool, "feature", "v"), [pool, "feature"])
    place = place.groupBy(pool, "feature", F.col("_key").alias(key)).agg(F.sum(below(F.col("v"), F.col("new"))).alias("before"))
    long = touched.join(known, [pool, "feature"]).join(events, [pool, "feature"], "left").join(changed.select(key, "feature", "new", F.lit(True).alias("is_new")), [key, "feature"], "left").join(place, [pool, key, "feature"], "left")
    mid = F.when(F.col("is_new"), F.col("before") + moved(F.col("new"))).otherwise(F.col("pct") * F.col("known") + moved(F.col("v")))
    now = F.when(F.col("events").isNull(), F.col("pct")).when(F.coalesce(F.when(F.col("is_new"), F.col("new")), F.when(F.col("is_new").isNull(), F.col("v"))).isNotNull(), mid / count)
    told = long.select(pool, key, "feature", F.when(F.col("is_new"), F.col("new")).otherwise(F.col("v")).alias("v"), now.alias("pct"))
    wide = told.groupBy(pool, key).agg(*(F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{f}_{c}") for f in features for c in ("v", "pct")), F.lit(True).alias("_there"))
    out = base.join(wide, [pool, key], "left")
    fresh = {f: F.when(F.col("_there"), F.col(f"_{f}_v")).otherwise(F.col(f)) for f in features} | {f"{f}_pct": F.when(F.col("_there"), F.col(f"_{f}_pct")).otherwise(F.col(f"{f}_pct")) for f in features}
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in base.columns))


def resume_left(todo: DataFrame, *done: DataFrame, key: Sequence[str]) -> DataFrame:
    for d in done:
        todo = todo.join(d.select(*key), list(key), "left_anti")
    return todo


def in_years(df: DataFrame, year: str, years: Sequence[int], negate: bool = False) -> DataFrame:
    c: Column = F.col(year).isin(list(years))
    return df.where(~c if negate else c)
