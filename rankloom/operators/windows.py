"""Window-type operators: within-pool ranks and strictly lagged history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.shared import kept_table


def midrank_percentile(value: Column, part: Sequence[str]) -> Column:
    """(less + equal / 2) / known within the pool; null stays null and is not counted."""
    own = Window.partitionBy(*part)
    upto = F.count(value).over(own.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.count(value).over(Window.partitionBy(*part, value))
    return F.when(value.isNotNull(), (upto - 0.5 * ties) / F.count(value).over(own))


def value_counts_by_ranges(df: DataFrame, part: Sequence[str], value: str, weight: str | None = None, ranges: int = 64) -> DataFrame:
    """part, value and how many known values of the pool are less (``_less``), equal (``_equal``) and there at all (``_all``), for pools of any size.

    Equal values are counted first (rows count ``weight`` each) and stored, so ``df`` is
    read once. Each pool's distinct values are cut at their quantiles into ranges, which
    are summed up in tasks of their own; the ranges' totals (a few dozen rows a pool)
    give each its start. So no task sorts a whole pool.
    """
    known = df.where(F.col(value).isNotNull())
    cuts = [i / ranges for i in range(1, ranges)]
    counts = kept_table(known.groupBy(*part, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_eq")), "value-counts")
    bounds = counts.groupBy(*part).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, cuts, 1000))).alias("_cuts"))
    ranged_ = counts.join(bounds, list(part)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    inside = F.sum("_eq").over(Window.partitionBy(*part, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pool = Window.partitionBy(*part)
    start = F.coalesce(F.sum("_n").over(pool.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged_.groupBy(*part, "_range").agg(F.sum("_eq").alias("_n")).select(*part, "_range", start.alias("_start"), F.sum("_n").over(pool).alias("_all"))
    placed = ranged_.select(*part, value, "_range", "_eq", inside.alias("_upto")).join(starts, [*part, "_range"])
    return placed.select(*part, value, (F.col("_start") + F.col("_upto") - F.col("_eq")).alias("_less"), F.col("_eq").alias("_equal"), "_all")


def midrank_by_ranges(df: DataFrame, part: Sequence[str], value: str, name: str, ranges: int = 64) -> DataFrame:
    """``df`` with the mid-rank percentile of ``value`` within ``part``, for pools of any size (see :func:`value_counts_by_ranges`)."""
    found = value_counts_by_ranges(df, part, value, None, ranges).select(*part, value, ((F.col("_less") + 0.5 * F.col("_equal")) / F.col("_all")).alias(name))
    return df.join(found, [*part, value], "left")


def first_by_priority(df: DataFrame, key: Sequence[str], priority: Column, ties: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(priority.asc_nulls_last(), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def priority_of(c: Column, order: Sequence[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, F.lit(i)).otherwise(out)
    return out


def before(key: Sequence[str], time: str):
    """Rows of the same key with a strictly smaller time; rows of the same time never see each other."""
    return Window.partitionBy(*key).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)


def prior_count(pred: Column, key: Sequence[str], time: str) -> Column:
    return F.coalesce(F.sum(F.when(pred, 1).otherwise(0)).over(before(key, time)), F.lit(0))


def prior_any(pred: Column, key: Sequence[str], time: str) -> Column:
    return prior_count(pred, key, time) > 0


def prior_times(key: Sequence[str], time: str) -> Column:
    return F.size(F.coalesce(F.collect_set(time).over(before(key, time)), F.array())).cast("long")


def years_since(pred: Column, key: Sequence[str], time: str, never: int = 999) -> Column:
    last = F.max(F.when(pred, F.col(time))).over(before(key, time))
    return F.coalesce(F.col(time) - last, F.lit(never))


def years_since_new_winner(df: DataFrame, key: str, time: str, won: Column, origin: int = 1956, part: Sequence[str] = ()) -> DataFrame:
    """part, time, years: the gap to the last earlier year in which somebody won for the first time; one row a year and part."""
    per = df.groupBy(*part, key, time).agg(F.bool_or(won).alias("_won"))
    first = F.min(F.when(F.col("_won"), F.col(time))).over(Window.partitionBy(*part, key))
    years = per.select(*part, time, (F.col("_won") & (F.col(time) == first)).alias("_new")).groupBy(*part, time).agg(F.bool_or("_new").alias("new"))
    w = Window.partitionBy(*part).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)  # a row a year: small by nature
    last = F.max(F.when(F.col("new"), F.col(time))).over(w)
    return years.select(*part, time, (F.col(time) - F.coalesce(last, F.lit(origin))).alias("years_since_new_winner"))


def group_prior_count(df: DataFrame, part: Sequence[str], time: str, won: Column, name: str) -> DataFrame:
    """part, time and how many wins the group has had before: counted per time first, so a group is as many rows as times.

    A group without a name is no group: rows in which a ``part`` column is null are left out.
    """
    per = df.dropna(subset=list(part)).groupBy(*part, time).agg(F.count_if(won).alias("_won"))
    return per.select(*part, time, F.coalesce(F.sum("_won").over(before(part, time)), F.lit(0)).cast("long").alias(name))


def predicted_rank(part: Sequence[str], score: str, ties: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*part).orderBy(F.col(score).desc(), *ties))


def top_k(df: DataFrame, part: Sequence[str], score: str, ties: Sequence[str], k: int) -> DataFrame:
    return df.withColumn("predicted_rank", predicted_rank(part, score, ties)).where(F.col("predicted_rank") <= k)


def first_rise(df: DataFrame, part: Sequence[str], order: str, value: str) -> DataFrame:
    """The first place of each group where a value grows down the ranks."""
    w = Window.partitionBy(*part).orderBy(order)
    rises = df.withColumn("next_value", F.lead(value).over(w)).where(F.col("next_value") > F.col(value))
    return rises.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


PER_RANGE = 1_000_000  # rows of a pool that one task sorts, about
SAMPLE = 64  # sampled rows for each range


def falling(c: str) -> list[Column]:
    """Largest first, nulls last, as ascending columns."""
    return [F.col(c).isNull(), -F.col(c)]


def same_pool(left: DataFrame, right: DataFrame, part: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[p].eqNullSafe(right[f"_of_{p}"]) for p in part])


def ranged(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], per_range: int = PER_RANGE, most: int = 256) -> DataFrame:
    """``df`` with ``_range``: pools above ``per_range`` rows are cut at sampled bounds of the whole sort key, others are one range.

    ``order`` is ascending, ties included. Bounds are broadcast: two for each ``per_range`` rows of the table at most.
    """
    parts, key = list(part), F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)))
    of = [F.col(p).alias(f"_of_{p}") for p in parts]
    sizes = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > per_range)
    big = F.broadcast(sizes.select(*of, "_size", F.least(F.ceil(F.col("_size") / per_range), F.lit(most)).cast("int").alias("_ranges")))
    keys = df.select(*parts, key.alias("_key"))
    sampled = keys.join(big, same_pool(keys, big, parts)).where(F.pmod(F.xxhash64("_key"), F.col("_size")) < SAMPLE * F.col("_ranges"))
    drawn = sampled.groupBy(*(f"_of_{p}" for p in parts)).agg(F.array_sort(F.collect_list("_key")).alias("_drawn"), F.max("_ranges").alias("_ranges"))  # SAMPLE x most rows a pool, about
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_ranges") - 1, F.lit(1))), lambda i: F.get("_drawn", F.floor(i * F.size("_drawn") / F.col("_ranges")).cast("int")))
    bounds = F.broadcast(drawn.select(*(f"_of_{p}" for p in parts), F.array_distinct(at).alias("_bounds")))
    met = df.join(bounds, same_pool(df, bounds, parts), "left")
    return met.select(*df.columns, F.coalesce(F.size(F.filter("_bounds", lambda b: b < key)), F.lit(0)).alias("_range"))


def row_numbers(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], name: str, per_range: int = PER_RANGE) -> DataFrame:
    """``df`` with the row's number in its pool by ``order`` (ascending, unique): numbers within a range and the rows of the ranges before it."""
    parts = list(part)
    rows = ranged(df, parts, order, per_range)
    sizes = rows.groupBy(*parts, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before_ = F.sum("_size").over(Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a few hundred rows a pool
    starts = sizes.select(*(F.col(p).alias(f"_of_{p}") for p in parts), F.col("_range").alias("_at"), F.coalesce(before_, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*parts, "_range").orderBy(*order))
    numbered = rows.withColumn("_inside", inside)
    met = numbered.join(starts, same_pool(numbered, starts, parts) & (F.col("_range") == F.col("_at")))
    return met.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def best_place(df: DataFrame, part: Sequence[str], score: str, ties: Sequence[str], won: Column, name: str = "winner_at") -> DataFrame:
    """The place of each pool's best placed winner by score, largest first: how many rows stand before it, counted without sorting."""
    key = F.struct(*falling(score), *ties)
    best = df.where(won).groupBy(*part).agg(F.min(key).alias("_best")).select(*(F.col(p).alias(f"_of_{p}") for p in part), "_best")  # a row a pool
    met = df.select(*part, key.alias("_key")).join(best, reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_of_{p}")) for p in part]))
    return met.groupBy(*part).agg((F.count_if(F.col("_key") < F.col("_best")) + 1).alias(name))


def spearman(df: DataFrame, part: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation within each pool, null where one side is constant; only rows that have both values count.

    Equal pairs are counted first and stored; average ranks come from ranges of the values, so no task sorts a pool.
    """
    rows = df.select(*part, F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    counted = kept_table(rows.groupBy(*part, "_a", "_b").agg(F.count(F.lit(1)).alias("_n")), "value-pairs")
    ranked = counted
    for c in ("_a", "_b"):
        found = value_counts_by_ranges(counted, part, c, "_n").select(*part, c, (F.col("_less") + (F.col("_equal") + 1) / 2).alias(f"{c}r"))
        ranked = ranked.join(found, [*part, c])
    n, x, y = F.sum("_n"), F.col("_ar"), F.col("_br")
    mean = lambda v: F.sum(F.col("_n") * v) / n
    middle = ranked.groupBy(*part).agg(mean(x).alias("_mx"), mean(y).alias("_my"))  # first the means, so that nothing cancels
    off = ranked.join(middle, list(part)).withColumns({"_x": x - F.col("_mx"), "_y": y - F.col("_my")})
    total = lambda v: F.sum(F.col("_n") * v)
    return off.groupBy(*part).agg(F.try_divide(total(F.col("_x") * F.col("_y")), F.sqrt(total(F.col("_x") * F.col("_x")) * total(F.col("_y") * F.col("_y")))).alias("spearman"))


def inversions(b: np.ndarray) -> int:
    """Pairs i < j with b[i] > b[j], by merging runs of doubling width, a sort a level."""
    n, wrong, width = len(b), 0, 1
    while width < n:
        run = np.arange(n) // width
        pair, left = run // 2, 1 - run % 2
        by = np.lexsort((1 - left, b, pair))  # equal values: the left run's first, they are no inversions
        lefts = np.bincount(pair, weights=left).astype(np.int64)
        upto = np.cumsum(left[by]) - (np.cumsum(lefts) - lefts)[pair[by]]
        wrong += int((lefts[pair[by]] - upto)[left[by] == 0].sum())
        b = b[by]
        width *= 2
    return wrong


def tied_pairs(*columns: np.ndarray) -> int:
    n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)[1].astype(np.int64)
    return int((n * (n - 1) // 2).sum())


def balance(a: np.ndarray, b: np.ndarray) -> int:
    """Concordant less discordant pairs; pairs tied in either are neither."""
    if len(a) < 2:
        return 0
    order = np.lexsort((b, a))
    return len(a) * (len(a) - 1) // 2 - tied_pairs(a) - tied_pairs(b) + tied_pairs(a, b) - 2 * inversions(b[order])


STRIP = 250_000  # rows of a pool that one task compares


def kendall(df: DataFrame, part: Sequence[str], a: str, b: str, strip: int = STRIP) -> DataFrame:
    """Tie-corrected tau-b within each pool, n log n; null where one side is constant.

    Pools above ``strip`` rows are cut at quantiles of both sides; a quantile's own
    value is a strip, so frequent values don't share one. A pair lies in one strip
    of a, in one strip of b, or in neither: strips are counted in tasks of their
    own (those of one value hold ties only and go to no task), pairs that share both
    strips are taken off once, and all others follow from the numbers of rows in
    the grid of strips.
    """
    keys = list(part)
    rows = df.select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_a", [i / 64 for i in range(1, 64)], 1000).alias("_qa"), F.percentile_approx("_b", [i / 64 for i in range(1, 64)], 1000).alias("_qb"))
    upto = lambda c, q: F.size(F.filter(F.array_distinct(q), lambda x: x < F.col(c))) + F.size(F.filter(F.array_distinct(q), lambda x: x <= F.col(c)))  # noqa: E731  odd: a quantile's own value
    cut = lambda c, q: F.when(F.col("_n") > strip, upto(c, q)).otherwise(F.lit(0))
    placed = rows.join(sizes, keys).select(*keys, "_a", "_b", cut("_a", "_qa").alias("_sa"), cut("_b", "_qb").alias("_sb"), (F.col("_n") > strip).alias("_cut"))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _s long"
    first = lambda pdf: [pdf[k].iloc[0] for k in keys]

    def strips(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["_a"].to_numpy(), pdf["_b"].to_numpy()
        s = balance(x, y)
        if pdf["_role"].iloc[0]:  # pairs of one strip of a as well are counted there
            s -= sum(balance(g["_a"].to_numpy(), g["_b"].to_numpy()) for _, g in pdf.groupby("_sa"))
        return pd.DataFrame([[*first(pdf), s]], columns=[*keys, "_s"])

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((130, 130), dtype=object)  # whole numbers of any size
        n[pdf["_sa"], pdf["_sb"]] = [int(x) for x in pdf["n"]]
        above = np.cumsum(n, axis=0) - n  # rows of lesser strips of a, by strip of b
        upto = np.cumsum(above, axis=1)
        s = int((n * ((upto - above) - (upto[:, -1:] - upto))).sum())
        return pd.DataFrame([[*first(pdf), s]], columns=[*keys, "_s"])

    role = F.explode(F.when(F.col("_cut"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    dealt = placed.select(*keys, "_a", "_b", "_sa", "_sb", role.alias("_role")).withColumn("_strip", F.when(F.col("_role") == 0, F.col("_sa")).otherwise(F.col("_sb")))
    dealt = dealt.where(F.col("_strip") % 2 == 0)
    inside = dealt.groupBy(*keys, "_role", "_strip").applyInPandas(strips, schema)
    across = placed.where("_cut").groupBy(*keys, "_sa", "_sb").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).applyInPandas(grid, schema)
    total = inside.unionByName(across).groupBy(*keys).agg(F.sum("_s").alias("_s"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    ties = lambda c, name: rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(pairs(F.col("_c")).alias(name))
    all_ = sizes.select(*keys, (F.col("_n") * (F.col("_n") - 1) / 2).alias("_p"))
    met = total.join(all_, keys).join(ties("_a", "_ta"), keys).join(ties("_b", "_tb"), keys)
    return met.select(*keys, F.try_divide(F.col("_s"), F.sqrt((F.col("_p") - F.col("_ta")) * (F.col("_p") - F.col("_tb")))).alias("kendall"))
