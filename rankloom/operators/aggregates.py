"""Aggregations: null-preserving sums, coverage matrices, gaps and data-quality checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.shared import stored


def known_sums(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of what is known (null if nothing is) and how many rows there were."""
    return df.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values), F.count(F.lit(1)).alias("n_rows"))


def array_sums(rows: str, keep, values: Sequence[str], name: str) -> list:
    """Per-row sums over an array of structs, for those entries that ``keep`` accepts; names in first-seen order."""
    kept = F.filter(rows, keep)
    total = lambda v: F.aggregate(F.filter(F.transform(kept, lambda x: x[v].cast("bigint")), lambda x: x.isNotNull()), F.lit(None).cast("bigint"), lambda a, x: F.coalesce(a, F.lit(0)) + x)
    return [*(total(v).alias(v) for v in values), F.array_distinct(F.filter(F.transform(kept, lambda x: x[name]), lambda x: x.isNotNull())).alias(f"{name}s"), F.size(kept).cast("long").alias("n_matched")]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


BINS = 1024


def order_statistics(df: DataFrame, value: str, places: Sequence[int]) -> list:
    """The values at these places (from 0) of all known values in order, exactly, by narrowing histograms.

    A round counts the values of an interval in at most BINS bins with each bin's
    least and most; the bin that holds the place is the next interval, until it is one
    value. Wide intervals are cut by sign and by powers, so a few rounds do for any
    doubles. The driver gets the bins, and no task gets all distinct values.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    x = F.col("v").cast("double")
    first = known.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()

    def bin_of(low, high) -> Column:
        a, b = float(low), float(high)
        if a < 0 < b or (a == 0 and b > 0) or (a < 0 and b == 0):
            return F.signum(x)
        size = F.abs(x)
        least, most = sorted((abs(a), abs(b)))
        scaled, base, span = (F.log2(size), math.log2(least), math.log2(most) - math.log2(least)) if most > 4 * least else (size, least, most - least)
        at = F.greatest(F.least(F.floor((scaled - base) * (BINS / span)), F.lit(BINS - 1)), F.lit(0))
        return -at if a < 0 else at

    found = {}
    waiting = {(first.low, first.high, 0): sorted(set(places))} if first.low is not None else {}
    while waiting:
        following: dict = {}
        for (low, high, start), wanted in waiting.items():
            if low == high:
                found |= dict.fromkeys(wanted, low)
                continue
            inside = known.where((F.col("v") >= low) & (F.col("v") <= high))
            bins = inside.groupBy(bin_of(low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for r in sorted(bins, key=lambda r: r.low):
                here = [p for p in wanted if start <= p < start + r.n]
                if here:
                    following[r.low, r.high, start] = here
                start += r.n
        waiting = following
    return [found.get(p) for p in places]


def sizes(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """least, median, most, mean and number of the groups' sizes; the median is exact."""
    held = stored(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select("n"), "sizes")
    try:
        r = held.frame.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count(F.lit(1)).alias("groups")).first()
        middle = order_statistics(held.frame, "n", [(r.groups - 1) // 2, r.groups // 2]) if r.groups else []
    finally:
        held.dropped()
    median = sum(middle) / 2 if middle else None
    return df.sparkSession.createDataFrame([(r.least, median, r.most, r.mean, r.groups)], "least long, median double, most long, mean double, groups long")


def coverage(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """feature, group (null: all), percent of rows in which the feature is known (or true, if boolean)."""
    flags = dict(df.dtypes)
    has = {c: (F.coalesce(F.col(c), F.lit(False)) if flags[c] == "boolean" else F.col(c).isNotNull()).cast("int") for c in columns}
    sums = df.select(by, *(e.alias(c) for c, e in has.items())).rollup(by).agg(F.grouping(by).alias("_all"), F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(100 * F.col(c) / F.col("_n"), 4).alias("percent")) for c in columns)))
    return sums.select(F.when(F.col("_all") == 0, F.col(by).cast("string")).alias("grp"), rows.alias("f")).select("f.feature", "grp", "f.percent")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rank_gaps(df: DataFrame, group: Sequence[str], rank: str, most: int = 10) -> DataFrame:
    """group, n, max_rank, n_missing and the first ``most`` missing ranks of 1..max_rank.

    Neighbouring distinct ranks tell the gaps, so neither all ranks nor all missing ones meet in a row.
    """
    r = F.col(rank).cast("long")
    rows = df.groupBy(*group, r.alias("_r")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.lag("_r").over(Window.partitionBy(*group).orderBy("_r")), F.lit(0))
    gaps = rows.select(*group, "_r", "_c", before.alias("_before")).withColumn("_gap", F.greatest(F.col("_r") - F.col("_before") - 1, F.lit(0)))
    run = F.when(F.col("_gap") > 0, F.sequence(F.col("_before") + 1, F.col("_before") + F.least("_gap", F.lit(most))))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_r"))
    some = gaps.where("_gap > 0").withColumn("_k", place).where(F.col("_k") <= most)
    listed = some.select(*group, run.alias("_run")).groupBy(*group).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_run"))), 1, most).alias("missing"))  # ``most`` runs a group
    sums = gaps.groupBy(*group).agg(F.sum("_c").alias("n"), F.max("_r").alias("max_rank"), F.sum("_gap").alias("n_missing"))
    return sums.join(listed, list(group), "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<bigint>")))


def known_sums_and_sets(df: DataFrame, key: Sequence[str], values: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """As :func:`known_sums`, with the sorted distinct known values of ``sets`` (a key's leagues or teams: a handful)."""
    return df.groupBy(*key).agg(*(F.sum(v).alias(v) for v in values), *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in sets), F.count(F.lit(1)).alias("n_rows"))


def records_by_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, records: the rows of each key as an array of structs, in their own order.

    For keys that own few rows by nature (a player's seasons); a join serves the others.
    """
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("records"))


def frequencies(df: DataFrame, items: str, name: str = "item") -> DataFrame:
    """How often each element of an array column occurs, most common first."""
    return value_counts(df.select(F.explode(items).alias(name)), name)


def inverse_frequency(df: DataFrame, column: str) -> DataFrame:
    """column, n, inverse: total / count of each value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.join(F.broadcast(total)).select(column, "n", (F.col("_total") / F.col("n")).alias("inverse"))  # one row


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, counts: a map from each value of ``inner`` to its count (few distinct values)."""
    n = df.where(F.col(inner).isNotNull()).groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string"), "n")))).alias("counts"))


def array_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per array column the sum of lengths and how many rows have any element; one row."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return df.agg(*(F.sum(F.greatest(size(c), F.lit(0))).alias(f"{c}_total") for c in columns), *(F.count_if(size(c) > 0).alias(f"{c}_rows") for c in columns))


def head_and_more(df: DataFrame, group: Sequence[str], item: str, most: int = 20) -> DataFrame:
    """group, items (the first ``most`` in order), more: how many are left out of the detail list."""
    w = Window.partitionBy(*group).orderBy(item)
    some = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return some.join(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_all")), list(group)).select(*group, "items", F.greatest(F.col("_all") - most, F.lit(0)).alias("more"))


def without_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose season, club or team says total or career are sums of other rows and go."""
    said = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).rlike("total|career"), F.lit(False)) for c in columns])
    return df.where(~said)


def parsed_or_skipped(df: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows in which all of ``needed`` are known, and one row: skipped, the number of the others."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in needed])
    return df.where(~bad), df.agg(F.count_if(bad).alias("skipped"))


def in_schema_order(df: DataFrame, schema: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the list's order."""
    return df.select([c for c in schema if c in df.columns])


def without_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def era_gated(df: DataFrame, year: str, since: int, columns: Sequence[str]) -> DataFrame:
    """Columns that exist only from a year on are null before it."""
    return df.withColumns({c: F.when(F.col(year) >= since, F.col(c)) for c in columns})


def point_lookup(df: DataFrame, **equal) -> DataFrame:
    """The row of a key, at most one."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in equal.items()])).limit(1)


def quality_checks(df: DataFrame, expected_years: Sequence[int], year: str = "award_year", name: str = "player_name_raw") -> DataFrame:
    """check, key, detail for every violation of the twelve checks of a ranked candidate table."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(y,) for y in expected_years], f"{year} int")
    have = df.select(F.col(year).cast("int").alias(year)).distinct()
    row = lambda d, check, detail: d.select(F.lit(check).alias("check"), F.col(year).cast("string").alias("key"), detail.cast("string").alias("detail"))
    per = df.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("wins"), F.max("rank").alias("worst"), *(F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"no_{c}") for c in (name, "club_at_time", "nation_team", "points")))
    ordered = df.withColumn("next_points", F.lead("points").over(Window.partitionBy(year).orderBy("rank", name))).where("points < next_points")
    parts = [
        row(wanted.join(have, year, "left_anti"), "missing_years", F.lit(None)),
        row(have.join(wanted, year, "left_anti"), "extra_years", F.lit(None)),
        row(per.where("wins = 0"), "no_winner", F.lit(None)),
        row(per.where("wins > 1"), "multiple_winners", F.col("wins")),
        row(per.where("worst > 1.5 * n"), "rank_gaps", F.col("worst")),
        row(duplicates(df, [year, name]), "duplicate_players", F.col(name)),
        row(ordered.groupBy(year).agg(F.min("rank").alias("at")), "points_not_falling", F.col("at")),
        *(row(per.where(f"no_{c} > 0"), f"missing_{c}", F.col(f"no_{c}")) for c in (name, "club_at_time", "nation_team", "points")),
        row(per.where("n < 10"), "low_row_count", F.col("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
