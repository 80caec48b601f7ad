"""The nine reports: each a few aggregates as tables, with a verdict where there is one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import numeric, periods
from rankloom.operators import aggregates, joins, ranking
from rankloom.sources.landing import markdown


def page(title: str, *parts: tuple[str, DataFrame | str]) -> str:
    """A Markdown page: sections of tables or of text."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{part if isinstance(part, str) else markdown(part)}" for name, part in parts)]) + "\n"


def by_era(df: DataFrame, name: str = "player_name_raw") -> DataFrame:
    """era, rows, players, winners."""
    return df.groupBy(periods.era(F.col("award_year")).alias("era")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(name).alias("players"), F.count_if(F.col("rank") == 1).alias("winners")).orderBy("era")


def known_seasons(features: DataFrame, expected: DataFrame) -> DataFrame:
    """award_year, player_name_raw, feature, expected, found, agrees: spot checks of seasons whose numbers are known (year, player, feature, value)."""
    names = [r[0] for r in expected.select("feature").distinct().collect()]  # a few features
    long = features.select("award_year", "player_name_raw", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("found")) for n in names))).alias("f")).select("award_year", "player_name_raw", "f.*")
    met = expected.join(long, ["award_year", "player_name_raw", "feature"], "left")
    return met.select("award_year", "player_name_raw", "feature", F.col("value").alias("expected"), "found", F.col("value").eqNullSafe(F.col("found")).alias("agrees"))


def features_report(features: DataFrame, columns: Sequence[str], expected: DataFrame | None = None) -> str:
    parts = [("Status", aggregates.value_counts(features, "stats_status")), ("Eras", by_era(features)), ("Coverage", aggregates.coverage(features, "era_tag", columns).groupBy("feature").pivot("grp").agg(F.first("percent")).orderBy("feature"))]
    if expected is not None:
        parts.append(("Known seasons", known_seasons(features, expected)))
    return page("Features", *parts)


def ground_truth_report(df: DataFrame, years: Sequence[int]) -> str:
    """Checks with how many places each finds, the first of them in detail, and sizes."""
    found = aggregates.quality_checks(df, years)
    detail = aggregates.head_and_more(found.select("check", F.concat_ws(": ", "key", "detail").alias("place")), ["check"], "place")
    failed = found.groupBy("check").count().orderBy("check")
    verdict = "All checks pass." if not found.take(1) else "Some checks found something."
    return page("Ground truth", ("Verdict", verdict), ("Checks", failed), ("Places", detail.select("check", F.array_join("items", "; ").alias("first"), "more").orderBy("check")), ("Candidates a year", aggregates.sizes(df, ["award_year"])), ("Eras", by_era(df)))


def stats_coverage(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """era, rows, with_stats, share (percent), grade."""
    met = candidates.join(stats.select("player_name_raw", "status"), "player_name_raw", "left")
    per = met.groupBy(periods.era(F.col("award_year")).alias("era")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("with_stats"))
    share = 100 * F.col("with_stats") / F.col("rows")
    return per.select("era", "rows", "with_stats", F.round(share, 1).alias("share"), numeric.coverage_grade(share).alias("grade")).orderBy("era")


def stats_report(candidates: DataFrame, stats: DataFrame) -> str:
    missing = candidates.join(stats.where("status = 'ok'").select("player_name_raw"), "player_name_raw", "left_anti").groupBy("player_name_raw").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "player_name_raw").limit(20)
    return page("Player statistics", ("Records", aggregates.array_lengths(stats, ["career_stats", "international_stats"])), ("Status", aggregates.value_counts(stats, "status")), ("Eras", stats_coverage(candidates, stats)), ("Most often missing", missing))


def resolution_review(resolved: DataFrame, least: float = 95.0) -> DataFrame:
    """What a person should look at: failures, doubtful fuzzy matches, aliases without a page."""
    return resolved.where((F.col("method") == "failed") | ((F.col("method") == "fuzzy") & (F.col("score") < least)) | (F.col("method") == "alias_needs_refetch")).orderBy("method", "name")


def resolution_exit(resolved: DataFrame, gaps: DataFrame) -> DataFrame:
    """names, resolved, documented, open, passes: every name resolves or is a documented gap (name)."""
    met = resolved.join(gaps.select("name", F.lit(True).alias("_gap")).distinct(), "name", "left")
    fine, known = F.col("target").isNotNull(), F.coalesce("_gap", F.lit(False))
    sums = met.agg(F.count(F.lit(1)).alias("names"), F.count_if(fine).alias("resolved"), F.count_if(~fine & known).alias("documented"), F.count_if(~fine & ~known).alias("open"))
    return sums.withColumn("passes", F.col("open") == 0)


def resolution_report(resolved: DataFrame, gaps: DataFrame) -> str:
    counts = aggregates.nested_counts(resolved.withColumn("found", F.when(F.col("target").isNotNull(), "found").otherwise("open")), "method", "found")
    return page("Names", ("Methods", aggregates.value_counts(resolved, "method")), ("By outcome", counts.select("method", F.to_json("counts").alias("counts"))), ("Exit", resolution_exit(resolved, gaps)), ("Review", resolution_review(resolved)))


def cross_verification(main: DataFrame, mine: DataFrame, years: Sequence[int], most: int = 3) -> DataFrame:
    """award_year, rank, mine, main, verdict for sampled years; ``main``: award_year, rank, player of another source. Names by their folded form."""
    from rankloom.functions.text import normalize_award_name

    side = lambda df, name: joins.in_years(df, "award_year", years).where(F.col("rank") <= most).select("award_year", F.col("rank").cast("int").alias("rank"), normalize_award_name(name).alias("player"))
    return joins.compare_full(side(mine, "player_name_raw"), side(main, "player"), ["award_year", "rank"], "player")


def cross_report(compared: DataFrame) -> str:
    rows = compared.withColumn("era", periods.era(F.col("award_year")))
    return page("Cross-verification", ("Verdicts", aggregates.value_counts(rows, "verdict")), ("Eras", rows.groupBy("era").agg(F.count_if(F.col("verdict") == "match").alias("match"), F.count(F.lit(1)).alias("compared")).orderBy("era")), ("Differences", rows.where("verdict <> 'match'").orderBy("award_year", "rank")))


def matching_report(matched: DataFrame) -> str:
    """``matched``: name, method, score and the era of its first season."""
    total = matched.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("method") != "failed").alias("matched")).withColumn("share", numeric.percent(F.col("matched") / F.col("names")))
    return page("Advanced statistics", ("Matches", total), ("Methods", aggregates.value_counts(matched, "method")), ("Fuzzy", matched.where("method = 'fuzzy'").select("name", "target", F.round("score", 3).alias("score")).orderBy("score", "name")))


METRICS = ("top1", "top3", "top5", "spearman", "kendall")


def validation_report(runs: dict[str, DataFrame], eras: DataFrame | None = None) -> str:
    """``runs``: protocol and tier -> one row of mean metrics."""
    parts = [(name, m.select(*(numeric.percent(F.col(c)).alias(c) if c.startswith("top") else F.round(c, 3).alias(c) for c in METRICS if c in m.columns), "n_years")) for name, m in runs.items()]
    if eras is not None:
        parts.append(("Eras", eras))
    rows = {name: m.first().asDict() for name, m in runs.items()}  # a row a run
    b, c = (next((r for name, r in rows.items() if name.lower().endswith(f"loso {t}")), None) for t in "bc")
    if b and c:
        parts.append(("Chosen tier", ranking.choose_tier(b, c)))
    return page("Validation", *parts)


def comparison_report(changes: DataFrame) -> str:
    found = {r.metric: r.change for r in changes.collect()}  # a row a metric
    return page("Further features", ("Change", changes.select("metric", F.round("base", 3).alias("base"), F.round("more", 3).alias("more"), numeric.signed(F.col("change")).alias("change"))), ("Verdict", "keep" if ranking.keep_features(found) else "leave out"))


def explanation_report(document: str, descriptions: dict[str, str]) -> str:
    return page("Prediction", ("Ranking", ranking.explain_prediction(document, descriptions)))
