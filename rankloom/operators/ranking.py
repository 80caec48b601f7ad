"""Rankers: weighted score, pairwise logistic regression, boosted trees, validation and prediction documents."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import as_number
from rankloom.operators.boosting import ListwiseRanker, cross_validate_listwise, load_ranker, save_ranker, train_listwise  # noqa: F401
from rankloom.operators import pairs
from rankloom.operators.windows import best_place, kendall, predicted_rank, spearman

# Seasons never trained on, and the transparent tier's weights.
HELD_OUT = (2018, 2019, 2021, 2022, 2023, 2024, 2025)
TIER_A_WEIGHTS = {
    "goals_percentile_in_year": 2.0, "assists_percentile_in_year": 1.0, "apps_percentile_in_year": 0.3, "minutes_percentile_in_year": 0.2, "ucl_winner": 3.0, "ucl_runner_up": 1.0, "domestic_league_winner": 1.5,
    "domestic_league_runner_up": 0.3, "world_cup_winner": 3.5, "world_cup_runner_up": 1.2, "euro_winner": 2.0, "copa_america_winner": 1.8, "international_tournament_year": 0.5, "signature_moment": 1.5, "club_prestige_tier": -0.5,
    "previous_ballon_dor_winner": 1.0, "has_stats_data": 0.5, "data_completeness_score": 0.3, "nation_prior_winners_count": -0.5, "continent_prior_winners_count": -0.3, "nation_years_since_last_winner": 0.5,
    "league_visibility_tier": -0.2, "position_rarity_score": 0.5, "position_adjusted_xg_contribution": 0.3,
}


def weighted_score(df: DataFrame, weights: dict[str, float]) -> Column:
    """Sum of weight x value; nulls count 0, absent columns are left out."""
    have = [(c, w) for c, w in weights.items() if c in df.columns]
    return reduce(lambda a, b: a + b, [as_number(F.col(c)) * F.lit(w) for c, w in have], F.lit(0.0))


@dataclass(frozen=True)
class LinearRanker:
    """Coefficients on values divided by ``scale``, in feature order."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    scale: tuple[float, ...]
    intercept: float
    n_pairs: int

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, [as_number(F.col(f)) * F.lit(c / s) for f, c, s in zip(self.features, self.coefficients, self.scale)], F.lit(self.intercept))

    def contributions(self, top: int | None = None) -> Column:
        """Array of (feature, contribution), largest size first."""
        each = F.array(*(F.struct(F.lit(f).alias("feature"), (as_number(F.col(f)) * F.lit(c / s)).alias("contribution")) for f, c, s in zip(self.features, self.coefficients, self.scale)))
        by_size = F.transform(F.sort_array(F.transform(each, lambda x: F.struct((-F.abs(x["contribution"])).alias("k"), x["feature"].alias("feature"), x["contribution"].alias("contribution")))), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))
        return F.slice(by_size, 1, top) if top else by_size

    def to_json(self) -> str:
        return json.dumps({"feature_order": self.features, "coefficients": self.coefficients, "scaler_scale": self.scale, "intercept": self.intercept, "n_pairs": self.n_pairs}, indent=2)

    def signs(self, expected: dict[str, int], least: float = 0.01) -> list[tuple[str, float, bool]]:
        """(feature, coefficient, whether its sign is the expected one) for coefficients that matter."""
        return [(f, c, c * expected[f] > 0) for f, c in zip(self.features, self.coefficients) if f in expected and abs(c) > least]


def numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in features], *(as_number(F.col(f)).alias(f) for f in features))


def train_linear(df: DataFrame, group: str, order: Sequence[str], key: str, features: Sequence[str], c: float = 1.0) -> LinearRanker:
    """L2 logistic regression on the differences of all pairs of a group, scaled by their population deviation (0: left alone)."""
    ((scale, w, b, n),) = pairs.fit_folds(numbers(df, features), group, order, key, features, c=c)
    return LinearRanker(tuple(features), tuple(map(float, w)), tuple(map(float, scale)), b, n)


def pair_accuracy(df: DataFrame, group: str, order: Sequence[str], key: str, model: LinearRanker) -> float | None:
    """Share of a pool's pairs, both ways round, that the model tells right, counted over blocks of the pools."""
    return pairs.accuracy(df, group, order, key, model.score() - F.lit(model.intercept), model.intercept)


def importance(model: ListwiseRanker, features: Sequence[str], top: int = 15) -> list[tuple[str, float]]:
    """Features by gain, largest first, scaled to a sum of 1."""
    gains = np.array(model.gain)
    gains = gains / gains.sum() if gains.sum() > 0 else gains
    return sorted(zip(features, map(float, gains)), key=lambda x: (-x[1], x[0]))[:top]


def fold_models(df: DataFrame, year: str, order: Sequence[str], key: str, years: Sequence[int], features: Sequence[str], kind: str = "loso", c: float = 1.0) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(scale, coefficients, intercept) of the model of each fold; all folds are fitted together, from blocks of the pools."""
    found = pairs.fit_folds(df, year, order, key, features, list(years), kind, c) if len(years) else []
    return {y: (scale, w, b) for y, (scale, w, b, _) in zip(years, found)}


def cross_validate(df: DataFrame, year: str, order: Sequence[str], key: str, rank: str, features: Sequence[str], kind: str = "loso", skip: int = 0) -> DataFrame:
    """year, key, rank, score: every year's rows scored by a model of the other years (loso) or of earlier ones (expanding).

    The first ``skip`` years are no folds of their own.
    """
    clean = numbers(df, features)
    years = sorted(r[0] for r in clean.select(year).distinct().collect() if r[0] is not None)[skip:]  # a row a year
    return scored_by_fold(clean, year, key, rank, features, fold_models(clean, year, order, key, years, features, kind))


def scored_by_fold(df: DataFrame, year: str, key: str, rank: str, features: Sequence[str], models: dict[int, tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    kind = dict(df.dtypes)[year]
    rows = [(y, (w / s).tolist(), b) for y, (s, w, b) in models.items()]
    held = F.broadcast(df.sparkSession.createDataFrame(rows, f"{year} {kind}, _w array<double>, _b double"))  # a row a fold
    score = reduce(lambda a, b: a + b, [F.col(f) * F.col("_w")[i] for i, f in enumerate(features)], F.col("_b"))
    return df.join(held, year).select(year, F.col(key).cast("string").alias(key), F.col(rank).cast("int").alias(rank), score.alias("score"))


def yearly_metrics(scores: DataFrame, year: str | Sequence[str], key: str, rank: str, score: str) -> DataFrame:
    """year, winner_at, spearman, kendall; a year whose correlation is undefined has null. Several columns may tell a year (run, year)."""
    keys = [year] if isinstance(year, str) else list(year)
    placed = best_place(scores, keys, score, [key], F.col(rank) == 1)
    turned = scores.withColumn("_r", -F.col(rank))
    return scores.select(*keys).distinct().join(placed, keys, "left").join(spearman(turned, keys, score, "_r"), keys, "left").join(kendall(turned, keys, score, "_r"), keys, "left")


def mean_metrics(yearly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over all years, or over those of each group; undefined correlations add nothing but their years still count."""
    known = lambda c: F.sum(F.coalesce(F.nanvl(c, F.lit(None)), F.lit(0.0))) / F.count(F.lit(1))
    hit = lambda k: F.sum((F.coalesce("winner_at", F.lit(10**6)) <= k).cast("int")) / F.count(F.lit(1))
    return yearly.groupBy(*by).agg(hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"), known("spearman").alias("spearman"), known("kendall").alias("kendall"), F.count(F.lit(1)).alias("n_years"))


def held_out_split(df: DataFrame, year: str, held: Sequence[int] = HELD_OUT) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col(year).isin(list(held))), df.where(F.col(year).isin(list(held)))


def evaluate(scores: DataFrame, year: str, key: str, rank: str, by: Sequence[str] = ()) -> DataFrame:
    """The mean metrics of scored rows, over all years or for each value of ``by`` (runs, eras)."""
    return mean_metrics(yearly_metrics(scores, [*by, year], key, rank, "score"), by)


def labelled_union(runs: dict, *names: str) -> DataFrame:
    """The scored rows of several runs, each with its label (a string, or as many as there are names)."""
    parts = [s.select(*(F.lit(x).alias(n) for n, x in zip(names, [label] if isinstance(label, str) else label)), "*") for label, s in runs.items()]
    return reduce(DataFrame.unionByName, parts)


def scored(df: DataFrame, score: Column, year: str, key: str, rank: str) -> DataFrame:
    return df.select(year, F.col(key).cast("string").alias(key), F.col(rank).cast("int").alias(rank), score.alias("score"))


def held_out_scores(df: DataFrame, year: str, order: Sequence[str], key: str, rank: str, features: Sequence[str], held: Sequence[int] = HELD_OUT, weights: dict[str, float] = TIER_A_WEIGHTS, **options) -> dict[str, DataFrame]:
    """The three tiers' scores of years that none of them was trained on."""
    train, test = held_out_split(df, year, held)
    linear = train_linear(train, year, order, key, features)
    trees = train_listwise(train, year, rank, key, features, **options)
    return {"A": scored(test, weighted_score(test, weights), year, key, rank), "B": scored(numbers(test, features), linear.score(), year, key, rank), "C": scored(test, trees.score(), year, key, rank)}


def held_out_evaluation(df: DataFrame, year: str, order: Sequence[str], key: str, rank: str, features: Sequence[str], **options) -> DataFrame:
    """tier and mean metrics on the held-out years."""
    return evaluate(labelled_union(held_out_scores(df, year, order, key, rank, features, **options), "tier"), year, key, rank, ["tier"])


def compare_feature_sets(df: DataFrame, year: str, order: Sequence[str], key: str, rank: str, base: Sequence[str], more: Sequence[str]) -> DataFrame:
    """metric, base, more, change: leave-one-year-out results without and with the further features."""
    metrics = ["top1", "top3", "top5", "spearman", "kendall"]
    runs = {name: cross_validate(df, year, order, key, rank, f) for name, f in (("base", list(base)), ("more", [*base, *more]))}
    found = evaluate(labelled_union(runs, "features"), year, key, rank, ["features"])
    long = found.select("features", F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("v")) for x in metrics))).alias("r")).select("features", "r.*")
    return long.groupBy("metric").pivot("features", ["base", "more"]).agg(F.first("v")).withColumn("change", F.col("more") - F.col("base"))


def keep_features(changes: dict[str, float], margin: float = 0.0) -> bool:
    """Further features stay if the top-3 rate or the rank correlation grows and neither falls by more than ``margin``."""
    a, b = changes["top3"], changes["spearman"]
    return (a > 0 or b > 0) and min(a, b) >= -margin


def choose_tier(b: dict, c: dict, margin: float = 0.05) -> str:
    return "C" if c["top1"] - b["top1"] > margin and c["top3"] - b["top3"] > margin else "B"


def missed_winners(scores: DataFrame, year: str, key: str, rank: str, score: str) -> DataFrame:
    """year, key, winner_at, predicted: the winners that the ranking didn't put first, and whom it did."""
    placed = scores.withColumn("winner_at", predicted_rank([year], score, [key]))
    first = placed.where("winner_at = 1").select(year, F.col(key).alias("predicted"))
    return placed.where((F.col(rank) == 1) & (F.col("winner_at") > 1)).select(year, key, "winner_at").join(first, year)


def prediction_document(df: DataFrame, model: LinearRanker, season: str, key: str, top: int = 10, explain: bool = True) -> DataFrame:
    """One JSON document of a season's ranking with contributions and feature values, or an error document."""
    one = df.where(F.col("season_id") == season).withColumn("score", model.score())
    ranked = one.withColumn("place", predicted_rank(["season_id"], "score", [key])).where(F.col("place") <= top)
    values = F.create_map(*[x for f in model.features for x in (F.lit(f), F.col(f).cast("double"))])
    said = [F.col(c).cast("string").alias(name) for c, name in (("club_at_time", "club"), ("nation_team", "nation")) if c in df.columns]
    fields = [F.col("place").alias("rank"), F.col(key).alias("player"), *said, F.col("score"), F.col("rank").cast("int").alias("actual_rank"), (F.col("place") == F.col("rank")).alias("correct_prediction")]
    if explain:
        fields += [model.contributions(5).alias("top_contributing_features"), values.alias("feature_values")]
    body = ranked.agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["rank"] - b["rank"]).alias("rankings"))  # at most ``top`` entries
    total = one.agg(F.count(F.lit(1)).alias("total_candidates"))
    good = F.to_json(F.struct(F.lit(season).alias("season_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), F.lit("tier_b").alias("model_version"), F.lit(f"pairwise logistic regression on {len(model.features)} features").alias("model_description"), F.lit(f"{model.n_pairs} pairs").alias("training_data_size"), F.array(*map(F.lit, HELD_OUT)).alias("held_out_seasons"), "total_candidates", "rankings"))
    bad = F.to_json(F.struct(F.lit("no candidates for this season").alias("error"), F.lit(season).alias("season_id")))
    return body.crossJoin(total).select(F.when(F.col("total_candidates") > 0, good).otherwise(bad).alias("document"))  # one row each


def predict_season(df: DataFrame, season: str, order: Sequence[str], key: str, features: Sequence[str], held: Sequence[int] = HELD_OUT, top: int = 10, explain: bool = True) -> DataFrame:
    """Trains on all seasons but the held-out ones and the one asked for, then writes its document."""
    train = df.where(~F.col("award_year").isin(list(held)) & (F.col("season_id") != season))
    return prediction_document(df, train_linear(train, "award_year", order, key, features), season, key, top, explain)


def explain_prediction(document: str, descriptions: dict[str, str], top: int = 5) -> str:
    doc = json.loads(document)
    if "error" in doc:
        return doc["error"]
    lines = []
    for r in doc["rankings"]:
        part = r["top_contributing_features"][:top]
        up, down = next((x for x in part if x["contribution"] > 0), None), next((x for x in part if x["contribution"] < 0), None)
        say = lambda x: descriptions.get(x["feature"], x["feature"].replace("_", " "))
        lines.append(f"{r['rank']}. {r['player']} ({r['score']:+.3f})" + (f" ↑ {say(up)}" if up else "") + (f" ↓ {say(down)}" if down else ""))
    return "\n".join(lines)
