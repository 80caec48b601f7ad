"""Feature assembly: candidates x statistics x trophies x history x percentiles in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import numeric, periods
from rankloom.operators import aggregates, joins, windows

# Competitions by the flags they set, and the order in which a player's records count.
CLUB_CUPS = ("UEFA Champions League", "European Cup")
LEAGUES = ("Premier League", "Football League First Division", "La Liga", "Serie A", "Bundesliga", "Ligue 1", "French Division 1")
NATIONAL = {"world_cup": "FIFA World Cup", "euro": "UEFA European Championship", "copa_america": "Copa América"}
STATUSES = ("ok", "no_career_table", "fetch_failed", "page_missing")
COUNTS = [f"{p}_{m}" for p in ("league", "continental") for m in ("goals", "assists", "apps", "minutes")]
ADVANCED = ("games", "time", "goals", "assists", "shots", "key_passes", "xG", "xA", "yellow_cards", "red_cards", "npg", "npxG")
KEY = ("season_id", "player_name_raw")


def best_records(stats: DataFrame, order: str) -> DataFrame:
    """One record a player: by status, then by ``order`` (the place in the file)."""
    return windows.first_by_priority(stats, ["player_name_raw"], windows.priority_of(F.col("status"), STATUSES), [order])


def production(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """Candidates with their counts in the evaluation period; those without a good record keep their row and its status."""
    met = joins.with_stats(candidates, stats, "player_name_raw", ["career_stats", "international_stats"])
    year, kind = F.col("award_year"), F.col("eval_period_type")
    in_period = lambda x: periods.season_in_period(periods.season_years(x["season"]), year, kind)
    played = lambda x: periods.international_year_in_period(x["year"], year, kind)
    sums = aggregates.array_sums("career_stats", in_period, COUNTS, "club")
    abroad = [c.alias(n) for c, n in zip(aggregates.array_sums("international_stats", played, ["goals", "apps"], "team")[:2], ("international_goals", "international_apps"))]
    d = met.select(*[c for c in met.columns if c not in ("career_stats", "international_stats")], *sums, *abroad).withColumnsRenamed({"n_matched": "n_seasons_matched", "clubs": "period_clubs"})
    d = d.withColumn("n_seasons_matched", F.when(F.col("has_stats"), F.coalesce("n_seasons_matched", F.lit(0))))
    both = lambda m: numeric.sum_known(F.col(f"league_{m}"), F.col(f"continental_{m}"))
    per_90 = {f"{c}_per90": numeric.per_90(F.col(c), F.col(f"{c.split('_')[0]}_minutes")) for c in ("league_goals", "league_assists", "continental_goals")}
    return d.withColumns(per_90 | {f"total_{m}": both(m) for m in ("goals", "assists", "apps", "minutes")})


def trophy_flags(candidates: DataFrame, trophies: DataFrame) -> DataFrame:
    """Key and a flag a title: the first matching row of a competition, in the order of seasons and lines, tells its stage.

    Club competitions belong to the season that ended in the award year, tournaments
    to the year they were held in. Season and kind of side carry the equi-join.
    """
    year = F.col("award_year")
    ask = lambda at, season, side, name: F.struct(F.lit(at).alias("at"), season.cast("string").alias("season"), F.lit(side).alias("side"), F.coalesce(name, F.lit("")).alias("who"))
    nation, club = F.col("nation_team"), F.col("club_at_time")
    asked = F.when(F.col("eval_period_type") == "season", F.array(ask(0, year - 1, "club", club), ask(0, year - 1, "nation", nation), ask(1, year, "nation", nation))).otherwise(F.array(ask(0, year - 1, "club", club), ask(0, year, "nation", nation)))
    left = candidates.select(*KEY, F.explode(asked).alias("a")).select(*KEY, "a.*")
    side = F.when(F.col("competition").isin(list(NATIONAL.values())), "nation").otherwise("club")
    right = trophies.select(F.col("season_id").alias("season"), side.alias("side"), "competition", "stage", "team", "line")
    found = joins.few_substrings(left.withColumn("who", F.trim("who")), right, ["season", "side"], "who", "team", [*KEY, "competition"], ["at", "line"])
    has = lambda names, stage: F.coalesce(F.bool_or(F.col("competition").isin(list(names)) & (F.col("stage") == stage)), F.lit(False))
    return found.groupBy(*KEY).agg(
        has(CLUB_CUPS, "winner").alias("ucl_winner"), has(CLUB_CUPS, "runner_up").alias("ucl_runner_up"), has(LEAGUES, "winner").alias("domestic_league_winner"), has(LEAGUES, "runner_up").alias("domestic_league_runner_up"),
        *(has([name], "winner").alias(f"{c}_winner") for c, name in NATIONAL.items()), has([NATIONAL["world_cup"]], "runner_up").alias("world_cup_runner_up"),
    )


FLAGS = ("ucl_winner", "ucl_runner_up", "domestic_league_winner", "domestic_league_runner_up", "world_cup_winner", "euro_winner", "copa_america_winner", "world_cup_runner_up")


def history(candidates: DataFrame) -> DataFrame:
    """What lies strictly before the award year: a player's own record, and that of the nation and the continent."""
    won, player, year = F.col("rank") == 1, ["player_name_raw"], "award_year"
    nation = F.nullif(F.trim("nation_team"), F.lit(""))
    d = candidates.withColumns({"_nation": nation, "continent": numeric.continent(F.col("nation_team"))})
    d = d.withColumns(
        {
            "previous_winner": windows.prior_any(won, player, year),
            "prior_winner_count": windows.prior_count(won, player, year),
            "years_in_top_5": windows.prior_count(F.col("rank") <= 5, player, year),
            "prior_nominations_count": windows.prior_times(player, year),
        }
    ).withColumn("first_time_nominee_flag", F.col("prior_nominations_count") == 0)
    per = d.where(F.col("_nation").isNotNull()).groupBy("_nation", year).agg(F.count_if(won).alias("_won"))
    past = windows.before(["_nation"], year)
    of_nation = per.select("_nation", year, F.coalesce(F.sum("_won").over(past), F.lit(0)).cast("long").alias("nation_prior_winners_count"), F.coalesce(F.col(year) - F.max(F.when(F.col("_won") > 0, F.col(year))).over(past), F.lit(999)).alias("nation_years_since_last_winner"))
    of_continent = windows.group_prior_count(d, ["continent"], year, won, "continent_prior_winners_count")
    fresh = windows.years_since_new_winner(d, "player_name_raw", year, won)
    return d.join(of_nation, ["_nation", year], "left").join(of_continent, ["continent", year], "left").join(F.broadcast(fresh), year, "left").drop("_nation")  # a row a year


def advanced(candidates: DataFrame, seasons: DataFrame, since: int = 2014) -> DataFrame:
    """Key, summed expected goals and the like of the league seasons in the evaluation period, from ``since`` on.

    ``seasons``: player_name_normalized, season (the year it starts), league_name, team_title and the counts.
    """
    asked = candidates.where(F.col("award_year") >= since).select(*KEY, "award_year", "eval_period_type", "player_name_normalized")
    met = joins.league_seasons(asked, seasons.withColumn("season", F.col("season").cast("int")), "player_name_normalized", "award_year", "eval_period_type", "season")
    sums = aggregates.known_sums_and_sets(met, KEY, ADVANCED, ["league_name", "team_title"])
    return sums.withColumn("xg_overperformance", numeric.overperformance(F.col("goals"), F.col("xG"))).withColumnRenamed("n_rows", "n_league_seasons")


def assemble(candidates: DataFrame, stats: DataFrame, trophies: DataFrame, skeleton: bool = False) -> DataFrame:
    """One row a candidate with every feature family.

    ``candidates``: season_id, award_year, rank, player_name_raw, club_at_time, nation_team, position_raw, eval_period_type.
    ``stats``: best records (see :func:`best_records`). ``trophies``: season_id, competition, stage, team, line.
    Titles, history and tiers are known for every candidate; with ``skeleton`` candidates without a good record get none of them.
    """
    d = production(candidates.withColumn("era_tag", periods.era(F.col("award_year"))), stats)
    d = d.join(trophy_flags(candidates, trophies), list(KEY), "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS})
    past = history(candidates.select(*KEY, "award_year", "rank", "nation_team"))
    d = d.join(past.drop("rank", "nation_team", "award_year"), list(KEY), "left")
    years = [*numeric.WORLD_CUP_YEARS, *numeric.EURO_YEARS, *numeric.COPA_YEARS]
    at: Column = numeric.position(F.col("position_raw"))
    d = d.withColumns(
        {
            "international_tournament_year": numeric.tournament_year(F.col("award_year"), F.col("eval_period_type"), years),
            "club_prestige_tier": numeric.prestige_tier(F.col("club_at_time")),
            "league_visibility_tier": numeric.visibility_tier(F.col("club_at_time")),
            "signature_moment": numeric.signature_moment(F.col("ucl_winner"), F.col("world_cup_winner"), F.col("international_goals")),
            "position": at,
        }
    )
    d = d.withColumn("position_rarity_score", numeric.lookup(F.col("position"), numeric.POSITION_RARITY, 1.0))
    of = lambda c: F.col(c)
    d = d.withColumns(numeric.heroism(of("continental_goals"), of("total_goals"), of("international_goals"), of("international_apps"), of("international_tournament_year"), of("ucl_winner"), of("world_cup_winner")))
    for m in ("goals", "assists", "apps", "minutes"):  # a year's candidates are a pool of a few dozen
        d = d.withColumn(f"{m}_percentile_in_year", windows.midrank_percentile(F.col(f"total_{m}"), ["award_year"]))
    d = d.withColumn("second_half_goals_share", F.lit(None).cast("double"))
    if skeleton:
        kept = {*candidates.columns, "era_tag", "stats_status", "has_stats"}
        d = d.withColumns({c: F.when(F.col("has_stats"), F.col(c)) for c in d.columns if c not in kept})
    return d
