"""Explicit schemas of the reference-shaped tables; missing values are NULL, never NaN."""

NOMINEES = "season_id string, award_year int, rank int, player_name_raw string, club_at_time string, nation_team string, position_raw string, points double, source string"
GROUND_TRUTH = "season_id string, award_year int, eval_period_start date, eval_period_end date, eval_period_type string, rank int, player_name_raw string, player_name_canonical string, club_at_time string, nation_team string, position_raw string, points double, source string"
STATS = (
    "player_name_raw string, player_slug string, wiki_page_title string, stats_source string, status string, error string, "
    "career_stats array<struct<season:string, season_raw:string, club:string, league_apps:bigint, league_goals:bigint, league_assists:bigint, league_minutes:bigint, continental_apps:bigint, continental_goals:bigint, continental_assists:bigint, continental_minutes:bigint, continental_competition:string>>, "
    "international_stats array<struct<year:string, team:string, apps:bigint, goals:bigint>>"
)
TROPHIES = "season_id string, competition string, stage string, team string, source string"
ADVANCED = "understat_player_id string, player_name string, player_name_normalized string, league_slug string, league_name string, season string, season_label string, team_title string, games int, time int, goals int, assists int, shots int, key_passes int, xG double, xA double, yellow_cards int, red_cards int, position string, npg int, npxG double"
EVAL_WINDOWS = "season_id string, award_year int, eval_period_type string, eval_period_start date, eval_period_end date, intro_excerpt string, verification_status string"
ALIASES = "alias string, canonical string"
