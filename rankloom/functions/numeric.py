"""Null-preserving arithmetic, thresholds and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# positions' multipliers and rarity.
POSITION_MULTIPLIER = {"FW": 1.0, "MF": 1.5, "DF": 2.0, "GK": 3.0, "Unknown": 1.0}
POSITION_RARITY = {"FW": 0.5, "MF": 1.0, "DF": 2.0, "GK": 3.0, "Unknown": 1.0}
WORLD_CUP_YEARS = [1930, 1934, 1938, *range(1950, 2023, 4)]
EURO_YEARS = [*range(1960, 2025, 4)]
COPA_YEARS = [
    1916, 1917, 1919, 1920, 1921, 1922, 1923, 1924, 1925, 1926, 1927, 1929, 1935, 1937, 1939, 1941, 1942, 1945, 1946, 1947, 1949, 1953, 1955, 1956,
    1957, 1959, 1963, 1967, 1975, 1979, 1983, 1987, 1989, 1991, 1993, 1995, 1997, 1999, 2001, 2004, 2007, 2011, 2015, 2016, 2019, 2021, 2024,
]
# Clubs by prestige and by their league's visibility.
PRESTIGE_1 = (
    "real madrid", "barcelona", "bayern munich", "bayern de múnich", "fc bayern münchen", "manchester united", "man united", "liverpool", "juventus",
    "ac milan", "milan", "inter milan", "internazionale", "inter", "ajax", "paris saint-germain", "psg", "paris saint germain", "paris-saint-germain",
    "manchester city", "man city", "chelsea", "arsenal",
)
PRESTIGE_2 = (
    "atletico madrid", "atlético madrid", "atletico de madrid", "atlético de madrid", "borussia dortmund", "bvb", "tottenham hotspur", "tottenham",
    "spurs", "napoli", "roma", "as roma", "lazio", "ssc napoli", "sevilla", "valencia", "atletico de kolkata", "port fc", "benfica", "sporting cp",
    "sporting lisbon", "porto", "fc porto", "celtic", "rangers", "marseille", "olympique de marseille", "om", "lyon", "ol", "monaco", "as monaco",
    "everton", "newcastle united", "aston villa", "leicester city", "atletico mineiro", "flamengo", "palmeiras", "são paulo", "santos", "botafogo",
    "vasco da gama", "cruzeiro", "grêmio", "internacional", "river plate", "boca juniors", "independiente", "racing club", "estudiantes",
)
VISIBLE_1 = (
    "manchester united", "manchester city", "liverpool", "chelsea", "arsenal", "tottenham", "everton", "leicester", "real madrid", "barcelona",
    "atletico madrid", "atlético madrid", "atletico de madrid", "valencia", "sevilla", "villarreal", "juventus", "ac milan", "milan", "inter milan",
    "internazionale", "inter", "napoli", "roma", "as roma", "lazio", "fiorentina", "bayern munich", "bayern de múnich", "fc bayern münchen",
    "borussia dortmund", "bayer leverkusen", "schalke", "rb leipzig", "paris saint-germain", "psg", "paris saint germain", "marseille", "monaco",
    "lyon", "ol", "lille",
)
VISIBLE_2 = (
    "benfica", "sporting cp", "sporting lisbon", "porto", "fc porto", "ajax", "psv", "psv eindhoven", "feyenoord", "zenit", "cska moscow",
    "spartak moscow", "galatasaray", "fenerbahce", "fenerbahçe", "besiktas", "beşiktaş", "celtic", "rangers", "anderlecht", "club brugge",
    "dynamo kyiv", "dynamo kiev", "shakhtar donetsk", "red bull salzburg", "basel",
)
# The continent of each nation.
CONTINENTS = {
    "England": "Europe", "Scotland": "Europe", "Wales": "Europe", "Northern Ireland": "Europe", "France": "Europe", "Germany": "Europe",
    "West Germany": "Europe", "East Germany": "Europe", "Italy": "Europe", "Spain": "Europe", "Portugal": "Europe", "Netherlands": "Europe",
    "Belgium": "Europe", "Sweden": "Europe", "Denmark": "Europe", "Norway": "Europe", "Finland": "Europe", "Ireland": "Europe",
    "Republic of Ireland": "Europe", "Austria": "Europe", "Switzerland": "Europe", "Czech Republic": "Europe", "Czechoslovakia": "Europe",
    "Hungary": "Europe", "Poland": "Europe", "Romania": "Europe", "Bulgaria": "Europe", "Yugoslavia": "Europe", "Croatia": "Europe",
    "Serbia": "Europe", "Serbia and Montenegro": "Europe", "Bosnia and Herzegovina": "Europe", "Slovenia": "Europe", "Soviet Union": "Europe",
    "Russia": "Europe", "Ukraine": "Europe", "Belarus": "Europe", "Georgia": "Europe", "Lithuania": "Europe", "Greece": "Europe", "Turkey": "Europe",
    "Brazil": "South America", "Argentina": "South America", "Uruguay": "South America", "Colombia": "South America", "Chile": "South America",
    "Peru": "South America", "Paraguay": "South America", "Ecuador": "South America", "Venezuela": "South America", "Bolivia": "South America",
    "Liberia": "Africa", "Egypt": "Africa", "Nigeria": "Africa", "Ghana": "Africa", "Cameroon": "Africa", "Senegal": "Africa",
    "Ivory Coast": "Africa", "Côte d'Ivoire": "Africa", "Morocco": "Africa", "Algeria": "Africa", "Tunisia": "Africa", "South Africa": "Africa",
    "Mali": "Africa", "Guinea": "Africa", "Gabon": "Africa", "Congo": "Africa", "DR Congo": "Africa", "Zaire": "Africa", "Kenya": "Africa",
    "Japan": "Asia", "South Korea": "Asia", "Korea Republic": "Asia", "Korea DPR": "Asia", "China": "Asia", "Iran": "Asia", "Iraq": "Asia",
    "Saudi Arabia": "Asia", "Australia": "Asia",
    "United States": "North America", "USA": "North America", "Mexico": "North America", "Costa Rica": "North America", "Canada": "North America",
    "Honduras": "North America",
}


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def per_90(x: Column, minutes: Column) -> Column:
    return F.try_divide(x * 90, minutes)


def sum_known(*cs: Column) -> Column:
    """Null only if every part is null."""
    return F.when(F.coalesce(*cs).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs]))


def share_known(*cs: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs]) / F.lit(len(cs))


def overperformance(goals: Column, expected: Column) -> Column:
    return goals - expected


def lookup(c: Column, table: dict, default=None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def continent(nation: Column, table: dict[str, str] = CONTINENTS) -> Column:
    """The nation's continent; Unknown where it is blank, Other where the table lacks it."""
    name = F.trim(nation)
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(lookup(name, table, "Other"))


def substring_tier(name: Column, first: list[str], second: list[str], whole_words: bool = False) -> Column:
    """1 or 2 if the name holds an entry of that list, 3 if of neither, 4 if blank."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    if whole_words:
        has = lambda x: F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(f" {x} "))
    else:
        has = lambda x: F.contains(low, F.lit(x))
    any_of = lambda xs: reduce(lambda a, b: a | b, [has(x) for x in xs])
    return F.when(low == "", 4).when(any_of(first), 1).when(any_of(second), 2).otherwise(3)


def prestige_tier(club: Column, whole_words: bool = False) -> Column:
    return substring_tier(club, PRESTIGE_1, PRESTIGE_2, whole_words)


def visibility_tier(club: Column, whole_words: bool = False) -> Column:
    return substring_tier(club, VISIBLE_1, VISIBLE_2, whole_words)


def position(raw: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    has = lambda *xs: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in xs])
    return F.when(has("goalkeeper"), "GK").when(has("defender"), "DF").when(has("midfielder"), "MF").when(has("forward"), "FW").when(has("gk"), "GK").when(has("df", "def"), "DF").when(has("mf", "mid"), "MF").when(has("fw", "str"), "FW").otherwise("Unknown")


def gated(flag: Column, x: Column) -> Column:
    """The value where the flag holds (null: 0), else 0."""
    return F.when(F.coalesce(flag, F.lit(False)), F.coalesce(x, F.lit(0))).otherwise(F.lit(0))


def heroism(continental_goals: Column, total_goals: Column, international_goals: Column, international_apps: Column, tournament: Column, club_cup: Column, world_cup: Column) -> dict[str, Column]:
    """Shares and rates of decisive goals, and goals that count only in the year of a tournament or title."""
    return {
        "continental_goals_ratio": safe_div(continental_goals, total_goals),
        "international_goals_per_app": safe_div(international_goals, international_apps),
        "tournament_year_boost": gated(tournament, international_goals),
        "ucl_winner_goalscorer": gated(club_cup, continental_goals),
        "wc_winner_goalscorer": gated(world_cup, international_goals),
    }


def adjusted_contribution(expected_goals: Column, expected_assists: Column, at: Column) -> Column:
    """Expected goals and assists, weighted by how rarely the position scores; null if neither is known."""
    return sum_known(expected_goals, expected_assists) * lookup(at, POSITION_MULTIPLIER, 1.0)


def signature_moment(club_cup: Column, world_cup: Column, international_goals: Column) -> Column:
    g = F.coalesce(international_goals, F.lit(0))
    c, w = F.coalesce(club_cup, F.lit(False)), F.coalesce(world_cup, F.lit(False))
    return (c & w) | (c & (g >= 10)) | (w & (g >= 5))


def tournament_year(year: Column, kind: Column, years: list[int]) -> Column:
    held = F.array(*map(F.lit, sorted(set(years))))
    return F.arrays_overlap(F.when(kind == "season", F.array(year - 1, year)).otherwise(F.array(year)), held)


def relevance(rank: Column) -> Column:
    return F.greatest(32 - rank, F.lit(1))


def coverage_grade(share: Column) -> Column:
    return F.when(share >= 90, "excellent").when(share >= 70, "good").when(share >= 50, "partial").otherwise("poor")


def as_number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def percent(share: Column, digits: int = 1) -> Column:
    """0.3387 as ``33.9%``; null stays null."""
    return F.concat(F.format_string(f"%.{digits}f", 100 * share), F.lit("%"))


def signed(x: Column, digits: int = 3) -> Column:
    """A number with its sign: ``+0.250``."""
    return F.when(x.isNotNull(), F.format_string(f"%+.{digits}f", x))
