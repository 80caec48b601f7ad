import pytest
from pyspark.sql import functions as F

from rankloom.functions import numeric, periods, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [("2022-23", (2022, 2023)), ("2022–23[4]", (2022, 2023)), ("1999-00", (1999, 2000)), ("2008", (2008, None)), ("2005/2006", (2005, 2006)), ("On loan", None), (None, None)])
def test_season(spark, raw, want):
    got = one(spark, periods.season_years, raw)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("raw, kind, year, want", [("2023", "calendar_year", 2023, True), ("2022-23", "calendar_year", 2023, True), ("2023-24", "calendar_year", 2023, True), ("2021-22", "calendar_year", 2023, False), ("2020-2026", "calendar_year", 2023, False), ("2023-24", "season", 2024, True), ("2024-25", "season", 2024, False), ("2024", "season", 2024, False)])
def test_membership(spark, raw, kind, year, want):
    assert one(spark, lambda c: periods.season_in_period(periods.season_years(c), F.lit(year), F.lit(kind)), raw) is want


@pytest.mark.parametrize("f, raw, want", [(text.parse_rank, "1st", 1), (text.parse_rank, "2.0", 2), (text.parse_rank, "—", None), (text.parse_points, "1,170", 1170.0), (text.parse_points, "22.65%", 22.65), (text.parse_points, "-", None), (text.parse_int, "12[3]", 12), (text.parse_int, "7.0", 7), (text.parse_int, "On loan", None), (text.parse_minutes, "2,778", 2778), (text.parse_minutes, "7.0", None), (text.clean_team, "Real Madrid (15th title)", "Real Madrid"), (text.clean_team, "Arsenal 8th Premier League title", "Arsenal"), (text.clean_text, None, ""), (numeric.position, "Goalkeeper", "GK"), (numeric.position, "Defender/Midfielder", "DF"), (numeric.position, "MF", "MF"), (numeric.position, "striker", "FW"), (numeric.position, None, "Unknown")])
def test_scalars(spark, f, raw, want):
    assert one(spark, f, raw) == want


def test_eras_and_relevance(spark):
    assert [one(spark, periods.era, y, "int") for y in (1994, 1995, 2009, 2010, 2015, 2016)] == ["classical", "pre_merger", "pre_merger", "fifa_merger", "fifa_merger", "post_split"]
    assert [one(spark, numeric.relevance, r, "int") for r in (1, 31, 50)] == [31, 1, 1]


def test_names(spark):
    for raw, want in (("N&#039;Golo Kanté", "ngolo kante"), ("Ødegaard", "odegaard"), ("Großkreutz", "grosskreutz"), ("Æ. Þór-Łukasz  O'Neil", "ae thor lukasz oneil"), ("a_b—c\u00a0\u2003d", "a_b c d"), ("İbrahim", "ibrahim"), (None, "")):
        assert one(spark, text.normalize_name, raw) == want
    assert one(spark, text.normalize_award_name, "Lionel Messi (3)") == "lionel messi" and one(spark, text.normalize_award_name, "Pelé[a] X") == "pele x"
    assert text.token_sort_ratio_of("ab cd", "cd ab") == 100
    assert round(text.token_sort_ratio_of("abc", "abd"), 2) == 66.67


def test_null_arithmetic(spark):
    df = spark.createDataFrame([(None, None), (None, 3.0), (2.0, None)], "a double, b double")
    assert [r[0] for r in df.select(numeric.sum_known(F.col("a"), F.col("b"))).collect()] == [None, 3.0, 2.0]
    assert df.select(numeric.per_90(F.lit(10), F.lit(900)), numeric.per_90(F.lit(1), F.lit(0))).first()[:] == (1.0, None)
