import pytest
from pyspark.sql import functions as F

from attestry.operators import clean, reshape
from tests.conftest import rows


def test_year_type_columns(spark):
    grid = spark.createDataFrame([("OLIVER", 1, 50, None, None), ("ANNA", 2, 40, 7, 9)],
                                 "Name string, `2021 Rank` int, `2021 Count` int, `2020 Rank` int, `2020 Count` int")
    long = reshape.unpivot_year_type(grid, ["Name"], {"Rank": ("rank", "int"), "Count": ("number", "bigint")})
    assert rows(long) == [("ANNA", 2020, 7, 9), ("ANNA", 2021, 2, 40), ("OLIVER", 2020, None, None), ("OLIVER", 2021, 1, 50)]
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()


def test_alternating_columns(spark):
    grid = spark.createDataFrame([(1, "Ann", 5, "Bea", 6), (None, "note", None, None, None)],
                                 "rank int, `x1954...2` string, `x1954...3` int, `x1955...4` string, `x1955...5` int")
    assert rows(reshape.unpivot_alternating(grid)) == [(1, 1954, "Ann", "5"), (1, 1955, "Bea", "6")]


def test_sex_pairs(spark):
    df = spark.createDataFrame([(2006, "Ann", 9, "Bob", 8)], "year int, name_F string, number_F int, name_M string, number_M int")
    assert rows(reshape.unpivot_sex_pairs(df, ["year"])) == [(2006, "F", "Ann", 9), (2006, "M", "Bob", 8)]


def test_pivot_undoes_unpivot(spark):
    wide = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, x int, y int")
    long = wide.unpivot("id", ["x", "y"], "key", "value")
    back = reshape.pivot_values(long, ["id"], "key", "value", {"x": "x", "y": "y"}, F.max)
    assert rows(back) == rows(wide)


def test_widen_fills_only_missing_cells(spark):
    df = spark.createDataFrame([("a", 1, "r", "F", None), ("a", 1, "r", "M", 4)], "name string, year int, region string, asab string, number int")
    assert rows(reshape.widen_by_sex(df, fill=0), "number_F", "number_M", "number_X") == [(None, 4, 0)]


def test_one_character_label(spark):
    stem = "-" * 49
    df = spark.createDataFrame([("ann", stem + "Rank", 1.0), ("ann", stem + "Number", 30.0)], "name string, label string, v double")
    wide = reshape.pivot_indicator(df, ["name"], "label", "v", {"rank": "rank", "number": "number"},
                                   reshape.label_by_character(50, "R", "rank", "number"))
    assert rows(wide) == [("ann", 1.0, 30.0)]


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, "F", "a", 3), (1, "F", "b", 1), (1, "M", "a", None), (1, "M", "b", 5)],
                               "year int, asab string, name string, number int")
    got = clean.share_of_group(df)
    assert rows(got, "asab", "name", "proportion") == [("F", "a", 0.75), ("F", "b", 0.25), ("M", "a", None), ("M", "b", 1.0)]


def test_population_share_and_fallbacks(spark):
    df = spark.createDataFrame([(1950, "F", "a", 3), (1950, "F", "b", 1), (1980, "M", "a", 5), (1980, "X", "a", 1)],
                               "year int, asab string, name string, number int")
    births = spark.createDataFrame([(1950, None, None, 40), (1980, 50, 100, 150)], "year int, male int, female int, total int")
    plain = clean.share_of_population(df, births)
    assert rows(plain, "year", "asab", "name", "proportion") == [
        (1950, "F", "a", None), (1950, "F", "b", None), (1980, "M", "a", 0.1), (1980, "X", "a", None)]
    by_list = clean.share_with_group_fallback(df, births)
    assert rows(by_list, "year", "asab", "name", "proportion") == [
        (1950, "F", "a", 0.75), (1950, "F", "b", 0.25), (1980, "M", "a", 0.1), (1980, "X", "a", None)]
    totals = births.select("year", F.col("total").alias("population"))
    by_half = clean.share_with_total_fallback(plain, totals)
    assert rows(by_half, "year", "asab", "name", "proportion") == [
        (1950, "F", "a", 0.15), (1950, "F", "b", 0.05), (1980, "M", "a", 0.1), (1980, "X", "a", pytest.approx(1 / 75))]


def test_collapse_keeps_unknown_unknown(spark):
    df = spark.createDataFrame([(1, "a", "F", 2), (1, "a", "F", 3), (1, "b", "F", 1), (1, "b", "F", None)],
                               "year int, name string, asab string, number int")
    assert rows(clean.collapse_duplicates(df)) == [(1, "a", "F", 5), (1, "b", "F", None)]


def test_drop_rows_keeps_unknown(spark):
    df = spark.createDataFrame([("Total",), ("Ann",), (None,)], "name string")
    assert rows(clean.drop_rows(df, [F.col("name") == "Total"])) == [("Ann",), (None,)]


def test_duplicates_are_reported(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "name string, year int")
    assert rows(clean.assert_unique(df, ["name", "year"])) == [("a", 1, 2)]


def test_official_births(spark):
    df = spark.createDataFrame([("1: Births", "AUS: Australia", 1990, 10), ("4: Male births", "AUS: Australia", 1990, 6),
                                ("5: Female births", "AUS: Australia", 1990, 4), ("4: Male births", "1: New South Wales", 1990, 2)],
                               "measure string, region string, year int, population int")
    assert rows(clean.remap_births(df)) == [(1990, 6, 4)]
