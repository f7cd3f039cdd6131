"""Register quirks on tiny tables in the published layouts."""

import pytest

from attestry.plans import registers as reg
from tests.conftest import rows


def test_usa(spark):
    files = spark.createDataFrame([("Mary", "F", 7065, 1880), ("Anna", "F", 2604, 1880), ("Ab", "F", 2604, 1880), ("John", "M", 9655, 1880)],
                                  "name string, asab string, number long, year int")
    births = spark.createDataFrame([(1880, 100_000, 90_000)], "year int, male long, female long")
    got = reg.names_usa(files, births)
    assert got.columns == list(reg.CANONICAL)
    assert rows(got, "name", "rank") == [("Ab", 2), ("Anna", 3), ("John", 1), ("Mary", 1)]
    assert dict(rows(got, "name", "proportion"))["Mary"] == 7065 / 90_000


@pytest.mark.parametrize("mode, want", [("reference", [("Ann", 1987), ("Bob", 1987)]),
                                        ("intended", [("Ann", 1987), ("Ann", 1988), ("Bob", 1987), ("Cy", 1988), ("Michael", 1987)])])
def test_new_zealand_duplicate(spark, mode, want):
    columns = "rank int, `x1987...2` string, `x1987...3` int, `x1988...4` string, `x1988...5` int"
    boys = spark.createDataFrame([(1, "BOB", 9, "CY", 8), (100, "MICHAEL", 5, "MICHAEL", 4)], columns)
    girls = spark.createDataFrame([(1, "ANN", 9, "ANN", 8)], columns)
    births = spark.createDataFrame([(1987, 100, 100, 200), (1988, None, None, 190)], "year int, male long, female long, total long")
    got = reg.names_new_zealand(boys, girls, births, mode)
    assert rows(got, "name", "year") == want
    share = {(r["name"], r["year"]): r["proportion"] for r in got.collect()}
    assert share[("Bob", 1987)] == 0.09
    if mode == "intended":
        assert share[("Cy", 1988)] == pytest.approx(8 / 12)


def test_south_australia_ranks_before_dropping_the_total(spark):
    lists = spark.createDataFrame([("female", 2016, "TOTAL", 100, 1), ("female", 2016, "AMY", 60, 1), ("female", 2016, "(NOT", 30, 2),
                                   ("female", 2016, "?LIAM", 10, 3)], "sex string, year int, given_name string, amount long, position int")
    assert rows(reg.names_south_australia(lists), "name", "rank") == [("?Liam", 4), ("Amy", 2)]


def test_ireland_unit_does_not_split_rows(spark):
    columns = "year int, names string, statistic_label string, unit string, value double"
    boys = spark.createDataFrame([(2000, "JACK", "-" * 49 + "Rank", "Rank", 1.0), (2000, "JACK", "-" * 49 + "Number", "Number", 40.0)], columns)
    girls = spark.createDataFrame([(2000, "EMMA", "-" * 50 + "Rank", "Rank", 1.0), (2000, "EMMA", "-" * 50 + "Number", "Number", None)], columns)
    assert rows(reg.names_ireland(boys, girls)) == [(2000, "Jack", 40, 1, "M", "Ireland", 1.0)]


def test_england_wales_year_is_a_number(spark):
    columns = "Name string, `2021 Rank` int, `2021 Count` int, `2020 Rank` int, `2020 Count` int"
    boys = spark.createDataFrame([("NOAH", 1, 30, 2, 20), ("LEO", 2, 10, None, None)], columns)
    girls = spark.createDataFrame([("EVA", 1, 5, 1, 6)], columns)
    got = reg.names_england_wales(boys, girls)
    assert dict(got.dtypes)["year"] == "int"
    assert rows(got, "name", "year", "proportion") == [("Eva", 2020, 1.0), ("Eva", 2021, 1.0), ("Leo", 2021, 0.25), ("Noah", 2020, 1.0), ("Noah", 2021, 0.75)]


def test_northern_ireland_adds_spellings_and_skips_notes(spark):
    table = spark.createDataFrame([(2000, 1, "SEAN", 3), (2000, 1, "Sean", 2), (2000, 2, "EVA", 4), (2000, 9, "SKY", 1)],
                                  "year_of_registration int, sex int, first_name string, number_given_this_name long")
    births = spark.createDataFrame([("2000", 50, 40), ("note: provisional", None, None)], "year string, males long, females long")
    assert rows(reg.names_northern_ireland(table, births), "name", "number", "asab", "proportion") == [
        ("Eva", 4, "F", 0.1), ("Sean", 5, "M", 0.1), ("Sky", 1, "X", None)]


def test_tasmania_rank_rules(spark):
    def block(*pairs):
        return spark.createDataFrame(list(pairs), "name string, number long")
    got = reg.names_tasmania({(2016, "F"): block(("B", 5), ("A", 5)), (2015, "F"): block(("C", 5), ("D", 5), ("E", 1))})
    assert rows(got, "name", "year", "rank") == [("A", 2016, 1), ("B", 2016, 2), ("C", 2015, 1), ("D", 2015, 1), ("E", 2015, 3)]


def test_australia_estimates_old_shares(spark):
    state = spark.createDataFrame([(1950, "Ann", 5, 1, "F", "S"), (1990, "Ann", 5, 1, "F", "S"), (1990, "Bob", 5, 1, "M", "S")],
                                  "year int, name string, number long, rank int, asab string, region string")
    by_sex = spark.createDataFrame([(1990, 100, 50)], "year int, male long, female long")
    totals = spark.createDataFrame([(1950, 100), (1990, 150)], "year int, population long")
    got = reg.names_australia([state, state], by_sex, totals)
    assert rows(got, "name", "year", "number", "proportion") == [("Ann", 1950, 10, 0.2), ("Ann", 1990, 10, 0.2), ("Bob", 1990, 10, 0.1)]
