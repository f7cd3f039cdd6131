import math

import pytest
from pyspark.sql import functions as F

from attestry.operators import balance, profile, stimuli
from tests.conftest import rows

FACT = "name string, year int, region string, asab string, number long"


@pytest.fixture(scope="module")
def fact(spark):
    data = []
    for year in (2000, 2001, 2002):
        data += [("Robin", year, "USA", "F", 100 + year % 5), ("Robin", year, "USA", "M", 100),
                 ("Mary", year, "USA", "F", 900), ("Kim", year, "Ireland", "F", 30), ("Kim", year, "Ireland", "M", 60)]
    data += [("Mary", 2000, "USA", "M", 3), ("Baby", 2000, "USA", "F", 5), ("Baby", 2000, "USA", "M", 5),
             ("Kim", 2000, "USA", "F", 10), ("Kim", 2000, "USA", "M", 10), ("Rain", 2000, "USA", "X", 4)]
    return spark.createDataFrame(data, FACT)


def test_grains_agree(fact):
    grains = {(r["grain"], r["name"], r["year"], r["region"]): r for r in balance.log_ratio_grains(fact).collect()}
    for grain, single, keys in (("annual", balance.log_ratio_annual(fact), ("year",)),
                                ("regional", balance.log_ratio_regional(fact), ("region",)),
                                ("combined", balance.log_ratio_combined(fact), ())):
        for r in single.collect():
            key = (grain, r["name"], r["year"] if "year" in keys else None, r["region"] if "region" in keys else None)
            assert (r["total_afab"], r["total_amab"], r["log_ratio"]) == tuple(grains[key][c] for c in ("total_afab", "total_amab", "log_ratio"))
    assert grains[("combined", "Rain", None, None)]["log_ratio"] is None


def test_placeholders_go(fact):
    assert "Baby" not in [r[0] for r in rows(balance.log_ratio_combined(fact))]


def test_profile_counts_two_sided_cells_only(fact):
    got = {r["name"]: r for r in balance.balance_profile(fact).collect()}
    assert set(got) == {"Robin", "Mary", "Kim"}
    assert got["Mary"]["entries"] == 1 and got["Mary"]["sd_logratio"] is None
    assert got["Kim"]["regions"] == 2 and got["Kim"]["entries"] == 4
    assert got["Kim"]["mean_F"] == pytest.approx((30 * 3 + 10) / 4 / 2)
    assert got["Kim"]["median_logratio"] == pytest.approx(math.log(2))


def _profile(spark, data):
    columns = "name string, total_F long, total_M long, entries long, regions long, mean_F double, mean_M double, mean_logratio double, " \
              "median_logratio double, sd_logratio double, se_logratio double, max_logratio double, min_logratio double"
    return spark.createDataFrame(data, columns)


def test_rank_tie_chain(spark):
    # equal minima fall to the maximum, then the deviation with NULL last, then commonness, then the name
    flat = [("d", 10, 10, 1, 1, 10.0, 10.0, 0.5, 0.5, None, None, 0.9, 0.1), ("c", 10, 10, 2, 1, 10.0, 10.0, 0.5, 0.5, 0.2, 0.1, 0.9, 0.1),
            ("b", 10, 10, 2, 1, 10.0, 10.0, 0.5, 0.5, 0.2, 0.1, 0.9, 0.1), ("a", 10, 10, 2, 1, 10.0, 10.0, 0.4, 0.5, 0.2, 0.1, 0.8, 0.1)]
    for limit in (1, 100):
        got = {r["name"]: r for r in balance.balance_rank(_profile(spark, flat), slice_rows=limit).collect()}
        assert [n for n, r in sorted(got.items(), key=lambda kv: kv[1]["order_logratio"])] == ["a", "b", "c", "d"]
        assert sorted(r["rank_order"] for r in got.values()) == [1, 2, 3, 4]
        assert all(r["combined_order"] == r["order_logratio"] + r["order_mean"] + 3 * r["order_common"] for r in got.values())


def test_rank_is_the_same_for_swapped_sexes(fact):
    swapped = fact.withColumn("asab", F.when(F.col("asab") == "F", "M").when(F.col("asab") == "M", "F").otherwise("X"))
    a, b = (balance.balance_rank(balance.balance_profile(df)).select("name", "rank_order") for df in (fact, swapped))
    assert rows(a) == rows(b)


def test_norming_filter_drops_single_entries(spark, fact):
    one_region = balance.balance_profile(fact.where("region = 'USA'"), region_scaled=False)
    kept = balance.norming_filter(one_region, total_at_least=100)
    assert rows(kept, "name") == [("Robin",)]


def test_discarded(fact):
    r = balance.discarded_entries(fact).first()
    assert (r["discarded"], r["kept"]) == (3, 9)
    assert r["share"] == pytest.approx(0.25)


def test_columns_by_count(spark):
    summary = spark.createDataFrame([("d", 4), ("a", 4), ("x", 5), ("u", 1)], "name string, count int")
    for limit in (1, 100):
        got = balance.columns_by_count(summary, slice_rows=limit)
        assert rows(got) == [(1, "a", "x"), (2, "d", None)]


def test_international_lists_regions_in_order(spark):
    data = [("Kim", 2000, r, s, n, 0.1) for r, f, m in (("USA", 50, 40), ("Ireland", 9, 8), ("Canada", 100, 4)) for s, n in (("F", f), ("M", m))]
    df = spark.createDataFrame(data, FACT + ", proportion double")
    names = spark.createDataFrame([("Kim",)], "name string")
    assert rows(balance.international_unisex(df, names)) == [("Kim", 2, "Ireland; USA")]


def test_pairwise_summary_known_rows(spark):
    # Published rows (locale, name, rank F, rank M, count F, count M, total F, total M, and the derived columns).
    published = [
        ("USA", "Jordan", 75.0, 38.0, None, None, 43090, 100806, -37.0, 56.5, 71948.0, 143896, 11.876846, 37.0),
        ("USA", "Riley", 67.0, 107.0, None, None, 45427, 39526, 40.0, 87.0, 42476.5, 84953, 11.349853, 40.0),
        ("EW", "Gurpreet", 891.4, 954.6, 24.8, 15.8, 124, 79, 63.2, 923.0, 20.3, 203, 5.313206, 63.2),
        ("EW", "Charlie", 99.8, 35.6, 517.2, 2235.8, 2586, 11179, -64.2, 67.7, 1376.5, 13765, 9.529884, 64.2),
    ]
    long = [(p[0], p[1], s, p[2 + i], p[4 + i], p[6 + i]) for p in published for i, s in enumerate("FM")]
    df = spark.createDataFrame(long, "locale string, name string, asab string, rank double, count double, total long")
    got = {(r["locale"], r["name"]): r for r in balance.pairwise_rank_summary(df).collect()}
    for p in published:
        r = got[p[:2]]
        assert (r["rank_diff"], r["rank_mean"], r["count_mean"], r["total_count"], r["log_count"], r["abs_diff"]) == pytest.approx(p[8:], abs=1e-6)


def test_unisex_counts_years_of_the_smaller_sex(spark):
    data = [("ann", 2000 + y, "USA", "F", 5, 1, 0.1) for y in range(4)] + [("ann", 2000 + y, "USA", "M", 5, 1, 0.1) for y in range(2)]
    data += [("bob", 2000, "USA", "M", 5, 1, 0.1)]
    df = spark.createDataFrame(data, "name string, year int, region string, asab string, number long, rank int, proportion double")
    got = balance.unisex_dataset(df)
    assert {r["name"] for r in got.collect()} == {"Ann"}
    assert rows(got, "year", "year_count_reg", "year_count") == [(2000, 2, 2), (2001, 2, 2), (2002, 0, 2), (2003, 0, 2)]


def test_angle_of_equal_counts_is_zero(spark):
    cells = spark.createDataFrame([("a", 2000, "r", 7, 7), ("a", 2001, "r", 7, 0), ("a", 2002, "r", 0, 7)],
                                  "name string, year int, region string, afab long, amab long")
    assert rows(balance.balance_angle(cells), "plot_degrees", "n") == [(-45, 1), (0, 1), (45, 1)]


def test_log_share_without_scale_is_null(spark):
    cells = spark.createDataFrame([("a", 2000, "r", 1, 0), ("b", 2000, "r", 100, 10)], "name string, year int, region string, afab long, amab long")
    got = {r["name"]: (r["logprop_afab"], r["logprop_amab"]) for r in balance.log_scaled_share(cells).collect()}
    assert got["a"] == (None, None) and got["b"] == pytest.approx((1.0, 0.5))


def test_strata_overlap_and_blocks(spark):
    combined = spark.createDataFrame([("big", 1, 10, 10_000_000, 200_000, 10_200_000, 3.9), ("even", 1, 10, 9000, 9000, 18000, 0.0)],
                                     "name string, regions int, years int, total_afab long, total_amab long, total_people long, log_ratio double")
    strata = stimuli.biased_strata(combined)
    assert rows(strata, "name", "type", "type_rank") == [("big", "afab-biased", 1), ("big", "amab-biased", 1), ("even", "equi-biased", 1)]
    ranks = spark.createDataFrame([("n", r, "t") for r in (10, 11, 30, 90, 170, 300, 301)], "name string, type_rank int, type string")
    assert [b for (b,) in rows(stimuli.block_by_rank(ranks), "freq_block")] == [0, 1, 1, 2, 3, 4, 5]


def test_pilot_rounds_twice(spark):
    df = spark.createDataFrame([("a",)] * 145 + [("b",)] * 94 + [("c",)] * 250, "name string")
    assert rows(stimuli.pilot_list(df), "name", "freq_block") == [("a", 100), ("c", 200)]


def test_bins_are_centred_and_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (0, 25, 26, 75, 76)], "v int")
    assert rows(profile.histogram(df, "v", binwidth=50)) == [(0.0, 2), (50.0, 2), (100.0, 1)]


def test_longevity(fact):
    got = {(r["name"], r["asab"]): r["longstandingness"] for r in profile.longevity(fact.where("region = 'USA'")).collect()}
    assert got[("Robin", "F")] == 1.0 and got[("Mary", "M")] == pytest.approx(1 / 3)
    assert rows(profile.longstanding_unisex(profile.longevity(fact))) == [("Kim",), ("Robin",)]


def test_distribution_split_equals_window(fact):
    a, b = (profile.total_distribution(fact, limit) for limit in (3, 1000))
    assert rows(a) == rows(b, *a.columns)


def test_unisex_counts_years_whatever_the_number(spark):
    """An unknown or zero count attests its year; a missing row does not."""
    data = [("kim", 2000, "r", "F", 5), ("kim", 2000, "r", "M", 3), ("kim", 2001, "r", "F", None), ("kim", 2001, "r", "M", 0), ("kim", 2002, "r", "F", 4)]
    df = spark.createDataFrame(data, "name string, year int, region string, asab string, number long").selectExpr("*", "1 AS rank", "0.5D AS proportion")
    got = {r["year"]: (r["number_AFAB"], r["number_AMAB"], r["year_count_reg"], r["year_count"]) for r in balance.unisex_dataset(df).collect()}
    assert got == {2000: (5, 3, 2, 2), 2001: (None, 0, 2, 2), 2002: (4, 0, 0, 2)}
