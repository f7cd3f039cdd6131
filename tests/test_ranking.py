"""The split path has to agree with the single window, also when one group holds most rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.operators import ranking
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    data = [("hot" if i % 3 else f"k{i % 50}", int(rng.integers(0, 40)), f"n{i:05d}") for i in range(3000)]
    return spark.createDataFrame(data, "k string, v int, name string")


def test_split_rank_equals_window(skewed):
    window = ranking.ordinal_rank(skewed, ["-v", "name"], ["k"])
    split = ranking.ordinal_rank(skewed, ["-v", "name"], ["k"], slice_rows=50)
    assert rows(window) == rows(split, *window.columns)


def test_split_rank_without_groups(skewed):
    split = ranking.ordinal_rank(skewed, ["v", "name"], slice_rows=50).collect()
    assert sorted(r["rank"] for r in split) == list(range(1, 3001))
    in_order = sorted(split, key=lambda r: r["rank"])
    assert [(r["v"], r["name"]) for r in in_order] == sorted((r["v"], r["name"]) for r in split)


def test_split_uses_several_slices(skewed, spark):
    ranged = skewed.repartitionByRange(8, "k", "v", "name")
    assert ranged.where("k = 'hot'").select(ranking.F.spark_partition_id().alias("p")).distinct().count() > 1


def test_null_groups_and_values(spark):
    df = spark.createDataFrame([(None, 3, "a"), (None, None, "b"), ("x", 1, "c"), (None, 5, "d")], "k string, v int, name string")
    for limit in (1, 100):
        got = ranking.ordinal_rank(df, ["-v", "name"], ["k"], null_when=ranking.F.col("v").isNull(), slice_rows=limit)
        assert {r["name"]: r["rank"] for r in got.collect()} == {"d": 1, "a": 2, "b": None, "c": 1}


def test_average_rank_truncates(spark):
    df = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 1), ("e", None)], "name string, v int")
    for limit in (1, 100):
        got = {r["name"]: r["rank"] for r in ranking.average_rank(df, "v", slice_rows=limit).collect()}
        assert got == {"a": 1, "b": 2, "c": 2, "d": 4, "e": None}
        exact = {r["name"]: r["rank"] for r in ranking.average_rank(df, "v", truncate=False, slice_rows=limit).collect()}
        assert exact["b"] == 2.5


def test_random_rank_is_repeatable_and_respects_values(skewed):
    a, b = (ranking.random_rank(skewed, "v", "name", 231, ["k"]).collect() for _ in range(2))
    assert sorted(a) == sorted(b)
    other = ranking.random_rank(skewed, "v", "name", 5, ["k"]).collect()
    assert sorted(a) != sorted(other)
    hot = sorted((r for r in a if r["k"] == "hot"), key=lambda r: r["rank"])
    assert [r["v"] for r in hot] == sorted((r["v"] for r in hot), reverse=True)


@pytest.mark.parametrize("limit", [40, 10_000])
def test_quantiles_match_numpy(skewed, limit):
    got = ranking.group_quantiles(skewed, "v", {"q1": 0.25, "med": 0.5, "q9": 0.9}, ["k"], limit).collect()
    data = skewed.toPandas()
    assert len(got) == data["k"].nunique()
    for r in got:
        v = data.loc[data["k"] == r["k"], "v"]
        assert (r["q1"], r["med"], r["q9"]) == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.9])))


def test_quantiles_without_groups(skewed):
    got = ranking.group_quantiles(skewed, "v", {"med": 0.5}, slice_rows=50).first()["med"]
    assert got == pytest.approx(float(np.median(skewed.toPandas()["v"])))


def test_independent_ranks_of_one_partitioning(spark, skewed):
    data = skewed.withColumn("w", ranking.F.when(ranking.F.col("v") % 7 > 0, -ranking.F.col("v") / 3)).unionByName(
        spark.createDataFrame([(None, None, "z", None), ("x", None, "y", 0.0)], "k string, v int, name string, w double"))
    orders = {"a": ["-v", "name"], "b": ["name"], "c": [ranking.F.round("w", 1), "-k", "v", "name"]}
    for limit in (40, 10_000, None):
        got = ranking.independent_ranks(data, "name", orders, limit)
        for out, order in orders.items():
            alone = ranking.ordinal_rank(data.withColumn("r", ranking.F.round("w", 1)), ["r" if not isinstance(o, str) else o for o in order], out=out, slice_rows=limit)
            assert rows(got, "name", out) == rows(alone, "name", out)


def test_rows_are_stored_once(spark, skewed, monkeypatch):
    stored = []
    held = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, label="table": stored.append(df.columns) or held(df, label))
    ranking.ordinal_rank(skewed, ["-v", "name"], ["k"]).collect()
    ranking.independent_ranks(skewed, "name", {"a": ["v", "name"], "b": ["name"]}).collect()
    assert stored == [["k", "v", "name", "__at"], ["name", "__order", "__at"]]


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=40))
def test_running_total_property(spark, values):
    data = [(k, v, i) for i, (k, v) in enumerate(values)]
    df = spark.createDataFrame(data, "k string, w int, i int")
    got = ranking.running_total(df, ["i"], ranking.F.col("w"), ["k"], slice_rows=50).collect()
    for r in got:
        assert r["running"] == sum(w for k, w, i in data if k == r["k"] and i <= r["i"])
