import pytest
from pyspark.sql import functions as F

from attestry.functions import exprs
from tests.conftest import rows


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("(NOT", "(Not"), ("mary-ann", "Mary-Ann"), ("O'NEIL", "O'neil"), ("?LIAM", "?Liam"), ("JEAN LUC", "Jean Luc"), ("élodie", "Élodie"),
])
def test_title_case(spark, raw, want):
    assert one(spark, exprs.title_case(F.lit(raw))) == want


def test_title_case_groups_like_plain_text(spark):
    df = spark.createDataFrame([("ANNA",), ("anna",), ("Ann",)], "name string").select(exprs.title_case(F.col("name")).alias("name"))
    assert rows(df.groupBy("name").count()) == [("Ann", 1), ("Anna", 2)]


def test_sentence_case(spark):
    assert one(spark, exprs.sentence_case(F.lit("mARY-ann lee"))) == "Mary-ann lee"


@pytest.mark.parametrize("value, digits, want", [(25, -1, 20), (15, -1, 20), (1945, -1, 1940), (1955, -1, 1960), (150, -2, 200), (250, -2, 200)])
def test_half_even(spark, value, digits, want):
    assert one(spark, exprs.half_even(F.lit(value), digits)) == want


def test_abs_log_ratio_needs_both_sexes(spark):
    for f, m in ((0, 5), (5, 0), (0, 0)):
        assert one(spark, exprs.abs_log_ratio(F.lit(f), F.lit(m))) is None
    assert one(spark, exprs.abs_log_ratio(F.lit(4), F.lit(4))) == 0


def test_log_ratio_is_symmetric(spark):
    a, b = (one(spark, exprs.abs_log_ratio(F.lit(x), F.lit(y))) for x, y in ((3, 7), (7, 3)))
    assert a == pytest.approx(b)


def test_exclusion_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    assert rows(df.where(exprs.not_in(F.col("name"), ["a"]))) == [("b",), (None,)]


def test_sums_with_null(spark):
    df = spark.createDataFrame([("k", 1), ("k", None), ("z", 2), ("n", None)], "k string, v int")
    got = {r["k"]: (r["strict"], r["zero"]) for r in df.groupBy("k").agg(
        exprs.sum_strict(F.col("v")).alias("strict"), exprs.sum_or_zero(F.col("v")).alias("zero")).collect()}
    assert got == {"k": (None, 1), "z": (2, 2), "n": (None, 0)}


def test_division_by_zero_is_null(spark):
    assert one(spark, exprs.ratio(F.lit(3), F.lit(0))) is None


def test_recode_default(spark):
    df = spark.createDataFrame([("Male",), ("male",), (None,)], "s string")
    assert rows(df.select(exprs.recode(F.col("s"), {"Male": "M"}, "X").alias("s"))) == [("M",), ("X",), ("X",)]
    assert rows(df.select(exprs.recode(F.col("s"), {"Male": "M"}).alias("s"))) == [("M",), (None,), (None,)]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id int, k string, l string")
    b = spark.createDataFrame([(1, None, "c"), (3, "y", "d")], "id int, k string, r string")
    full = exprs.join_null_safe(a, b, ["id", "k"], "full")
    assert rows(full, "id", "k", "l", "r") == [(1, None, "a", "c"), (2, "x", "b", None), (3, "y", None, "d")]


def test_dimension_join_is_the_same_without_broadcast(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "year int, name string")
    dim = spark.createDataFrame([(1, 10), (2, 20)], "year int, n int")
    small, large = exprs.join_dimension(fact, dim, "year"), exprs.join_dimension(fact, dim, "year", max_bytes=1)
    assert rows(small) == rows(large) == [(1, "a", 10), (2, "b", 20), (3, "c", None)]
