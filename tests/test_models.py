import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import density, mixed, models
from tests.conftest import rows

LEVELS = {"a": ["a0", "a1"], "b": ["b0", "b1"], "c": ["c0", "c1", "c2"]}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    data = [(a, b, c, int(rng.integers(5, 60))) for a in LEVELS["a"] for b in LEVELS["b"] for c in LEVELS["c"]]
    return spark.createDataFrame(data, "a string, b string, c string, n long")


def test_terms(spark):
    assert models.expand_terms(["a * b", "c"]) == [("a",), ("b",), ("c",), ("a", "b")]
    labels = [name for name, _ in models.design_columns(["a * c"], LEVELS)]
    assert labels == ["a[a1]", "c[c1]", "c[c2]", "a[a1]:c[c1]", "a[a1]:c[c2]"]


def test_numeric_terms_are_not_dummy_coded(spark):
    assert [name for name, _ in models.design_columns(["a * x"], LEVELS)] == ["a[a1]", "x", "a[a1]:x"]


def test_saturated_model_reproduces_the_table(spark, table):
    fit = models.poisson_loglinear(table, ["a * b * c"], LEVELS)
    assert fit.df_residual == 0 and abs(fit.deviance) < 1e-6
    first = table.where("a = 'a0' AND b = 'b0' AND c = 'c0'").first()["n"]
    assert fit.estimates[0] == pytest.approx(math.log(first), abs=1e-6)


def test_nested_deviances_grow(spark, table):
    fits = models.poisson_models(table, models.loglinear_formulas("a", "b", "c"), LEVELS)
    for large, small in models.loglinear_pairs("a", "b", "c").values():
        assert fits[small].deviance >= fits[large].deviance - 1e-6 and fits[small].df_residual > fits[large].df_residual
    compared = models.compare_models(spark, {"x": (fits["pairwise"], fits["saturated"])}).first()
    assert compared["df"] == 2 and 0 <= compared["p"] <= 1


def test_unobserved_combinations_alias_columns(spark, table):
    gap = table.where("NOT (a = 'a1' AND c = 'c2')")
    fit = models.poisson_loglinear(gap, ["a * b * c"], LEVELS)
    dead = [label for label, b in zip(fit.labels, fit.estimates) if math.isnan(b)]
    assert dead == ["a[a1]:c[c2]", "a[a1]:b[b1]:c[c2]"]
    assert fit.df_residual == 0 and abs(fit.deviance) < 1e-6
    assert rows(models.coefficient_table(spark, fit).where("estimate IS NULL"), "term") == sorted((d,) for d in dead)


def test_two_by_two_log_odds(spark):
    counts = {("a0", "n"): 40, ("a0", "y"): 10, ("a1", "n"): 15, ("a1", "y"): 35}
    data = [(a, r) for (a, r), n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(data, "a string, r string")
    fit = models.logistic(df, "r", ["a"], {"a": ["a0", "a1"], "r": ["n", "y"]})
    odds = math.log((35 * 40) / (15 * 10))
    assert fit.estimates[1] == pytest.approx(odds, abs=1e-6)
    assert fit.errors[1] == pytest.approx(math.sqrt(1 / 40 + 1 / 10 + 1 / 15 + 1 / 35), abs=1e-5)
    assert fit.rows == 100 and fit.df_residual == 98
    single = -2 * sum(n * math.log(n / 50) for n in counts.values())
    assert fit.deviance == pytest.approx(single, abs=1e-6)


def test_all_other_levels_are_successes(spark):
    df = spark.createDataFrame([("He",), ("She",), ("They",), ("They",)] * 10, "s string").withColumn("a", F.when(F.rand(1) > 0.5, "a0").otherwise("a1"))
    fit = models.logistic(df.withColumn("a", F.lit("a0")).unionByName(df.withColumn("a", F.lit("a1"))), "s", ["a"],
                          {"s": ["He", "She", "They"], "a": ["a0", "a1"]})
    assert fit.estimates[0] == pytest.approx(math.log(3), abs=1e-6) and abs(fit.estimates[1]) < 1e-6


@pytest.mark.parametrize("x, df, want", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (24.995790, 15, 0.05), (0.0, 4, 1.0)])
def test_chi_square_tail(x, df, want):
    assert models.chi_square_tail(x, df) == pytest.approx(want, abs=1e-6)


def test_random_intercept_against_direct_integration(spark):
    rng = np.random.default_rng(11)
    data = []
    for p in range(60):
        u = rng.normal(0, 1.0)
        for t in range(16):
            a = "a1" if t % 2 else "a0"
            data.append((p, a, "y" if rng.random() < 1 / (1 + math.exp(-(0.2 + 0.8 * (a == "a1") + u))) else "n"))
    df = spark.createDataFrame(data, "participant int, a string, r string")
    fit = mixed.random_intercept_glm(df, "r", ["a"], {"a": ["a0", "a1"], "r": ["n", "y"]})
    # likelihood by quadrature over a fine grid of intercepts
    grid = np.linspace(-6, 6, 401)
    weight = np.exp(-grid ** 2 / 2) / math.sqrt(2 * math.pi) * (grid[1] - grid[0])
    cells = {}
    for p, a, r in data:
        k = cells.setdefault(p, {"a0": [0, 0], "a1": [0, 0]})[a]
        k[0] += r == "y"
        k[1] += 1

    def deviance(b0, b1, sd):
        total = 0.0
        for c in cells.values():
            eta0, eta1 = b0 + sd * grid, b0 + b1 + sd * grid
            like = sum(y * eta - n * np.logaddexp(0, eta) for (y, n), eta in ((c["a0"], eta0), (c["a1"], eta1)))
            total += math.log(float(np.exp(like) @ weight))
        return -2 * total

    at = deviance(*fit.estimates)
    assert fit.deviance == pytest.approx(at, rel=0.003)
    for step in ((0.2, 0, 0), (-0.2, 0, 0), (0, 0.2, 0), (0, -0.2, 0), (0, 0, 0.3), (0, 0, -0.3)):
        assert deviance(*[e + s for e, s in zip(fit.estimates, step)]) > at
    assert fit.labels[-1] == "sd(intercept)" and all(e > 0 for e in fit.errors)


def test_profiles_count_equal_participants(spark):
    df = spark.createDataFrame([(p, "a0", 1.0) for p in range(5)] + [(9, "a1", 1.0)], "participant int, a string, v double")
    got = mixed.participant_profiles(df, "participant", [{"a": "a0"}, {"a": "a1"}], F.col("v"), F.lit(1.0))
    assert sorted((list(r["y"]), r["weight"]) for r in got.collect()) == [([0.0, 1.0], 1.0), ([1.0, 0.0], 5.0)]


def _brute_density(x, y, lim, grid):
    n = len(x)

    def width(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(np.std(v, ddof=1), (q3 - q1) / 1.34) * n ** -0.2

    g = np.linspace(*lim, grid)
    hx, hy = width(x), width(y)
    kx = np.exp(-0.5 * ((g[:, None] - x) / hx) ** 2)
    ky = np.exp(-0.5 * ((g[:, None] - y) / hy) ** 2)
    return kx @ ky.T / (2 * math.pi * n * hx * hy)


@pytest.mark.parametrize("points_per_task, slice_rows", [(100, 30), (100_000, 100_000)])
def test_density_against_numpy(spark, points_per_task, slice_rows):
    rng = np.random.default_rng(5)
    data = [(g, float(rng.normal(0.5, 0.2)), float(rng.uniform(0, 1))) for g, n in (("hot", 900), ("cold", 60)) for _ in range(n)]
    data += [("flat", 0.5, 0.5)] * 5 + [(None, float(rng.uniform()), float(rng.uniform())) for _ in range(50)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = density.density2d(df, ["g"], "x", "y", (0.0, 1.0), (0.0, 1.0), 15, 10, points_per_task, slice_rows).toPandas()
    assert set(got["g"].dropna()) == {"hot", "cold"} and got["g"].isna().any()
    for key in ("hot", "cold", None):
        inside = np.array([(x, y) for g, x, y in data if g == key and 0 <= x <= 1 and 0 <= y <= 1])
        want = _brute_density(inside[:, 0], inside[:, 1], (0, 1), 15)
        part = got[got["g"].isna() if key is None else got["g"] == key]
        ours = np.zeros((15, 15))
        ours[part["ix"], part["iy"]] = part["density"]
        assert np.allclose(ours, want, rtol=1e-9)
        assert part["ndensity"].max() == pytest.approx(1) and part["level"].between(1, 10).all()


def test_levels_are_bounded(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("a"))
    with pytest.raises(ValueError):
        models.factor_levels(df, ["a"])
    assert models.factor_levels(df.limit(2), ["a"])["a"] == sorted(r[0] for r in rows(df.limit(2)))
