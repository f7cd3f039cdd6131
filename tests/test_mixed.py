"""Random intercepts against dense algebra and differences, proportional fitting against weighted least squares."""

import math
import warnings

import numpy as np
import pytest

from attestry.operators import mixed, models

LEVELS = {"a": ["a0", "a1"], "b": ["b0", "b1"], "c": ["c0", "c1", "c2"], "item": ["i0", "i1", "i2"], "r": ["n", "y"]}


def _cells(family, seed=0, people=25):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(6), rng.integers(0, 2, (6, 2))]).astype(float)
    n = rng.integers(0, 6, (people, 6)).astype(float)
    if family == "poisson":
        n = (n > 1).astype(float)
    y = np.floor(rng.random((people, 6)) * (n + 1)) if family == "binomial" else rng.poisson(3, (people, 6)) * n
    return y, n, rng.integers(1, 4, people).astype(float), x


def _numeric(f, at, h=1e-5):
    return np.array([(f(at + e) - f(at - e)) / (2 * h) for e in np.eye(len(at)) * h])


@pytest.mark.parametrize("family", ["binomial", "poisson"])
@pytest.mark.parametrize("sd", [0.7, 0.05, -0.7])
def test_gradient_and_curvature(family, sd):
    y, n, weight, x = _cells(family)
    at = np.array([0.3, -0.4, 0.2, sd])
    value, slope, curvature = mixed.laplace(y, n, weight, x, at, family)
    assert np.allclose(slope, _numeric(lambda p: mixed.laplace(y, n, weight, x, p, family)[0], at), atol=1e-5)
    assert np.allclose(curvature, _numeric(lambda p: mixed.laplace(y, n, weight, x, p, family)[1], at), atol=1e-4)
    assert value == pytest.approx(mixed.laplace(y, n, weight, x, np.abs(at) * np.sign([1, -1, 1, 1]), family)[0])


def _crossed(model, y, n, weight, at):
    v = np.zeros(3)
    for _ in range(60):
        total, slope, matrix = model.equations(y, n, weight, at, v)
        matrix = matrix + np.eye(3)
        step = np.linalg.solve(matrix, slope - v)
        if np.abs(step).max() < 1e-12:
            break
        v = v + step
    inverse = np.linalg.inv(matrix)
    return total - v @ v / 2 - np.linalg.slogdet(matrix)[1] / 2, model.gradient(model.slopes(y, n, weight, at, v, inverse), inverse)


def _dense(y, n, weight, x, item, at, family):
    """All intercepts at once: the whole Hessian, one row and column for every participant and item."""
    times = weight.astype(int)
    y, n = np.repeat(y, times, 0), np.repeat(n, times, 0)
    people, cells = y.shape
    z = np.zeros((people * cells, people + 3))
    z[np.arange(people * cells), np.repeat(np.arange(people), cells)] = at[-2]
    z[np.arange(people * cells), people + np.tile(item, people)] = at[-1]
    b = np.zeros(people + 3)
    for _ in range(200):
        value, r, w, _, _ = mixed._derivatives(np.tile(x @ at[:-2], people) + z @ b, y.ravel(), n.ravel(), family)
        h = z.T @ (z * w[:, None]) + np.eye(people + 3)
        step = np.linalg.solve(h, z.T @ r - b)
        if np.abs(step).max() < 1e-13:
            break
        b = b + np.clip(step, -1, 1)
    return value.sum() - b @ b / 2 - np.linalg.slogdet(h)[1] / 2


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_crossed_intercepts_against_dense_algebra(family):
    y, n, weight, x = _cells(family)
    item = [0, 1, 2, 0, 1, 2]
    model = mixed.Crossed(x, item, family)
    for spread in ((0.7, 1.1), (0.05, 0.4), (1.3, 0.0)):
        at = np.array([0.3, -0.4, 0.2, *spread])
        value, slope = _crossed(model, y, n, weight, at)
        assert value == pytest.approx(_dense(y, n, weight, x, item, at, family), abs=1e-8)
        assert np.allclose(slope, _numeric(lambda p: _dense(y, n, weight, x, item, p, family), at), atol=1e-4)


def test_crossed_fit(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(0, 1.0, 60), {"i0": -0.8, "i1": 0.1, "i2": 0.9}
    data = [(p, a, i, "y" if rng.random() < 1 / (1 + math.exp(-(0.2 + 0.7 * (a == "a1") + u[p] + v[i]))) else "n")
            for p in range(60) for a in LEVELS["a"] for i in LEVELS["item"] for _ in range(3)]
    data += [(0, "a0", "i0", None), (1, None, "i1", "y")]
    df = spark.createDataFrame(data, "participant int, a string, item string, r string")
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        fit = mixed.crossed_intercepts_glm(df, "r", ["a"], LEVELS)
    assert fit.labels == ["(Intercept)", "a[a1]", "sd(participant)", "sd(item)"] and fit.converged and fit.steps < 40
    # dense likelihood of the same people: none better close by, and flat at the fit
    cells = [(a, i) for a in LEVELS["a"] for i in LEVELS["item"]]
    n = np.array([[sum(d[0] == p and d[1:3] == c for d in data if d[3]) for c in cells] for p in range(60)], float)
    y = np.array([[sum(d[0] == p and d[1:3] == c for d in data if d[3] == "y") for c in cells] for p in range(60)], float)
    x = np.array([[1, a == "a1"] for a, _ in cells], float)

    def likelihood(at):
        return _dense(y, n, np.ones(60), x, [LEVELS["item"].index(i) for _, i in cells], at, "binomial")

    at = np.array(fit.estimates)
    assert fit.deviance == pytest.approx(-2 * likelihood(at), abs=1e-6)
    assert np.abs(_numeric(likelihood, at)).max() < 5e-3
    information = -np.array([_numeric(lambda p, e=e: (likelihood(p + e) - likelihood(p - e)) / 2e-3, at, 1e-3) for e in np.eye(4) * 1e-3])
    assert np.allclose(fit.errors, np.sqrt(np.diag(np.linalg.inv(information))), rtol=1e-2)


def test_unfinished_fits_say_so(spark):
    df = spark.createDataFrame([(p, "a0" if (p + t) % 2 else "a1", "y" if (p * t) % 3 else "n") for p in range(30) for t in range(9)],
                               "participant int, a string, r string")
    with pytest.warns(RuntimeWarning, match="did not converge"):
        fit = mixed.random_intercept_glm(df, "r", ["a"], LEVELS, max_steps=0)
    assert not fit.converged
    assert mixed.random_intercept_glm(df, "r", ["a"], LEVELS).converged


def test_poisson_intercepts_of_all_factors_stay_few_jobs(spark):
    rng = np.random.default_rng(2)
    data = [(p, a, b, c, int(rng.poisson(math.exp(0.8 + 0.5 * rng.normal() * (p % 3))))) for p in range(40) for a in LEVELS["a"]
            for b in LEVELS["b"] for c in LEVELS["c"]]
    df = spark.createDataFrame(data, "participant int, a string, b string, c string, n int")
    fit = mixed.random_intercept_glm(df, "n", ["a * b * c"], LEVELS, family="poisson")
    assert fit.converged and fit.steps < 15 and len(fit.labels) == 13 and all(0 < e < 10 for e in fit.errors)


# --- log-linear models ---------------------------------------------------------------------------


@pytest.mark.parametrize("gap", ["true", "NOT (a = 'a1' AND c = 'c2')", "a = 'a0' OR b = 'b1'"])
def test_proportional_fitting_against_least_squares(spark, gap):
    rng = np.random.default_rng(3)
    data = [(a, b, c, int(rng.integers(5, 60))) for a in LEVELS["a"] for b in LEVELS["b"] for c in LEVELS["c"]]
    table = spark.createDataFrame(data + [("a0", "other", "c0", 9), (None, "b0", "c0", 9)], "a string, b string, c string, n long").where(
        f"a IS NULL OR b = 'other' OR ({gap})")
    formulas = models.loglinear_formulas("a", "b", "c") | {"none": []}
    got = models.loglinear_fits(table, formulas, LEVELS)
    inside = table.where("a IS NOT NULL AND b <> 'other'")
    want = models.poisson_models(inside, {k: v for k, v in formulas.items() if v}, LEVELS)
    for name, fit in want.items():
        assert got[name].deviance == pytest.approx(fit.deviance, abs=1e-5) and got[name].df_residual == fit.df_residual
        assert got[name].converged and got[name].rows == fit.rows
    assert got["none"].df_residual == got["none"].rows - 1


def test_proportional_fitting_needs_lower_terms(spark):
    table = spark.createDataFrame([("a0", "b0", 1)], "a string, b string, n int")
    with pytest.raises(ValueError, match="lacks"):
        models.loglinear_fits(table, {"x": ["a:b"]}, LEVELS)


def test_a_table_too_large_for_one_task_is_fitted_by_least_squares(spark, monkeypatch):
    table = spark.createDataFrame([(a, b, 5 + i) for i, (a, b) in enumerate((a, b) for a in LEVELS["a"] for b in LEVELS["b"])], "a string, b string, n int")
    small = models.loglinear_fits(table, {"x": ["a", "b"]}, LEVELS)["x"]
    monkeypatch.setattr(models, "MAX_CELLS", 3)
    large = models.loglinear_fits(table, {"x": ["a", "b"]}, LEVELS)["x"]
    assert small.deviance == pytest.approx(large.deviance, abs=1e-6) and small.df_residual == large.df_residual
