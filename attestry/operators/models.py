"""Log-linear and logistic models on factor tables, with nested comparisons.

Data are reduced to one weighted row per factor combination before fitting, so
the iterations run over the design cells and not over the trials.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import UnsupportedOperationException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A factor may have at most this many levels; more would not be a factor but an id.
MAX_LEVELS = 500
# Weighted least squares steps of a fit; one that needs them all is reported as not converged.
MAX_STEPS = 50
# Rounds of proportional fitting, and combinations of levels that one task may hold.
FITTING_STEPS, MAX_CELLS = 10_000, 1 << 20


def factor_levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list]:
    """Sorted levels of each factor."""
    levels = {}
    for factor in factors:
        rows = df.select(factor).where(F.col(factor).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{factor} has more than {MAX_LEVELS} levels")
        levels[factor] = sorted(r[0] for r in rows)
    return levels


def expand_terms(terms: Sequence[str]) -> list[tuple[str, ...]]:
    """``a * b`` stands for a, b and a:b; terms come out by order, each once."""
    out: list[tuple[str, ...]] = []
    for term in terms:
        factors = [f.strip() for f in term.split("*")]
        if len(factors) == 1:
            out.append(tuple(f.strip() for f in term.split(":")))
        else:
            out += [c for n in range(1, len(factors) + 1) for c in itertools.combinations(factors, n)]
    unique = list(dict.fromkeys(out))
    return sorted(unique, key=len)


def design_columns(terms: Sequence[str], levels: Mapping[str, Sequence]) -> list[tuple[str, Column]]:
    """Treatment-coded columns; the first level is the reference, factors without levels are numeric."""
    columns = []
    for term in expand_terms(terms):
        choices = []
        for factor in term:
            if factor in levels:
                choices.append([(f"{factor}[{v}]", (F.col(factor) == F.lit(v)).cast("double"))
                                for v in levels[factor][1:]])
            else:
                choices.append([(factor, F.col(factor).cast("double"))])
        for combo in itertools.product(*choices):
            label = ":".join(name for name, _ in combo)
            columns.append((label, reduce(lambda a, b: a * b, [c for _, c in combo])))
    return columns


def design_matrix(df: DataFrame, terms: Sequence[str], levels: Mapping[str, Sequence], out: str = "features",
                  keep: Sequence[int] | None = None) -> tuple[DataFrame, list[str]]:
    """Add the feature vector of a formula; returns the column labels beside it.

    ``keep`` limits the vector to some of the columns.
    """
    columns = design_columns(terms, levels)
    if keep is not None:
        columns = [columns[i] for i in keep]
    temp = {f"__x{i}": c for i, (_, c) in enumerate(columns)}
    wide = VectorAssembler(inputCols=list(temp), outputCol=out).transform(df.withColumns(temp))
    return wide.drop(*temp), [label for label, _ in columns]


@dataclass(frozen=True)
class Fit:
    """Coefficients and fit statistics of one model."""

    labels: list[str]
    estimates: list[float]
    errors: list[float]
    deviance: float
    df_residual: int
    rows: int
    converged: bool = True
    steps: int = 0

    @property
    def terms(self) -> int:
        return len(self.labels)


@contextmanager
def _held(table: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Keep a design table in memory while models iterate over it; its partitions follow its size."""
    held = table.cache()
    try:
        yield held, held.count()
    finally:
        held.unpersist()


def _cross_products(data: DataFrame, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """X'WX of the design rows with intercept; the tasks return one partial matrix each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), np.vstack(batch["x"].to_numpy())])
            total += (x * weigh(x, batch["__weight"].to_numpy())[:, None]).T @ x
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    parts = data.select(vector_to_array("features").alias("x"), "__weight").mapInPandas(run, "i INT, row ARRAY<DOUBLE>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for i, j, v in sums:
        out[i, j] = v
    return out


def independent_columns(products: np.ndarray) -> list[int]:
    """Columns that are not a combination of the columns before them."""
    kept: list[int] = []
    for j in range(len(products)):
        left = products[j, j]
        if kept:
            cross = products[kept, j]
            left -= cross @ np.linalg.solve(products[np.ix_(kept, kept)], cross)
        if left > 1e-8 * max(products[j, j], 1.0):
            kept.append(j)
    return kept


def _information_errors(data: DataFrame, estimates: np.ndarray, family: str) -> list[float]:
    """Standard errors from the Fisher information, summed over the design rows."""

    def weigh(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        mu = np.exp(x @ estimates)
        return w * (mu if family == "poisson" else mu / (1 + mu) ** 2)

    information = _cross_products(data, weigh, len(estimates))
    return [float(e) for e in np.sqrt(np.clip(np.diag(np.linalg.pinv(information)), 0, None))]


def _complete(cells: DataFrame, formulas: Mapping[str, Sequence[str]], levels: Mapping[str, Sequence]) -> bool:
    """Whether every combination of the factors occurs, so that no column can be aliased."""
    factors = sorted({f for terms in formulas.values() for term in expand_terms(terms) for f in term})
    if not all(f in levels for f in factors):
        return False
    # one row per combination at most, and levels are bounded
    seen = cells.where(reduce(lambda a, b: a & b, [F.col(f).isin(list(levels[f])) for f in factors]))
    return seen.select(*factors).distinct().count() == math.prod(len(levels[f]) for f in factors)


def _fit(cells: DataFrame, terms: Sequence[str], levels: Mapping[str, Sequence], family: str, link: str,
         rows: int, base_deviance: float = 0.0, complete: bool = True) -> Fit:
    """Fit on rows with ``__label`` and ``__weight``; ``rows`` counts observations, not design cells.

    Unobserved combinations can alias columns; those get no estimate, the first
    of a dependent set is kept.
    """
    data, labels = design_matrix(cells, terms, levels)
    used = list(range(len(labels)))
    if not complete:
        kept = independent_columns(_cross_products(data, lambda x, w: np.ones(len(x)), len(labels) + 1))
        used = [j - 1 for j in kept if j > 0]
        data, _ = design_matrix(cells, terms, levels, keep=used)
    glm = GeneralizedLinearRegression(family=family, link=link, labelCol="__label", weightCol="__weight",
                                      featuresCol="features", maxIter=MAX_STEPS, tol=1e-9)
    model = glm.fit(data)
    summary = model.summary
    found = [float(model.intercept), *[float(b) for b in model.coefficients]]
    try:
        # Spark lists the intercept last
        *slopes, first = (float(e) for e in summary.coefficientStandardErrors)
        errors = [first, *slopes]
    except UnsupportedOperationException:
        # all cells are alike, so no normal equations were solved
        errors = _information_errors(data, np.array(found), family)
    places = [0, *[j + 1 for j in used]]
    estimate, error = dict(zip(places, found)), dict(zip(places, errors))
    everything = range(len(labels) + 1)
    steps = int(summary.numIterations)
    if steps >= MAX_STEPS:
        warnings.warn(f"the fit did not converge in {steps} steps", RuntimeWarning, stacklevel=2)
    return Fit(
        labels=["(Intercept)", *labels],
        estimates=[estimate.get(j, math.nan) for j in everything],
        errors=[error.get(j, math.nan) for j in everything],
        deviance=float(summary.deviance) + base_deviance,
        df_residual=rows - len(places),
        rows=rows,
        converged=steps < MAX_STEPS,
        steps=steps,
    )


def poisson_models(table: DataFrame, formulas: Mapping[str, Sequence[str]], levels: Mapping[str, Sequence],
                   count: str = "n") -> dict[str, Fit]:
    """Log-linear models of one contingency table, which is computed once for all of them.

    Unobserved combinations are absent rows, not zeros.
    """
    counted = table.withColumns({"__label": F.col(count).cast("double"), "__weight": F.lit(1.0)})
    with _held(counted) as (cells, rows):
        complete = _complete(cells, formulas, levels)
        return {name: _fit(cells, terms, levels, "poisson", "log", rows, complete=complete)
                for name, terms in formulas.items()}


def _proportional_fit(n: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, int, bool]:
    """Expected counts whose sums over every margin in ``codes`` are those of ``n``: margins are scaled in turn until nothing moves."""
    margins = [np.bincount(c, n) for c in codes]
    fit = np.ones(len(n))
    for step in range(1, FITTING_STEPS + 1):
        before = fit
        for code, margin in zip(codes, margins):
            held = np.bincount(code, fit)
            fit = fit * np.divide(margin, held, out=np.zeros(len(held)), where=held > 0)[code]
        if np.max(np.abs(fit - before), initial=0) <= 1e-11 * max(n.max(initial=0), 1):
            return fit, step, True
    return fit, FITTING_STEPS, False


def loglinear_fits(table: DataFrame, formulas: Mapping[str, Sequence[str]], levels: Mapping[str, Sequence],
                   count: str = "n") -> dict[str, Fit]:
    """Deviances of hierarchical log-linear models of one contingency table, by iterative proportional fitting.

    All formulas are fitted in one job, a task for each; there is no design
    matrix and there are no coefficients. ``table`` has a row for each observed
    combination of the factors, absent ones are no zeros; rows with a level
    outside ``levels`` do not count. A table that could pass MAX_CELLS is fitted
    by weighted least squares (:func:`poisson_models`) in place of one task.
    """
    parsed = {name: expand_terms(terms) for name, terms in formulas.items()}
    for name, terms in parsed.items():
        lower = {t for term in terms for k in range(1, len(term)) for t in itertools.combinations(term, k)}
        if missing := {frozenset(t) for t in lower} - {frozenset(t) for t in terms}:
            raise ValueError(f"{name} lacks {sorted(map(sorted, missing))} below its interactions")
    factors = sorted({f for terms in parsed.values() for term in terms for f in term})
    if math.prod(len(levels[f]) for f in factors) > MAX_CELLS:
        return poisson_models(table, formulas, levels, count)
    margins = {name: [t for t in terms if not any(set(t) < set(o) for o in terms)] for name, terms in parsed.items()}
    sizes = {f: len(levels[f]) for f in factors}
    complete = math.prod(sizes.values())

    def fit(model: pd.DataFrame) -> pd.DataFrame:
        name = model["model"].iloc[0]
        n = model["n"].to_numpy(np.float64)
        at = model[factors].to_numpy(np.int64)
        place = {f: at[:, i] for i, f in enumerate(factors)}
        codes = [reduce(lambda a, f: a * sizes[f] + place[f], t, np.zeros(len(n), np.int64)) for t in margins[name]]
        fitted, steps, converged = _proportional_fit(n, codes or [np.zeros(len(n), np.int64)])
        terms = 1 + sum(math.prod(sizes[f] - 1 for f in t) for t in parsed[name])
        if len(n) < complete:
            # absent cells can make terms depend on each other
            columns = [np.ones(len(n))] + [np.prod([place[f] == v for f, v in zip(t, values)], axis=0)
                                          for t in parsed[name] for values in itertools.product(*[range(1, sizes[f]) for f in t])]
            terms = int(np.linalg.matrix_rank(np.column_stack(columns).astype(float)))
        some = n > 0
        deviance = 2 * (float(np.sum(n[some] * np.log(n[some] / fitted[some]))) - float(np.sum(n - fitted)))
        return pd.DataFrame({"model": [name], "deviance": deviance, "cells": len(n), "terms": terms, "steps": steps, "converged": converged})

    coded = [reduce(lambda chain, v: chain.when(F.col(f) == F.lit(v[1]), v[0]), list(enumerate(levels[f]))[1:],
                    F.when(F.col(f) == F.lit(levels[f][0]), 0)).alias(f) for f in factors]
    cells = table.select(*coded, F.col(count).cast("double").alias("n")).dropna()
    named = cells.withColumn("model", F.explode(F.array(*[F.lit(name) for name in formulas])))
    rows = named.groupBy("model").applyInPandas(fit, "model STRING, deviance DOUBLE, cells INT, terms INT, steps INT, converged BOOLEAN").collect()
    found = {}
    for r in rows:
        if not r["converged"]:
            warnings.warn(f"{r['model']} did not converge in {r['steps']} steps", RuntimeWarning, stacklevel=2)
        found[r["model"]] = Fit([], [], [], r["deviance"], r["cells"] - r["terms"], r["cells"], r["converged"], r["steps"])
    return {name: found[name] for name in formulas if name in found}


def poisson_loglinear(table: DataFrame, terms: Sequence[str], levels: Mapping[str, Sequence],
                      count: str = "n") -> Fit:
    return poisson_models(table, {"model": terms}, levels, count)["model"]


def _entropy(p: Column) -> Column:
    """p ln p, 0 at p = 0."""
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def logistic(df: DataFrame, response: str, terms: Sequence[str], levels: Mapping[str, Sequence],
             failure=None) -> Fit:
    """Binomial model; the first response level is the failure, every other level a success.

    Rows are reduced to the share of successes per factor combination. Deviance
    and degrees of freedom are those of the single rows, so the deviance of the
    cells around their own share is added back.
    """
    factors = sorted({f for term in expand_terms(terms) for f in term})
    failure = levels[response][0] if failure is None else failure
    success = (F.col(response) != F.lit(failure)).cast("double")
    cells = df.where(F.col(response).isNotNull()).groupBy(*factors).agg(
        F.avg(success).alias("__label"), F.count("*").cast("double").alias("__weight"))
    share = F.col("__label")
    within = -2 * F.sum(F.col("__weight") * (_entropy(share) + _entropy(1 - share)))
    with _held(cells) as (held, _):
        rows, base = held.agg(F.sum("__weight"), within).first()
        complete = _complete(held, {"model": terms}, levels)
        return _fit(held, terms, levels, "binomial", "logit", int(rows), float(base), complete)


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the finite series for whole df."""
    if df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return total


def compare_models(spark: SparkSession, pairs: Mapping[str, tuple[Fit, Fit]]) -> DataFrame:
    """Deviance comparison of nested models, one row per named pair (larger model first or second)."""
    rows = []
    for name, fits in pairs.items():
        small, large = sorted(fits, key=lambda f: -f.df_residual)
        gain, df = small.deviance - large.deviance, small.df_residual - large.df_residual
        rows.append((name, small.df_residual, small.deviance, large.df_residual, large.deviance, df, gain,
                     chi_square_tail(gain, df)))
    schema = ("comparison STRING, small_df INT, small_deviance DOUBLE, large_df INT, large_deviance DOUBLE, "
              "df INT, deviance DOUBLE, p DOUBLE")
    return spark.createDataFrame(rows, schema)


def coefficient_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """Estimate, standard error, z and two-sided p per coefficient; NULL for aliased ones."""
    rows = []
    for label, b, se in zip(fit.labels, fit.estimates, fit.errors):
        if math.isnan(b):
            rows.append((label, None, None, None, None))
            continue
        z = b / se if se else None
        rows.append((label, b, se, z, None if z is None else math.erfc(abs(z) / math.sqrt(2))))
    return spark.createDataFrame(rows, "term STRING, estimate DOUBLE, se DOUBLE, z DOUBLE, p DOUBLE")


def loglinear_formulas(a: str, b: str, c: str) -> dict[str, list[str]]:
    """The ladder of three-factor models: saturated, one interaction less, and two-factor tables."""
    mains, ab, ac, bc = [a, b, c], f"{a}:{b}", f"{a}:{c}", f"{b}:{c}"
    return {
        "saturated": [*mains, ab, ac, bc, f"{a}:{b}:{c}"],
        "pairwise": [*mains, ab, ac, bc],
        f"no {ab}": [*mains, ac, bc],
        f"no {ac}": [*mains, ab, bc],
        f"no {bc}": [*mains, ab, ac],
        f"{a}, {b}": [a, b, ab],
        f"{a}, {c}": [a, c, ac],
        f"{b}, {c}": [b, c, bc],
        f"{a}, {b} + {c}": [*mains, ab],
        f"{a}, {c} + {b}": [*mains, ac],
        f"{b}, {c} + {a}": [*mains, bc],
    }


def loglinear_pairs(a: str, b: str, c: str) -> dict[str, tuple[str, str]]:
    """The seven comparisons made along the ladder."""
    return {
        f"{a}:{b}:{c}": ("saturated", "pairwise"),
        f"{a}:{b}": ("pairwise", f"no {a}:{b}"),
        f"{a}:{c}": ("pairwise", f"no {a}:{c}"),
        f"{b}:{c}": ("pairwise", f"no {b}:{c}"),
        a: (f"{b}, {c} + {a}", f"{b}, {c}"),
        c: (f"{a}, {b} + {c}", f"{a}, {b}"),
        b: (f"{a}, {c} + {b}", f"{a}, {c}"),
    }
