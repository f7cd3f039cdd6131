"""Logistic and Poisson models with random intercepts: of participants, or of participants crossed with items.

Participants are reduced to their counts per factor combination, and equal
participants to one weighted row. Each optimiser step is a Spark job in which the
tasks solve all participants' modes together in numpy and return sums: the
Laplace log-likelihood with its exact gradient and curvature, or, for crossed
intercepts, the normal equations of the items with the participants eliminated.
"""

from __future__ import annotations

import itertools
import math
import pickle
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.models import Fit, expand_terms, independent_columns

# Factor combinations one participant's row may hold.
MAX_PATTERNS = 400
_MODE_STEPS = 60
# Participants worked on at once inside a task.
_SLICE = 2048


def _patterns(terms: Sequence[str], levels: Mapping[str, Sequence], item: str | None = None) -> tuple[list[dict], np.ndarray, list[str]]:
    """All factor combinations (with each level of ``item``), their treatment-coded rows and the coefficient labels."""
    parsed = expand_terms(terms)
    factors = sorted({f for term in parsed for f in term} | ({item} if item else set()))
    combos = [dict(zip(factors, values)) for values in itertools.product(*[levels[f] for f in factors])]
    if len(combos) > MAX_PATTERNS:
        raise ValueError(f"{len(combos)} factor combinations, at most {MAX_PATTERNS} are supported")
    labels, columns = ["(Intercept)"], [np.ones(len(combos))]
    for term in parsed:
        for chosen in itertools.product(*[levels[f][1:] for f in term]):
            labels.append(":".join(f"{f}[{v}]" for f, v in zip(term, chosen)))
            hit = [all(c[f] == v for f, v in zip(term, chosen)) for c in combos]
            columns.append(np.array(hit, dtype=float))
    return combos, np.column_stack(columns), labels


def _is(combo: Mapping[str, object]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) == F.lit(v) for f, v in combo.items()])


def participant_profiles(df: DataFrame, participant: str, combos: Sequence[Mapping], outcome: Column,
                         size: Column) -> DataFrame:
    """(y, n, weight): outcome and size summed per factor combination, equal participants counted.

    Conditional sums combine map-side, so a participant with very many trials is
    reduced before the shuffle.
    """
    zero = F.lit(0.0)
    y = [F.coalesce(F.sum(F.when(_is(c), outcome)), zero) for c in combos]
    n = [F.coalesce(F.sum(F.when(_is(c), size)), zero) for c in combos]
    people = df.groupBy(participant).agg(F.array(*y).alias("y"), F.array(*n).alias("n"))
    return people.groupBy("y", "n").agg(F.count("*").cast("double").alias("weight"))


def _derivatives(eta: np.ndarray, y: np.ndarray, n: np.ndarray, family: str) -> tuple[np.ndarray, ...]:
    """Log-likelihood of each cell (without constants) and what its slope and the next three derivatives subtract."""
    if family == "binomial":
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        spread = mu * (1 - mu)
        return (y * eta - n * np.logaddexp(0, eta), y - n * mu, n * spread, n * spread * (1 - 2 * mu), n * spread * (1 - 6 * spread))
    mean = n * np.exp(np.minimum(eta, 50))
    return y * eta - mean, y - mean, mean, mean, mean


def _modes(y: np.ndarray, n: np.ndarray, fixed: np.ndarray, sd: float, family: str) -> np.ndarray:
    """The intercepts, in units of ``sd``, at which each participant's joint likelihood is highest."""
    u = np.zeros(len(y))
    for _ in range(_MODE_STEPS):
        _, r, w, _, _ = _derivatives(fixed + sd * u[:, None], y, n, family)
        step = np.clip((sd * r.sum(1) - u) / (sd * sd * w.sum(1) + 1), -2, 2)
        u = u + step
        if np.max(np.abs(step), initial=0) < 1e-12:
            break
    return u


def laplace(y: np.ndarray, n: np.ndarray, weight: np.ndarray, x: np.ndarray, params: np.ndarray, family: str,
            derivatives: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Laplace log-likelihood of participants, its gradient and its curvature; ``params`` are coefficients and the sd.

    With cells' derivative vectors d = (x, u), a participant adds f(u) - log(h) / 2 at
    its mode u, where h = sd^2 * sum(w) + 1; the mode moves with the parameters
    at the rate sd-weighted slope / h.
    """
    size, sd = len(params), params[-1]
    u = _modes(y, n, x @ params[:-1], sd, family)
    value, r, w, w3, w4 = _derivatives(x @ params[:-1] + sd * u[:, None], y, n, family)
    rs, ws, w3s, w4s = (k.sum(1) for k in (r, w, w3, w4))
    h = sd * sd * ws + 1
    total = float(weight @ (value.sum(1) - u * u / 2 - np.log(h) / 2))
    if not derivatives:
        return total, np.zeros(size), np.zeros((size, size))
    last = np.zeros(size)
    last[-1] = 1.0

    def along(k: np.ndarray) -> np.ndarray:
        """A row for each participant: cells' vectors d summed with weights k."""
        return np.column_stack([k @ x, k.sum(1) * u])

    slope, dw, dw3, dw4 = along(r), along(w), along(w3), along(w4)
    f_u = -sd * dw + np.outer(rs, last)
    moved = f_u / h[:, None]
    h_own = sd * sd * dw3 + np.outer(2 * sd * ws, last)
    h_u, h_uu = sd**3 * w3s, sd**4 * w4s
    h_mixed = sd**3 * dw4 + np.outer(3 * sd * sd * w3s, last)
    h_all = h_own + h_u[:, None] * moved
    gradient = weight @ (slope - h_all / (2 * h[:, None]))

    # terms with d d' of single cells
    a, b = weight / (2 * h), weight * h_u / (2 * h * h)
    cells = -weight[:, None] * w - (a * sd * sd)[:, None] * w4 + (b * sd)[:, None] * w3
    curvature = np.zeros((size, size))
    curvature[:-1, :-1] = (x * cells.sum(0)[:, None]).T @ x
    cross = u @ cells @ x
    curvature[:-1, -1] += cross
    curvature[-1, :-1] += cross
    curvature[-1, -1] += (u * u) @ cells.sum(1)
    # terms that pair sums over a participant's cells

    def pair(k: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * k[:, None]).T @ right

    def both(k: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        half = pair(k, left, right)
        return half + half.T

    ends = np.broadcast_to(last, dw.shape)
    curvature += pair(weight, f_u, moved) + pair(weight / (2 * h * h), h_all, h_all)
    curvature -= both(a, h_mixed, moved) + pair(a * h_uu, moved, moved) + both(2 * a * sd, ends, dw3)
    curvature += both(b, ends, dw) + both(b, h_own, moved) + pair(b * h_u, moved, moved)
    curvature[-1, -1] -= a @ (2 * ws)
    return total, gradient, (curvature + curvature.T) / 2


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), _SLICE):
            part = batch.iloc[start : start + _SLICE]
            yield np.vstack(part["y"].to_numpy()), np.vstack(part["n"].to_numpy()), part["weight"].to_numpy()


def _summed(profiles: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Arrays that ``work`` makes of some participants, added up over all of them in one job.

    A partition returns its sums as one row; their size follows from the formula and not from the data.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in _slices(batches):
            found = work(*part)
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            flat = np.concatenate([np.ravel(t) for t in total])
            yield pd.DataFrame({"at": np.arange(len(flat)), "value": flat, "shape": [pickle.dumps([np.shape(t) for t in total])] + [None] * (len(flat) - 1)})

    rows = profiles.mapInPandas(run, "at INT, value DOUBLE, shape BINARY").groupBy("at").agg(F.sum("value").alias("value"), F.max("shape").alias("shape")).collect()
    if not rows:
        raise ValueError("no participants")
    flat = np.zeros(len(rows))
    for row in rows:
        flat[row["at"]] = row["value"]
    out, first = [], 0
    for shape in pickle.loads(next(r["shape"] for r in rows if r["at"] == 0)):
        size = math.prod(shape)
        out.append(flat[first : first + size].reshape(shape))
        first += size
    return out


@dataclass(frozen=True)
class _Table:
    """Participants reduced to profiles, and where the search starts: the fixed model of the summed cells."""

    profiles: DataFrame
    x: np.ndarray
    labels: list[str]
    used: list[int]
    start: np.ndarray
    information: np.ndarray
    rows: int


def _fixed_start(y: np.ndarray, n: np.ndarray, x: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and information of the model without random intercepts, by Newton steps on the summed cells."""
    share = (y + 0.5) / (n + 1)
    eta = np.log(share / (1 - share)) if family == "binomial" else np.log(share)
    at = np.linalg.lstsq(x * np.sqrt(n)[:, None], eta * np.sqrt(n), rcond=None)[0]
    for _ in range(50):
        _, r, w, _, _ = _derivatives(x @ at, y, n, family)
        step = np.linalg.lstsq(x.T @ (x * w[:, None]), x.T @ r, rcond=None)[0]
        at = at + np.clip(step, -3, 3)
        if np.max(np.abs(step)) < 1e-9:
            break
    _, _, w, _, _ = _derivatives(x @ at, y, n, family)
    return at, x.T @ (x * w[:, None])


def _prepare(df: DataFrame, response: str, terms: Sequence[str], levels: Mapping[str, Sequence], participant: str, family: str,
             failure, item: str | None = None) -> tuple[_Table, list[int]]:
    combos, x, labels = _patterns(terms, levels, item)
    known = df.where(F.col(response).isNotNull())
    if family == "binomial":
        failure = levels[response][0] if failure is None else failure
        outcome = (F.col(response) != F.lit(failure)).cast("double")
    else:
        outcome = F.col(response).cast("double")
    profiles = participant_profiles(known, participant, combos, outcome, F.lit(1.0)).cache()
    y, n = (np.zeros(len(combos)) for _ in range(2))
    for row in profiles.select(F.posexplode(F.arrays_zip("y", "n")).alias("at", "cell"), "weight").groupBy("at").agg(
            F.sum(F.col("cell.y") * F.col("weight")), F.sum(F.col("cell.n") * F.col("weight"))).collect():
        y[row[0]], n[row[0]] = row[1], row[2]
    # columns that the observed cells do not tell apart get no estimate
    used = independent_columns(x.T @ (x * (n > 0)[:, None]))
    x = x[:, used]
    table = _Table(profiles, x, labels, used, *_fixed_start(y[n > 0], n[n > 0], x[n > 0], family), int(n.sum()))
    return table, [] if item is None else [levels[item].index(c[item]) for c in combos]


def _fitted(table: _Table, at: np.ndarray, errors: np.ndarray, names: list[str], value: float, converged: bool, steps: int) -> Fit:
    k = len(table.used)
    estimate, error = dict(zip(table.used, at[:k], strict=True)), dict(zip(table.used, errors[:k], strict=True))
    everything = range(len(table.labels))
    if not converged:
        warnings.warn(f"the fit did not converge in {steps} steps", RuntimeWarning, stacklevel=3)
    return Fit(
        labels=[*table.labels, *names],
        # the likelihood does not depend on the sign of a standard deviation
        estimates=[*[float(estimate.get(j, math.nan)) for j in everything], *map(float, np.abs(at[k:]))],
        errors=[*[float(error.get(j, math.nan)) for j in everything], *map(float, errors[k:])],
        deviance=-2 * float(value), df_residual=table.rows - k - len(names), rows=table.rows, converged=converged, steps=steps)


def _errors_of(information: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(np.diag(np.linalg.pinv(information)), 0, None))


def random_intercept_glm(df: DataFrame, response: str, terms: Sequence[str], levels: Mapping[str, Sequence],
                         participant: str = "participant", family: str = "binomial", failure=None,
                         max_steps: int = 60) -> Fit:
    """Fixed effects plus a normal intercept per participant, fitted by the Laplace approximation.

    The binomial response is a factor whose first level is the failure; the
    Poisson response is a count column. The last label is the random intercept's
    standard deviation; ``deviance`` is -2 log-likelihood (for counts, up to a constant
    of the data). Newton steps: a job returns the likelihood, its gradient and its
    curvature at the full step, and the likelihood at shorter ones. ``converged``
    says whether the last step could have gained less than 1e-8.
    """
    table, _ = _prepare(df, response, terms, levels, participant, family, failure)
    scales, x = (0.5, 0.25, 0.1, 0.02), table.x

    def evaluate(at: np.ndarray, others: Sequence[np.ndarray] = ()) -> list[np.ndarray]:
        def work(y, n, weight):
            short = [laplace(y, n, weight, x, o, family, derivatives=False)[0] for o in others]
            return [*map(np.asarray, laplace(y, n, weight, x, at, family)), np.array(short)]

        return _summed(table.profiles, work)

    try:
        at = np.append(table.start, 0.5)
        best, slope, curvature, _ = evaluate(at)
        converged, steps = False, 0
        while steps < max_steps:
            size, axes = np.linalg.eigh(-curvature)
            move = axes @ ((axes.T @ slope) / np.maximum(np.abs(size), 1e-9 * max(np.abs(size).max(), 1.0)))
            if slope @ move < 2e-8:
                converged = True
                break
            move = move / max(1.0, np.max(np.abs(move)) / 2)
            steps += 1
            value, new_slope, new_curvature, short = evaluate(at + move, [at + s * move for s in scales])
            tried = [float(value), *short]
            pick = int(np.argmax(tried))
            if not tried[pick] > best:
                break
            if pick:
                move = scales[pick - 1] * move
                value, new_slope, new_curvature, _ = evaluate(at + move)
            at, best, slope, curvature = at + move, float(value), new_slope, new_curvature
        return _fitted(table, at, _errors_of(-curvature), ["sd(intercept)"], float(best), converged, steps)
    finally:
        table.profiles.unpersist()


# --- participants crossed with items ------------------------------------------------------------


class Crossed:
    """Sums over participants for a model with intercepts of participants and of items.

    The joint Hessian of all intercepts has a diagonal block for the participants,
    which every task eliminates for its own; what is left are the normal
    equations of the items, a small dense matrix.
    """

    def __init__(self, x: np.ndarray, item: Sequence[int], family: str):
        self.x, self.family, self.fixed = x, family, x.shape[1]
        self.of = np.eye(max(item) + 1)[list(item)]

    def _at(self, y, n, params, v):
        one, two = params[self.fixed :]
        fixed = self.x @ params[: self.fixed] + two * (self.of @ v)
        u = _modes(y, n, fixed, one, self.family)
        return one, two, u, _derivatives(fixed + one * u[:, None], y, n, self.family)

    def equations(self, y, n, weight, params, v) -> list[np.ndarray]:
        """[likelihood, slope of the items, their matrix], the participants at their modes for these item values."""
        one, two, u, (value, r, w, _, _) = self._at(y, n, params, v)
        a = one * one * w.sum(1) + 1
        b = one * two * (w @ self.of)
        total = weight @ (value.sum(1) - u * u / 2 - np.log(a) / 2)
        matrix = np.diag(two * two * (weight @ w @ self.of)) - (b * (weight / a)[:, None]).T @ b
        return [np.asarray(total), two * (weight @ r @ self.of), matrix]

    def slopes(self, y, n, weight, params, v, inverse) -> list[np.ndarray]:
        """Sums from which :meth:`gradient` is put together; ``inverse`` is that of the items' matrix."""
        one, two, u, (_, r, w, w3, _) = self._at(y, n, params, v)
        x, of = self.x, self.of
        a = one * one * w.sum(1) + 1
        b = one * two * (w @ of)
        # elements of the inverse Hessian: of a participant, of a participant and an item
        mixed = -(b @ inverse) / a[:, None]
        own = (1 / a - (mixed * b).sum(1) / a)[:, None]
        first = one * own + two * (mixed @ of.T)
        second = two * (of @ np.diag(inverse)) + one * (mixed @ of.T)
        q = (one * first + two * second) * w3
        tu = one * q.sum(1)
        level = of @ v
        wx, k, kb = w @ x, weight * one / a, b * (weight / a)[:, None]
        # how fast the equations of the modes move with the two standard deviations
        rate_one = r.sum(1) - one * u * w.sum(1)
        rate_two = -one * (w @ level)
        return [weight @ r @ x - weight @ q @ x / 2 + (k * tu) @ wx / 2,
                two * (x.T * (weight @ w)) @ of - (wx * k[:, None]).T @ b,
                two * (weight @ q @ of) - (weight * tu / a) @ b,
                np.array([(weight * u) @ r.sum(1) - weight @ (2 * (w * first).sum(1) + u * q.sum(1) + tu / a * rate_one) / 2,
                          weight @ (r @ level) - weight @ (2 * (w * second).sum(1) + q @ level + tu / a * rate_two) / 2]),
                np.array([-rate_one @ kb - two * (weight * u) @ (w @ of),
                          -rate_two @ kb + weight @ r @ of - two * (weight @ w @ of) * v])]

    def gradient(self, sums: list[np.ndarray], inverse: np.ndarray) -> np.ndarray:
        base, by_item, right, spread, spread_by_item = sums
        moved = inverse @ right
        return np.concatenate([base + by_item @ moved / 2, spread - spread_by_item @ moved / 2])


def _settled(profiles: DataFrame, model: Crossed, points: Sequence[np.ndarray], v: np.ndarray, slopes: bool) -> list[tuple]:
    """(likelihood, item values, gradient) at each point; all points share the jobs. NaN where the items did not settle."""
    values = [np.array(v) for _ in points]
    for _ in range(_MODE_STEPS):
        sums = _summed(profiles, lambda y, n, weight: [s for p, k in zip(points, values, strict=True) for s in model.equations(y, n, weight, p, k)])
        parts = [sums[3 * i : 3 * i + 3] for i in range(len(points))]
        matrices = [m + np.eye(len(k)) for (_, _, m), k in zip(parts, values, strict=True)]
        moves = [np.linalg.solve(m, g - k) for (_, g, _), m, k in zip(parts, matrices, values, strict=True)]
        if max(np.max(np.abs(s)) for s in moves) < 1e-9:
            break
        values = [k + np.clip(s, -2, 2) for k, s in zip(values, moves, strict=True)]
    steady = [np.max(np.abs(s)) < 1e-9 for s in moves]
    levels = [float(f) - k @ k / 2 - np.linalg.slogdet(m)[1] / 2 if ok else math.nan
              for (f, _, _), m, k, ok in zip(parts, matrices, values, steady, strict=True)]
    if not slopes:
        return [(f, k, None) for f, k in zip(levels, values, strict=True)]
    inverses = [np.linalg.inv(m) for m in matrices]
    sums = _summed(profiles, lambda y, n, weight: [s for p, k, i in zip(points, values, inverses, strict=True) for s in model.slopes(y, n, weight, p, k, i)])
    return [(f, k, model.gradient(sums[5 * i : 5 * i + 5], inverses[i])) for i, (f, k) in enumerate(zip(levels, values, strict=True))]


def crossed_intercepts_glm(df: DataFrame, response: str, terms: Sequence[str], levels: Mapping[str, Sequence],
                           participant: str = "participant", item: str = "item", family: str = "binomial", failure=None,
                           max_steps: int = 60) -> Fit:
    """Fixed effects plus normal intercepts of participants and, crossed with them, of items.

    Items are a factor with ``levels`` (the smaller of the two); participants are
    without a bound. The joint modes and the determinant come from equations in
    which the participants were eliminated in Spark; quasi-Newton steps use the
    exact gradient of the Laplace approximation. The last two labels are the
    standard deviations; ``converged`` says whether the gradient became flat.
    """
    table, at_item = _prepare(df, response, terms, levels, participant, family, failure, item)
    model = Crossed(table.x, at_item, family)
    scales = (0.5, 0.2, 0.05)
    try:
        size = len(table.start) + 2
        at = np.append(table.start, [0.5, 0.5])
        best, v, slope = _settled(table.profiles, model, [at], np.zeros(len(levels[item])), True)[0]
        first = np.diag([0.1] * size)
        first[:-2, :-2] = np.linalg.pinv(table.information)
        inverse, converged, steps = first, False, 0
        while steps < max_steps:
            move = inverse @ slope
            if slope @ move < 1e-8:
                converged = bool(slope @ first @ slope < 1e-6)
                if converged or inverse is first:
                    break
                inverse = first
                continue
            move = move / max(1.0, np.max(np.abs(move)) / 2)
            steps += 1
            value, at_v, new_slope = _settled(table.profiles, model, [at + move], v, True)[0]
            if not value > best + 1e-4 * (slope @ move):
                tried = _settled(table.profiles, model, [at + s * move for s in scales], v, False)
                gains = [-math.inf if math.isnan(t[0]) else t[0] for t in tried]
                pick = int(np.argmax(gains))
                if not gains[pick] > best:
                    converged = bool(slope @ first @ slope < 1e-6)
                    break
                move = scales[pick] * move
                value, at_v, new_slope = _settled(table.profiles, model, [at + move], tried[pick][1], True)[0]
            change = slope - new_slope
            at, best, v, slope, agree = at + move, value, at_v, new_slope, float(move @ change)
            if agree > 1e-12:
                left = np.eye(size) - np.outer(move, change) / agree
                inverse = left @ inverse @ left.T + np.outer(move, move) / agree
        h = 1e-4
        axes = np.eye(size) * h
        ends = _settled(table.profiles, model, [at + s for s in [*axes, *-axes]], v, True)
        information = -np.array([(up[2] - down[2]) / (2 * h) for up, down in zip(ends[:size], ends[size:], strict=True)])
        return _fitted(table, at, _errors_of((information + information.T) / 2), [f"sd({participant})", f"sd({item})"], best, converged, steps)
    finally:
        table.profiles.unpersist()
