"""Queries for the log-linear and logistic models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from attestry.operators import experiment, mixed, models
from attestry.plans.registry import cte, query
from attestry.plans.survey_queries import analysis

# Levels in the order of the reference coding; the first of each is the reference level.
LEVELS = {
    "subject": ["He", "She", "They"],
    "l1": ["English", "Spanish"],
    "gender_coarse": ["man", "nonbinary", "other", "woman"],
    "picture": ["feminine", "masculine", "nonbinary / other"],
}
FACTORS = ["subject", "l1", "gender_coarse"]

cte("table3", "SELECT subject, l1, gender_coarse, CAST(count(*) AS DOUBLE) AS n FROM analysis GROUP BY ALL", "analysis")


def _table(spark, sf, keys=FACTORS):
    return experiment.contingency(analysis(spark, sf), keys)


@query("design_matrix", """
SELECT subject, l1, n, CAST(subject = 'She' AS DOUBLE) AS x0, CAST(subject = 'They' AS DOUBLE) AS x1, CAST(l1 = 'Spanish' AS DOUBLE) AS x2,
       CAST(subject = 'She' AND l1 = 'Spanish' AS DOUBLE) AS x3, CAST(subject = 'They' AND l1 = 'Spanish' AS DOUBLE) AS x4
FROM (SELECT subject, l1, count(*) AS n FROM analysis GROUP BY ALL) AS t""", "analysis")
def _(spark, sf):
    wide, labels = models.design_matrix(_table(spark, sf, ["subject", "l1"]), ["subject * l1"], LEVELS)
    cells = vector_to_array("features")
    return wide.select("subject", "l1", "n", *[cells[i].alias(f"x{i}") for i in range(len(labels))])


# With every combination observed the saturated fit is the table itself, so its
# coefficients are contrasts of log counts.
cte("log2", """
SELECT max(ln(n)) FILTER (WHERE subject = 'He' AND l1 = 'English') AS a, max(1 / n) FILTER (WHERE subject = 'He' AND l1 = 'English') AS va,
       max(ln(n)) FILTER (WHERE subject = 'She' AND l1 = 'English') AS b, max(1 / n) FILTER (WHERE subject = 'She' AND l1 = 'English') AS vb,
       max(ln(n)) FILTER (WHERE subject = 'They' AND l1 = 'English') AS c, max(1 / n) FILTER (WHERE subject = 'They' AND l1 = 'English') AS vc,
       max(ln(n)) FILTER (WHERE subject = 'He' AND l1 = 'Spanish') AS d, max(1 / n) FILTER (WHERE subject = 'He' AND l1 = 'Spanish') AS vd,
       max(ln(n)) FILTER (WHERE subject = 'She' AND l1 = 'Spanish') AS e, max(1 / n) FILTER (WHERE subject = 'She' AND l1 = 'Spanish') AS ve,
       max(ln(n)) FILTER (WHERE subject = 'They' AND l1 = 'Spanish') AS f, max(1 / n) FILTER (WHERE subject = 'They' AND l1 = 'Spanish') AS vf
FROM (SELECT subject, l1, CAST(count(*) AS DOUBLE) AS n FROM analysis GROUP BY ALL) AS t""", "analysis")


@query("poisson_saturated_coefficients", """
SELECT term, estimate, se, estimate / se AS z FROM (
SELECT '(Intercept)' AS term, a AS estimate, sqrt(va) AS se FROM log2 UNION ALL
SELECT 'subject[She]', b - a, sqrt(va + vb) FROM log2 UNION ALL SELECT 'subject[They]', c - a, sqrt(va + vc) FROM log2 UNION ALL
SELECT 'l1[Spanish]', d - a, sqrt(va + vd) FROM log2 UNION ALL
SELECT 'subject[She]:l1[Spanish]', e - d - b + a, sqrt(va + vb + vd + ve) FROM log2 UNION ALL
SELECT 'subject[They]:l1[Spanish]', f - d - c + a, sqrt(va + vc + vd + vf) FROM log2) AS k""", "log2", approx="estimate se z", digits=4)
def _(spark, sf):
    fit = models.poisson_loglinear(_table(spark, sf, ["subject", "l1"]), ["subject * l1"], LEVELS)
    return models.coefficient_table(spark, fit).drop("p")


def _ladder(spark, sf, only=None):
    formulas = models.loglinear_formulas(*FACTORS)
    return models.loglinear_fits(_table(spark, sf), {m: formulas[m] for m in only or formulas}, LEVELS)


_OVER = "sum(n) OVER (PARTITION BY {})"
_NTOTAL = "sum(n) OVER ()"
# fitted counts of the models that have a closed form, as products of margins
_FITTED = {
    "saturated": "n",
    "no subject:l1": f"{_OVER.format('subject, gender_coarse')} * {_OVER.format('l1, gender_coarse')} / {_OVER.format('gender_coarse')}",
    "no subject:gender_coarse": f"{_OVER.format('subject, l1')} * {_OVER.format('l1, gender_coarse')} / {_OVER.format('l1')}",
    "no l1:gender_coarse": f"{_OVER.format('subject, l1')} * {_OVER.format('subject, gender_coarse')} / {_OVER.format('subject')}",
    "subject, l1": "avg(n) OVER (PARTITION BY subject, l1)",
    "subject, gender_coarse": "avg(n) OVER (PARTITION BY subject, gender_coarse)",
    "l1, gender_coarse": "avg(n) OVER (PARTITION BY l1, gender_coarse)",
    "subject, l1 + gender_coarse": f"{_OVER.format('subject, l1')} * {_OVER.format('gender_coarse')} / {_NTOTAL}",
    "subject, gender_coarse + l1": f"{_OVER.format('subject, gender_coarse')} * {_OVER.format('l1')} / {_NTOTAL}",
    "l1, gender_coarse + subject": f"{_OVER.format('l1, gender_coarse')} * {_OVER.format('subject')} / {_NTOTAL}",
}
_DF = {"saturated": 0, "no subject:l1": 8, "no subject:gender_coarse": 12, "no l1:gender_coarse": 9, "subject, l1": 18,
       "subject, gender_coarse": 12, "l1, gender_coarse": 16, "subject, l1 + gender_coarse": 15, "subject, gender_coarse + l1": 11,
       "l1, gender_coarse + subject": 14}
_DEVIANCES = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {_DF[m]} AS df_residual, 2 * sum(n * ln(n / fit) - (n - fit)) AS deviance FROM (SELECT n, {fit} AS fit FROM table3) AS t{i}"
    for i, (m, fit) in enumerate(_FITTED.items()))


@query("poisson_deviances", _DEVIANCES, "table3", approx="deviance", digits=4)
def _(spark, sf):
    fits = _ladder(spark, sf, _FITTED)
    rows = [(m, fits[m].df_residual, fits[m].deviance) for m in _FITTED]
    return spark.createDataFrame(rows, "model STRING, df_residual INT, deviance DOUBLE")


def _erfc(x: str) -> str:
    """erfc of a non-negative expression, to 1.5e-7."""
    t = f"(1 / (1 + 0.3275911 * ({x})))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x})))"


def _with_tests(coefficients: str) -> str:
    return f"SELECT term, estimate, se, z, {_erfc('abs(z) / sqrt(2)')} AS p FROM (SELECT *, estimate / se AS z FROM ({coefficients}) AS k) AS e"


def _saturated(cells: str, reference: dict[str, str]) -> str:
    """Treatment-coded coefficients of a saturated model from its cells' linear predictors ``y`` and their variances ``v``.

    A coefficient is the signed sum over the cells in which each of its factors is
    at its level or at the reference, and every other factor at the reference.
    """
    labels = ", ".join(f"CASE WHEN t.{f} <> '{r}' THEN '{f}[' || t.{f} || ']' END" for f, r in reference.items())
    sign = " * ".join(f"CASE WHEN c.{f} = t.{f} THEN 1 ELSE -1 END" for f in reference)
    within = " AND ".join(f"(c.{f} = t.{f} OR c.{f} = '{r}')" for f, r in reference.items())
    return f"""
WITH c AS ({cells})
SELECT coalesce(nullif(concat_ws(':', {labels}), ''), '(Intercept)') AS term, sum({sign} * c.y) AS estimate, sqrt(sum(c.v)) AS se
FROM c AS t JOIN c ON {within} GROUP BY {', '.join(f't.{f}' for f in reference)}"""


_RELEVELLED = {"subject": "They", "l1": "English", "gender_coarse": "nonbinary", "picture": "masculine"}


@query("poisson_four_factors", _with_tests(_saturated(
    "SELECT subject, l1, gender_coarse, picture, ln(count(*)) AS y, 1 / count(*) AS v FROM analysis GROUP BY ALL", _RELEVELLED)), "analysis",
    approx="estimate se z p", digits=3)
def _(spark, sf):
    levels = experiment.relevel(LEVELS, subject="They", gender_coarse="nonbinary", picture="masculine")
    fit = models.poisson_loglinear(_table(spark, sf, list(LEVELS)), ["subject * l1 * gender_coarse * picture"], levels)
    return models.coefficient_table(spark, fit)


# The saturated model of sixteen cells: with contrasts lo and hi, a factor's mean
# weighs its cells by hi and -lo, and its slope by -1 and 1, as hi - lo is 1.
_CODED = {"subject": ("subject", 0.3333, 0.6667), "l1": ("l1[Spanish]", 1.0, 0.0), "gender": ("gender", 0.25, 0.75), "picture": ("picture", 0.3333, 0.6667)}
_CONTRAST_WEIGHT = " * ".join(
    f"CASE t_{f} WHEN 1 THEN 2 * {f} - 1 ELSE CASE {f} WHEN 1 THEN {hi}::DOUBLE ELSE {lo}::DOUBLE END END" for f, (_, lo, hi) in _CODED.items())
_CONTRAST_LABEL = ", ".join(f"CASE t_{f} WHEN 1 THEN '{label}' END" for f, (label, _, _) in _CODED.items())
_CHOICES = ", ".join(f"(VALUES (0), (1)) AS c_{f}(t_{f})" for f in _CODED)


@query("poisson_contrasts", _with_tests(f"""
SELECT coalesce(nullif(concat_ws(':', {_CONTRAST_LABEL}), ''), '(Intercept)') AS term, sum(w * y) AS estimate, sqrt(sum(w * w * v)) AS se FROM (
SELECT *, {_CONTRAST_WEIGHT} AS w FROM (
SELECT CASE WHEN subject <> 'They' THEN 0 ELSE 1 END AS subject, CASE l1 WHEN 'Spanish' THEN 1 ELSE 0 END AS l1,
       CASE WHEN gender_coarse <> 'nonbinary' THEN 0 ELSE 1 END AS gender, CASE WHEN picture <> 'nonbinary / other' THEN 0 ELSE 1 END AS picture,
       ln(count(*)) AS y, 1 / count(*) AS v FROM analysis GROUP BY 1, 2, 3, 4) AS c, {_CHOICES}) AS weighted
GROUP BY {', '.join(f't_{f}' for f in _CODED)}"""), "analysis", approx="estimate se z p", digits=4)
def _(spark, sf):
    coded = experiment.contrast_code(analysis(spark, sf))
    fit = models.poisson_loglinear(coded, ["subject * l1 * gender * picture"], {"l1": LEVELS["l1"]})
    return models.coefficient_table(spark, fit)


# proportional fitting of the three pairwise margins, and the tail of chi-square for the degrees of freedom that occur
_PAIRWISE = """
WITH RECURSIVE ipf(subject, l1, gender_coarse, n, fit, k) AS (
SELECT subject, l1, gender_coarse, n, 1.0::DOUBLE, 0 FROM table3
UNION ALL SELECT subject, l1, gender_coarse, n, fit * sum(n) OVER (PARTITION BY l1, gender_coarse) / sum(fit) OVER (PARTITION BY l1, gender_coarse), k + 1
FROM (SELECT subject, l1, gender_coarse, n, k, fit * sum(n) OVER (PARTITION BY subject, gender_coarse) / sum(fit) OVER (PARTITION BY subject, gender_coarse) AS fit
FROM (SELECT subject, l1, gender_coarse, n, k, fit * sum(n) OVER (PARTITION BY subject, l1) / sum(fit) OVER (PARTITION BY subject, l1) AS fit FROM ipf WHERE k < 60) AS a) AS b)
SELECT 'pairwise' AS model, 6 AS df_residual, 2 * sum(n * ln(n / fit) - (n - fit)) AS deviance FROM ipf WHERE k = 60"""
_HALF = "(greatest(deviance, 0) / 2)"
_TAIL = f"""CASE WHEN deviance <= 0 THEN 1 ELSE CASE df WHEN 1 THEN {_erfc(f'sqrt{_HALF}')} WHEN 2 THEN exp(-{_HALF})
WHEN 3 THEN {_erfc(f'sqrt{_HALF}')} + 2 * sqrt({_HALF} / pi()) * exp(-{_HALF}) WHEN 6 THEN exp(-{_HALF}) * (1 + {_HALF} + {_HALF} ** 2 / 2) END END"""
_PAIR_ROWS = ", ".join(f"('{name}', '{a}', '{b}')" for name, (a, b) in models.loglinear_pairs(*FACTORS).items())


@query("compare_models", f"""
SELECT comparison, small_df, small_deviance, large_df, large_deviance, df, deviance, {_TAIL} AS p FROM (
SELECT k.name AS comparison, b.df_residual AS small_df, b.deviance AS small_deviance, a.df_residual AS large_df, a.deviance AS large_deviance,
       b.df_residual - a.df_residual AS df, b.deviance - a.deviance AS deviance
FROM (VALUES {_PAIR_ROWS}) AS k(name, large, small)
JOIN ({_DEVIANCES} UNION ALL SELECT * FROM ({_PAIRWISE}) AS w) AS a ON a.model = k.large
JOIN ({_DEVIANCES} UNION ALL SELECT * FROM ({_PAIRWISE}) AS w) AS b ON b.model = k.small) AS q""", "table3",
       approx="small_deviance large_deviance deviance p", digits=3)
def _(spark, sf):
    fits = _ladder(spark, sf)
    pairs = {name: (fits[x], fits[y]) for name, (x, y) in models.loglinear_pairs(*FACTORS).items()}
    return models.compare_models(spark, pairs)


_D = f"({_DEVIANCES})"


@query("compare_main_effects", f"""
SELECT k.factor AS comparison, b.df_residual - a.df_residual AS df, b.deviance - a.deviance AS deviance
FROM (VALUES ('subject', 'l1, gender_coarse + subject', 'l1, gender_coarse'), ('gender_coarse', 'subject, l1 + gender_coarse', 'subject, l1'),
             ('l1', 'subject, gender_coarse + l1', 'subject, gender_coarse')) AS k(factor, large, small)
JOIN {_D} AS a ON a.model = k.large JOIN {_D} AS b ON b.model = k.small""", "table3", approx="deviance", digits=4)
def _(spark, sf):
    pairs = {name: pair for name, pair in models.loglinear_pairs(*FACTORS).items() if name in FACTORS}
    fits = _ladder(spark, sf, sorted({m for pair in pairs.values() for m in pair}))
    compared = models.compare_models(spark, {name: (fits[x], fits[y]) for name, (x, y) in pairs.items()})
    return compared.select("comparison", "df", "deviance")


cte("logits", """
SELECT l1, picture, ln(s / (n - s)) AS logit, 1 / s + 1 / (n - s) AS v FROM (
SELECT l1, picture, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE subject <> 'He') AS DOUBLE) AS s FROM analysis GROUP BY ALL) AS t""",
    "analysis")


@query("logistic_coefficients", """
SELECT CASE WHEN l.l1 = 'English' THEN '(Intercept)' ELSE 'l1[Spanish]' END AS term, CASE WHEN l.l1 = 'English' THEN l.logit ELSE l.logit - r.logit END AS estimate,
       CASE WHEN l.l1 = 'English' THEN sqrt(l.v) ELSE sqrt(l.v + r.v) END AS se
FROM logits AS l JOIN logits AS r ON r.l1 = 'English' AND r.picture = l.picture WHERE l.picture = 'feminine'
UNION ALL SELECT 'picture[' || l.picture || ']', l.logit - r.logit, sqrt(l.v + r.v) FROM logits AS l JOIN logits AS r ON r.l1 = 'English' AND r.picture = 'feminine'
WHERE l.l1 = 'English' AND l.picture <> 'feminine'
UNION ALL SELECT 'l1[Spanish]:picture[' || a.picture || ']', a.logit - b.logit - c.logit + d.logit, sqrt(a.v + b.v + c.v + d.v)
FROM logits AS a JOIN logits AS b ON b.l1 = 'Spanish' AND b.picture = 'feminine' JOIN logits AS c ON c.l1 = 'English' AND c.picture = a.picture
     JOIN logits AS d ON d.l1 = 'English' AND d.picture = 'feminine' WHERE a.l1 = 'Spanish' AND a.picture <> 'feminine'""", "logits",
       approx="estimate se", digits=4)
def _(spark, sf):
    fit = models.logistic(analysis(spark, sf), "subject", ["l1 * picture"], LEVELS)
    return models.coefficient_table(spark, fit).select("term", "estimate", "se")


_CELL_LOGITS = """
SELECT l1, gender_coarse, picture, ln(s / (n - s)) AS y, 1 / s + 1 / (n - s) AS v FROM (
SELECT l1, gender_coarse, picture, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE subject <> 'He') AS DOUBLE) AS s FROM analysis GROUP BY ALL) AS t"""


@query("logistic_three_factors", _with_tests(_saturated(
    _CELL_LOGITS, {"l1": "English", "gender_coarse": "man", "picture": "feminine"})), "analysis", approx="estimate se z p", digits=4)
def _(spark, sf):
    fit = models.logistic(analysis(spark, sf), "subject", ["l1 * gender_coarse * picture"], LEVELS)
    return models.coefficient_table(spark, fit)


@query("factor_levels", """
SELECT 'subject' AS factor, subject AS level FROM analysis GROUP BY ALL UNION ALL SELECT 'l1', l1 FROM analysis GROUP BY ALL
UNION ALL SELECT 'gender_coarse', gender_coarse FROM analysis GROUP BY ALL UNION ALL SELECT 'picture', picture FROM analysis GROUP BY ALL""", "analysis")
def _(spark, sf):
    levels = models.factor_levels(analysis(spark, sf), list(LEVELS))
    return spark.createDataFrame([(f, v) for f, vs in levels.items() for v in vs], "factor STRING, level STRING")


def _mixed_logistic(spark, sf, formulas):
    data = analysis(spark, sf).select("participant", "subject", "l1", "gender_coarse", "picture").cache()
    try:
        return {name: mixed.random_intercept_glm(data, "subject", terms, LEVELS) for name, terms in formulas.items()}
    finally:
        data.unpersist()


_PROFILE_CELLS = [(l, p) for l in LEVELS["l1"] for p in LEVELS["picture"]]
_PROFILE_SUMS = {
    out: " || ',' || ".join(f"CAST(count(*) FILTER (WHERE l1 = '{l}' AND picture = '{p}'{more}) AS VARCHAR)" for l, p in _PROFILE_CELLS)
    for out, more in (("y", " AND subject <> 'He'"), ("n", ""))}


# what the random-intercept fits see of the data
@query("participant_profiles", f"""
SELECT y, n, CAST(count(*) AS DOUBLE) AS weight FROM (
SELECT participant, {_PROFILE_SUMS['y']} AS y, {_PROFILE_SUMS['n']} AS n FROM analysis WHERE subject IS NOT NULL GROUP BY participant) AS p
GROUP BY ALL""", "analysis")
def _(spark, sf):
    known = analysis(spark, sf).where("subject IS NOT NULL")
    combos = [{"l1": l, "picture": p} for l, p in _PROFILE_CELLS]
    profiles = mixed.participant_profiles(known, "participant", combos, (F.col("subject") != "He").cast("double"), F.lit(1.0))
    text = {c: F.array_join(F.transform(c, lambda v: v.cast("bigint").cast("string")), ",") for c in ("y", "n")}
    return profiles.select(text["y"].alias("y"), text["n"].alias("n"), "weight")


@query("random_intercept_logistic")
def _(spark, sf):
    fits = _mixed_logistic(spark, sf, {"max": ["l1 * gender_coarse"]})
    return models.coefficient_table(spark, fits["max"])


def _ladder_of(a: str, b: str) -> dict[str, tuple[list[str], list[str]]]:
    """The published comparisons of two factors: their interaction, then each beside the other."""
    return {f"{a}:{b}": ([f"{a} * {b}"], [a, b]), b: ([a, b], [a]), a: ([a, b], [b])}


def _compare_ladder(spark, sf, ladder):
    formulas = {" + ".join(terms): terms for pair in ladder.values() for terms in pair}
    fits = _mixed_logistic(spark, sf, formulas)
    return models.compare_models(spark, {name: tuple(fits[" + ".join(terms)] for terms in pair) for name, pair in ladder.items()})


@query("random_intercept_comparison")
def _(spark, sf):
    return _compare_ladder(spark, sf, _ladder_of("l1", "gender_coarse"))


@query("random_intercept_pictures")
def _(spark, sf):
    return _compare_ladder(spark, sf, _ladder_of("gender_coarse", "picture"))


@query("random_intercept_poisson")
def _(spark, sf):
    counts = experiment.contingency(analysis(spark, sf), ["participant", "l1", "subject", "picture"]).cache()
    fit = mixed.random_intercept_glm(counts, "n", ["l1 * subject"], LEVELS, family="poisson")
    counts.unpersist()
    return models.coefficient_table(spark, fit)


# the published formula has all four factors; its reference levels are the first in alphabetical order after renaming
_RENAMED = experiment.relevel(LEVELS, subject="They", gender_coarse="nonbinary", picture="nonbinary / other")


@query("random_intercept_four_factors")
def _(spark, sf):
    counts = experiment.contingency(analysis(spark, sf), ["participant", *LEVELS])
    fit = mixed.random_intercept_glm(counts, "n", ["subject * l1 * gender_coarse * picture"], _RENAMED, family="poisson")
    return models.coefficient_table(spark, fit)


@query("random_intercept_crossed")
def _(spark, sf):
    answers = analysis(spark, sf).withColumn("they", F.when(F.col("subject") == "They", "They").otherwise("other"))
    fit = mixed.crossed_intercepts_glm(
        answers, "they", ["gender_coarse * l1"], LEVELS | {"they": ["other", "They"]}, item="picture")
    return models.coefficient_table(spark, fit)
