"""Queries for the rating survey and the forced-choice experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocab
from attestry.operators import balance, density, experiment, profile, survey
from attestry.plans import standins as st
from attestry.plans.ctes import case_of
from attestry.plans.registry import query


# --- rating survey ----------------------------------------------------------------

def _rating_data(spark, sf):
    export = st.rating_export(spark, sf)
    practice = survey.clean_practice(export.where("spreadsheet_freq_block = '0'"))
    ratings = survey.clean_ratings(export.where("spreadsheet_freq_block NOT IN ('0')"))
    return survey.rating_data(practice, ratings, survey.clean_demographics(st.demographics_export(spark, sf)))


@query("clean_practice", "SELECT * FROM practice", "practice")
def _(spark, sf):
    return survey.clean_practice(st.rating_export(spark, sf))


@query("clean_demographics", "SELECT * FROM demographics", "demographics")
def _(spark, sf):
    return survey.clean_demographics(st.demographics_export(spark, sf))


@query("clean_ratings", "SELECT * FROM ratings", "ratings")
def _(spark, sf):
    return survey.clean_ratings(st.rating_export(spark, sf))


@query("rating_data", "SELECT * FROM rating_data", "rating_data")
def _(spark, sf):
    return _rating_data(spark, sf)


@query("ratings_per_name", "SELECT name, freq_block, count(*) AS n FROM rating_data GROUP BY ALL HAVING count(*) > 10", "rating_data")
def _(spark, sf):
    return survey.ratings_per_name(_rating_data(spark, sf), more_than=10)


@query("ratings_per_name_two_sided", """
SELECT name, freq_block, count(*) AS n FROM rating_data
WHERE name IN (SELECT name FROM attest GROUP BY name HAVING count(*) FILTER (WHERE asab = 'F') > 0 AND count(*) FILTER (WHERE asab = 'M') > 0)
GROUP BY ALL""", "rating_data attest")
def _(spark, sf):
    both = profile.attestation_class(st.attestations(spark, sf)).where("class = 'both'")
    return survey.ratings_per_name(_rating_data(spark, sf), both)


@query("world_area_participants", "SELECT area, count(*) AS n FROM placed GROUP BY area", "placed")
def _(spark, sf):
    return survey.participant_area(_rating_data(spark, sf)).groupBy("area").agg(F.count("*").alias("n"))


@query("world_area_registers", f"""
SELECT region, {case_of('region', vocab.REGISTER_AREAS)} AS area, {case_of('region', vocab.REGISTER_TWO_AREAS)} AS two_areas,
       {case_of('region', vocab.REGISTER_AREAS_WITH_NI)} AS area_with_ni, CAST(sum(number) AS BIGINT) AS number FROM attest GROUP BY ALL""", "attest")
def _(spark, sf):
    regions = st.attestations(spark, sf).groupBy("region").agg(F.sum("number").alias("number"))
    region = F.col("region")
    return regions.withColumns({
        "area": survey.world_area(region, vocab.REGISTER_AREAS), "two_areas": survey.world_area(region, vocab.REGISTER_TWO_AREAS),
        "area_with_ni": survey.world_area(region, vocab.REGISTER_AREAS_WITH_NI)})


@query("influence_decade", """
SELECT decade, count(*) AS n FROM (SELECT CAST(round_even(birthyear + 15, -1) AS INTEGER) AS decade FROM rating_data) AS d
WHERE decade >= 1950 GROUP BY decade""", "rating_data")
def _(spark, sf):
    return survey.influence_decade(_rating_data(spark, sf), 15, 1950).groupBy("decade").agg(F.count("*").alias("n"))


@query("names_with_min_ratings", """
SELECT name, nullif(count(*) FILTER (WHERE area = 'Europe'), 0) AS europe, nullif(count(*) FILTER (WHERE area = 'North America'), 0) AS north_america,
       nullif(count(*) FILTER (WHERE area = 'Oceania'), 0) AS oceania
FROM placed GROUP BY name HAVING count(*) FILTER (WHERE area = 'Europe') >= 5 AND count(*) FILTER (WHERE area = 'Oceania') >= 3""", "placed")
def _(spark, sf):
    return survey.names_with_min_ratings(_rating_data(spark, sf), {"Europe": 5, "Oceania": 3})


_ETHNIC = case_of("lower(ethnicity)", vocab.ETHNICITY_CATEGORIES, "'white'")


@query("ethnicity_recode", f"SELECT ethnicity, {_ETHNIC} AS ethnicity_cat, count(*) AS n FROM demographics GROUP BY ALL", "demographics")
def _(spark, sf):
    people = survey.clean_demographics(st.demographics_export(spark, sf))
    return survey.ethnicity_recode(people).groupBy("ethnicity", "ethnicity_cat").agg(F.count("*").alias("n"))


@query("demographic_crosstab", f"""
SELECT {_ETHNIC} AS ethnicity_cat, area, count(*) FILTER (WHERE gender_cat = 'Female') / 51 AS female,
       count(*) FILTER (WHERE gender_cat = 'Male') / 51 AS male, count(*) FILTER (WHERE gender_cat = 'Non binary') / 51 AS non_binary,
       count(*) FILTER (WHERE gender_cat IS NULL) / 51 AS no_answer
FROM placed GROUP BY ALL""", "placed")
def _(spark, sf):
    return survey.demographic_crosstab(_rating_data(spark, sf))


def _kde(points: str, group: str, x_range: float, y_range: float, grid: int, bins: int) -> str:
    step_x, step_y = (f"CAST({r / (grid - 1)!r} AS DOUBLE)" for r in (x_range, y_range))
    return f"""
SELECT {group}, ix, iy, ix * {step_x} AS x, iy * {step_y} AS y, density, ndensity,
       least({bins}, CAST(floor(ndensity * {bins}) AS INTEGER) + 1) AS level FROM (
SELECT *, density / max(density) OVER (PARTITION BY {group}) AS ndensity FROM (
SELECT p.{group}, ix, iy, sum(w * exp(-0.5 * ((ix * {step_x} - p.x) / h_x) ** 2) * exp(-0.5 * ((iy * {step_y} - p.y) / h_y) ** 2))
       / (2 * pi() * any_value(n) * any_value(h_x) * any_value(h_y)) AS density
FROM (SELECT {group}, x, y, count(*) AS w FROM {points} GROUP BY ALL) AS p
JOIN (SELECT {group}, count(*) AS n,
             1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * count(*) ** -0.2 AS h_x,
             1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * count(*) ** -0.2 AS h_y
      FROM {points} GROUP BY {group}) AS h ON h.{group} = p.{group} AND h_x > 0 AND h_y > 0
CROSS JOIN (SELECT CAST(i AS INTEGER) AS ix FROM range({grid}) AS a(i)) AS gx
CROSS JOIN (SELECT CAST(j AS INTEGER) AS iy FROM range({grid}) AS b(j)) AS gy
GROUP BY ALL) AS d) AS s"""


@query("density2d", _kde("(SELECT l_returnflag, l_discount AS x, l_tax AS y FROM lineitem)", "l_returnflag", 0.1, 0.08, 60, 10), "",
       approx="x y density ndensity")
def _(spark, sf):
    items = st.table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return density.density2d(items, ["l_returnflag"], "l_discount", "l_tax", (0.0, 0.1), (0.0, 0.08), grid=60)


def _kde_binned(points: str, group: str, x_range: float, y_range: float, grid: int, bins: int, refine: int) -> str:
    cells = (grid - 1) * refine
    step_x, step_y, fine_x, fine_y = (f"CAST({r / n!r} AS DOUBLE)" for n in (grid - 1, cells) for r in (x_range, y_range))
    return f"""
WITH spread AS (SELECT {group}, count(*) AS n,
             1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * count(*) ** -0.2 AS h_x,
             1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * count(*) ** -0.2 AS h_y
      FROM {points} GROUP BY {group}),
placed AS (SELECT *, least(floor(x / {fine_x}), {cells - 1}) AS jx, least(floor(y / {fine_y}), {cells - 1}) AS jy FROM {points}),
nodes AS (SELECT {group}, jx + r AS jx, jy + u AS jy, sum(CASE r WHEN 1 THEN x / {fine_x} - jx ELSE 1 - (x / {fine_x} - jx) END
             * CASE u WHEN 1 THEN y / {fine_y} - jy ELSE 1 - (y / {fine_y} - jy) END) AS m
      FROM placed CROSS JOIN (VALUES (0), (1)) AS a(r) CROSS JOIN (VALUES (0), (1)) AS b(u) GROUP BY ALL)
SELECT {group}, ix, iy, ix * {step_x} AS x, iy * {step_y} AS y, density, ndensity,
       least({bins}, CAST(floor(ndensity * {bins}) AS INTEGER) + 1) AS level, error FROM (
SELECT *, density / max(density) OVER (PARTITION BY {group}) AS ndensity FROM (
SELECT p.{group}, ix, iy, sum(m * exp(-0.5 * ((ix * {step_x} - jx * {fine_x}) / h_x) ** 2) * exp(-0.5 * ((iy * {step_y} - jy * {fine_y}) / h_y) ** 2))
       / (2 * pi() * any_value(n) * any_value(h_x) * any_value(h_y)) AS density,
       any_value(({fine_x} ** 2 / 8 / h_x ** 2 + {fine_y} ** 2 / 8 / h_y ** 2) / (2 * pi() * h_x * h_y)) AS error
FROM nodes AS p JOIN spread AS h ON h.{group} = p.{group} AND h_x > 0 AND h_y > 0
CROSS JOIN (SELECT CAST(i AS INTEGER) AS ix FROM range({grid}) AS a(i)) AS gx
CROSS JOIN (SELECT CAST(j AS INTEGER) AS iy FROM range({grid}) AS b(j)) AS gy
GROUP BY ALL) AS d) AS s"""


@query("density2d_binned", _kde_binned("(SELECT l_returnflag, CAST(l_discount AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS y FROM lineitem)", "l_returnflag", 0.1, 0.08, 60, 10, 4), "",
       approx="x y density ndensity error")
def _(spark, sf):
    items = st.table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return density.density2d_binned(items, ["l_returnflag"], "l_discount", "l_tax", (0.0, 0.1), (0.0, 0.08), grid=60)


@query("rating_density", _kde("""(SELECT area, fem AS x, masc AS y FROM placed WHERE area IS NOT NULL AND fem BETWEEN 0 AND 100
AND masc BETWEEN 0 AND 100)""", "area", 100.0, 100.0, 30, 15), "placed", approx="x y density ndensity")
def _(spark, sf):
    placed = survey.participant_area(_rating_data(spark, sf)).where("area IS NOT NULL")
    return density.density2d(placed, ["area"], "fem", "masc", (0.0, 100.0), (0.0, 100.0), grid=30, bins=15)


@query("population_density", _kde("""(SELECT region, log10(afab) / log10(yr_max) AS x, log10(amab) / log10(yr_max) AS y FROM (
SELECT *, max(greatest(afab, amab)) OVER (PARTITION BY name, region) AS yr_max FROM cells) AS p WHERE afab > 0 AND amab > 0 AND yr_max > 1)""",
                                "region", 1.0, 1.0, 20, 50), "cells", approx="x y density ndensity")
def _(spark, sf):
    scaled = balance.log_scaled_share(balance.log_ratio_annual_regional(st.attestations(spark, sf), []))
    return density.density2d(scaled, ["region"], "logprop_afab", "logprop_amab", (0.0, 1.0), (0.0, 1.0), grid=20, bins=50)


@query("population_vs_ratings", f"""
SELECT coalesce(p.name, r.name) AS name, CASE WHEN p.name IS NULL THEN r.area ELSE p.area END AS area, coalesce(p.decade, r.decade) AS decade,
       cells, mean_logprop_afab, mean_logprop_amab, ratings, mean_fem, mean_masc FROM (
SELECT name, area, decade, count(*) AS cells, avg(CASE WHEN afab > 0 AND yr_max > 1 THEN log10(afab) / log10(yr_max) END) AS mean_logprop_afab,
       avg(CASE WHEN amab > 0 AND yr_max > 1 THEN log10(amab) / log10(yr_max) END) AS mean_logprop_amab FROM (
SELECT *, max(greatest(afab, amab)) OVER (PARTITION BY name, area) AS yr_max, CAST(round_even(year, -1) AS INTEGER) AS decade FROM (
SELECT *, {case_of('region', vocab.REGISTER_AREAS)} AS area FROM cells WHERE region NOT IN ('Northern Ireland')) AS a) AS y
WHERE decade >= 1950 GROUP BY ALL) AS p
FULL JOIN (SELECT name, area, decade, count(*) AS ratings, avg(fem) / 100 AS mean_fem, avg(masc) / 100 AS mean_masc
FROM placed WHERE decade >= 1950 GROUP BY ALL) AS r ON p.name = r.name AND p.area IS NOT DISTINCT FROM r.area AND p.decade = r.decade""",
       "cells placed", approx="mean_logprop_afab mean_logprop_amab mean_fem mean_masc")
def _(spark, sf):
    cells = balance.log_ratio_annual_regional(st.attestations(spark, sf), [])
    return survey.population_vs_ratings(cells, _rating_data(spark, sf))


# --- forced-choice experiment -------------------------------------------------------

@query("strip_markers", """
SELECT 'first' AS node, 'L1' AS key, count(*) AS n FROM language UNION ALL
SELECT 'english', k, count(*) FROM language CROSS JOIN (VALUES ('LocL1Eng'), ('DateL1Eng-inmonths')) AS e(k) WHERE l1 = 'English' GROUP BY k UNION ALL
SELECT 'spanish', k, count(*) FROM language CROSS JOIN (VALUES ('LocL2Eng'), ('DateL2Eng-inmonths'), ('TimeuseEng')) AS s(k)
WHERE l1 <> 'English' GROUP BY k UNION ALL
SELECT 'trials', z, count(*) FROM orders CROSS JOIN (VALUES ('buttonA'), ('buttonB')) AS t(z) GROUP BY z""", "language")
def _(spark, sf):
    first, english, spanish = st.language_exports(spark, sf)
    left = {
        "first": experiment.strip_questionnaire(first, ["L1-quantised"]).select(F.col("question_key").alias("key")),
        "english": experiment.strip_questionnaire(english, ["LocL1Eng-quantised"]).select(F.col("question_key").alias("key")),
        "spanish": experiment.strip_questionnaire(spanish, ["LocL2Eng-quantised", "TimeuseEng-quantised"]).select(
            F.col("question_key").alias("key")),
        "trials": experiment.strip_task(st.trials_export(spark, sf)).select(F.col("zone_name").alias("key")),
    }
    counted = [rows.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(node).alias("node"), "key", "n")
               for node, rows in left.items()]
    return reduce(DataFrame.unionByName, counted)


@query("clean_consent", "SELECT * FROM consent", "consent")
def _(spark, sf):
    return experiment.clean_consent(st.consent_export(spark, sf))


@query("clean_gender", "SELECT * FROM gender", "gender")
def _(spark, sf):
    return experiment.clean_gender(st.gender_export(spark, sf))


@query("clean_gender_first_study", f"""
SELECT * REPLACE ({case_of('gender_text', vocab.GENDER_COARSE_FIRST_STUDY, "'other'")} AS gender_coarse) FROM gender""", "gender")
def _(spark, sf):
    return experiment.clean_gender(st.gender_export(spark, sf), vocab.GENDER_COARSE_FIRST_STUDY)


@query("clean_language", "SELECT * FROM language", "language")
def _(spark, sf):
    return experiment.clean_language(*st.language_exports(spark, sf))


@query("score_practice", "SELECT * FROM practice_points", "practice_points")
def _(spark, sf):
    return experiment.score_practice(st.practice_export(spark, sf))


@query("clean_trials", "SELECT * FROM trials", "trials")
def _(spark, sf):
    return experiment.clean_trials(st.trials_export(spark, sf))


def _assembled(spark, sf):
    return experiment.assemble(
        experiment.clean_consent(st.consent_export(spark, sf)), experiment.clean_trials(st.trials_export(spark, sf)),
        experiment.score_practice(st.practice_export(spark, sf)), experiment.clean_language(*st.language_exports(spark, sf)),
        experiment.clean_gender(st.gender_export(spark, sf)))


def analysis(spark, sf):
    return experiment.prepare_analysis(_assembled(spark, sf))


@query("assemble", "SELECT * FROM assembled", "assembled")
def _(spark, sf):
    return _assembled(spark, sf)


@query("prepare_analysis", "SELECT participant, trial_number, subject, l1, image_gender, picture FROM analysis", "analysis")
def _(spark, sf):
    return analysis(spark, sf).select("participant", "trial_number", "subject", "l1", "image_gender", "picture")


@query("contingency", "SELECT l1, gender_coarse, subject, picture, count(*) AS n FROM analysis GROUP BY ALL", "analysis")
def _(spark, sf):
    return experiment.contingency(analysis(spark, sf), ["l1", "gender_coarse", "subject", "picture"])


@query("contingency_participants", "SELECT l1, gender_coarse, count(*) / 20 AS n FROM analysis GROUP BY ALL", "analysis")
def _(spark, sf):
    return experiment.contingency(analysis(spark, sf), ["l1", "gender_coarse"], unit=20)


@query("contingency_one_image", "SELECT l1, gender_coarse, count(*) AS n FROM analysis WHERE image = 'fem- dive.jpg' GROUP BY ALL", "analysis")
def _(spark, sf):
    return experiment.contingency(analysis(spark, sf), ["l1", "gender_coarse"], where=F.col("image") == "fem- dive.jpg")


@query("contingency_by_participant", "SELECT participant, subject, picture, count(*) AS n FROM analysis GROUP BY ALL", "analysis")
def _(spark, sf):
    return experiment.contingency(analysis(spark, sf), ["participant", "subject", "picture"])


_PERCENTS = {
    "percent_subject_by_language": (["l1", "subject"], ["l1"], None),
    "percent_subject_by_gender": (["subject", "gender_coarse", "l1"], ["gender_coarse", "l1"], None),
    "percent_they_by_picture": (["gender_coarse", "l1", "picture"], ["gender_coarse", "l1"], "subject = 'They'"),
    "percent_subject_by_image": (["l1", "image_gender", "subject"], ["l1", "image_gender"], None),
    "percent_subject_by_image_and_gender": (["l1", "image_gender", "gender_coarse", "subject"], ["l1", "image_gender", "gender_coarse"], None),
}
for _name, (_keys, _within, _where) in _PERCENTS.items():
    _k, _w = ", ".join(_keys), ", ".join(_within)
    _sql = f"""SELECT *, count / total AS percent FROM (SELECT {_k}, count, CAST(sum(count) OVER (PARTITION BY {_w}) AS BIGINT) AS total
FROM (SELECT {_k}, count(*) AS count FROM analysis {'WHERE ' + _where if _where else ''} GROUP BY ALL) AS c) AS t"""
    query(_name, _sql, "analysis")(
        lambda s, sf, k=_keys, w=_within, c=_where: experiment.percent_within(analysis(s, sf), k, w, F.expr(c) if c else None))


@query("contrast_code", """
SELECT l1, CASE WHEN gender_coarse <> 'nonbinary' THEN -0.75 ELSE 0.25 END::DOUBLE AS gender,
       CASE WHEN subject <> 'They' THEN -0.6667 ELSE 0.3333 END::DOUBLE AS subject,
       CASE WHEN picture <> 'nonbinary / other' THEN -0.6667 ELSE 0.3333 END::DOUBLE AS picture, count(*) AS n FROM analysis GROUP BY ALL""", "analysis")
def _(spark, sf):
    return experiment.contrast_code(analysis(spark, sf))
