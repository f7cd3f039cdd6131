"""Queries over the attestation fact: balance, stimuli, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import balance, profile, sketches, stimuli
from attestry.plans import ctes, standins
from attestry.plans.ctes import in_list
from attestry.plans.registry import query
from attestry.session import materialize

# Stand-ins for placeholder names, so that the filter removes something.
PLACE = ["small ring Brand#2", "red widget Brand#17", "blue bolt Brand#4"]
_NOT_PLACE = f"name NOT IN {in_list(PLACE)}"
TOP = 300


def _ranked(spark, sf):
    return balance.balance_rank(balance.balance_profile(standins.attestations(spark, sf)))


def _top_of(facts):
    return balance.top_balanced(balance.balance_rank(balance.balance_profile(facts)), TOP)


def _facts_and_top(spark, sf):
    """The fact with shares, stored once, and its most balanced names."""
    facts = materialize(standins.with_shares(spark, sf))
    return facts, _top_of(facts)


@query("drop_placeholders", f"SELECT year, name, asab, region, number FROM attest WHERE {_NOT_PLACE}", "attest")
def _(spark, sf):
    return balance.drop_placeholders(standins.attestations(spark, sf), PLACE)


@query("widen_by_sex", """
SELECT name, year, region, max(number) FILTER (WHERE asab = 'F') AS number_F, max(number) FILTER (WHERE asab = 'M') AS number_M,
       max(number) FILTER (WHERE asab = 'X') AS number_X, max(proportion) FILTER (WHERE asab = 'F') AS proportion_F,
       max(proportion) FILTER (WHERE asab = 'M') AS proportion_M, max(proportion) FILTER (WHERE asab = 'X') AS proportion_X
FROM facts GROUP BY ALL""", "facts")
def _(spark, sf):
    return balance.widen_by_sex(standins.with_shares(spark, sf), ("number", "proportion"))


@query("log_ratio_annual_regional", f"SELECT * FROM cells WHERE {_NOT_PLACE}", "cells", approx="log_ratio")
def _(spark, sf):
    return balance.log_ratio_annual_regional(standins.attestations(spark, sf), PLACE)


def _grain(by: str, counts: str) -> str:
    return f"""
SELECT {by}, {counts}, CAST(sum(f) AS BIGINT) AS total_afab, CAST(sum(m) AS BIGINT) AS total_amab,
       CAST(sum(f) + sum(m) AS BIGINT) AS total_people,
       CASE WHEN sum(f) > 0 AND sum(m) > 0 THEN abs(ln(sum(f) / sum(m))) END AS log_ratio
FROM wide WHERE {_NOT_PLACE} GROUP BY {by}"""


@query("log_ratio_annual", _grain("name, year", "count(DISTINCT region) AS regions"), "wide", approx="log_ratio")
def _(spark, sf):
    return balance.log_ratio_annual(standins.attestations(spark, sf), PLACE)


@query("log_ratio_regional", _grain("name, region", "count(DISTINCT year) AS years"), "wide", approx="log_ratio")
def _(spark, sf):
    return balance.log_ratio_regional(standins.attestations(spark, sf), PLACE)


@query("log_ratio_combined", _grain("name", "count(DISTINCT region) AS regions, count(DISTINCT year) AS years"), "wide",
       approx="log_ratio")
def _(spark, sf):
    return balance.log_ratio_combined(standins.attestations(spark, sf), PLACE)


def _grain_part(grain: str, by: str, year: str, region: str) -> str:
    return f"""SELECT '{grain}' AS grain, name, {year} AS year, {region} AS region, count(*) AS cells,
       CAST(sum(f) AS BIGINT) AS total_afab, CAST(sum(m) AS BIGINT) AS total_amab, CAST(sum(f) + sum(m) AS BIGINT) AS total_people,
       CASE WHEN sum(f) > 0 AND sum(m) > 0 THEN abs(ln(sum(f) / sum(m))) END AS log_ratio
FROM wide WHERE {_NOT_PLACE} GROUP BY {by}"""


@query("log_ratio_grains", "\nUNION ALL\n".join([
    _grain_part("annual", "name, wide.year", "wide.year", "CAST(NULL AS VARCHAR)"),
    _grain_part("regional", "name, wide.region", "CAST(NULL AS INTEGER)", "wide.region"),
    _grain_part("combined", "name", "CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)"),
]), "wide", approx="log_ratio")
def _(spark, sf):
    return balance.log_ratio_grains(standins.attestations(spark, sf), PLACE)


_PROFILE = "mean_logratio median_logratio sd_logratio se_logratio max_logratio min_logratio"


@query("balance_profile", f"SELECT * FROM profile WHERE {_NOT_PLACE}", "profile", approx=_PROFILE)
def _(spark, sf):
    return balance.balance_profile(standins.attestations(spark, sf), placeholders=PLACE)


@query("balance_profile_by_region", ctes.profile("name, region"), "cells", approx=_PROFILE)
def _(spark, sf):
    return balance.balance_profile(standins.attestations(spark, sf), ("name", "region"))


@query("balance_profile_one_region", "SELECT * FROM profile_usa", "profile_usa", approx=_PROFILE + " mean_logratio2")
def _(spark, sf):
    usa = standins.attestations(spark, sf).where("region = 'USA'")
    return balance.balance_profile(usa, region_scaled=False)


@query("discarded_entries", """
SELECT count(*) FILTER (WHERE log_ratio IS NULL) AS discarded, count(*) FILTER (WHERE log_ratio IS NOT NULL) AS kept,
       count(*) FILTER (WHERE log_ratio IS NULL) / count(*) AS share FROM cells""", "cells")
def _(spark, sf):
    return balance.discarded_entries(standins.attestations(spark, sf))


_RANKS = "rank_order, order_logratio, order_mean, order_common, combined_order"


@query("balance_rank", f"SELECT name, entries, regions, weighted_frequency, {_RANKS} FROM ranked", "ranked")
def _(spark, sf):
    return _ranked(spark, sf).select("name", "entries", "regions", "weighted_frequency", *_RANKS.split(", "))


_FILTER = dict(min_at_most=0.3, max_at_most=1.5, sd_at_most=0.6, mean_at_most=0.9, median_at_most=0.9, total_at_least=100)
_FILTERED = f"""(SELECT * FROM profile_usa WHERE {_NOT_PLACE} AND entries >= 2 AND min_logratio <= 0.3 AND max_logratio <= 1.5
AND sd_logratio <= 0.6 AND mean_logratio <= 0.9 AND median_logratio <= 0.9 AND mean_logratio2 <= 1 AND total_F >= 100 AND total_M >= 100)"""


def _norming(spark, sf):
    usa = standins.attestations(spark, sf).where("region = 'USA'")
    return balance.norming_filter(balance.balance_profile(usa, region_scaled=False), PLACE, **_FILTER)


@query("norming_filter", f"SELECT * FROM {_FILTERED} AS f", "profile_usa", approx=_PROFILE + " mean_logratio2")
def _(spark, sf):
    return _norming(spark, sf)


@query("balance_rank_one_region",
       f"SELECT name, {_RANKS} FROM ({ctes.ranked_single(_FILTERED + ' AS f', 'sd_logratio')}) AS r", "profile_usa")
def _(spark, sf):
    return balance.balance_rank_single(_norming(spark, sf), "sd_logratio").select("name", *_RANKS.split(", "))


@query("lookup_ranks", f"""
SELECT rank_order, name, entries, mean_logratio, order_logratio, order_mean, order_common, combined_order
FROM ({ctes.ranked_single('profile_usa', 'mean_logratio')}) AS r
WHERE name IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_type = 'PROMO')""", "profile_usa", approx="mean_logratio")
def _(spark, sf):
    usa = standins.attestations(spark, sf).where("region = 'USA'")
    ranked = balance.balance_rank_single(balance.balance_profile(usa, region_scaled=False))
    promo = standins.table(spark, sf, "part").where("p_type = 'PROMO'").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return balance.lookup_ranks(ranked, promo)


@query("top_balanced", f"SELECT name, rank_order FROM ranked WHERE rank_order <= {TOP}", "ranked")
def _(spark, sf):
    return _top_of(standins.attestations(spark, sf))


_SENTENCE = "upper(name[1]) || lower(name[2:])"


def _unisex_sql() -> str:
    cells = []
    for out, code in (("AFAB", "F"), ("AMAB", "M"), ("X", "X")):
        for v in ("number", "rank", "proportion"):
            cells.append(f"coalesce(max({v}) FILTER (WHERE asab = '{code}'), 0) AS {v}_{out}")
        cells.append(f"coalesce(max(years) FILTER (WHERE asab = '{code}'), 0) AS year_count_{out}")
    return f"""
SELECT * EXCLUDE (year_count_AFAB, year_count_AMAB) FROM (
SELECT *, max(year_count_reg) OVER (PARTITION BY name) AS year_count FROM (
SELECT *, least(year_count_AFAB, year_count_AMAB) AS year_count_reg FROM (
SELECT {_SENTENCE} AS name, year, region, {', '.join(cells)}
FROM (SELECT *, count(*) OVER (PARTITION BY name, asab, region) AS years FROM facts) AS f GROUP BY ALL))) AS u
WHERE year_count > 0"""


@query("unisex_dataset", _unisex_sql(), "facts")
def _(spark, sf):
    return balance.unisex_dataset(standins.names_combined(spark, sf))


@query("unisex_above_share", "SELECT DISTINCT name FROM widefacts WHERE proportion_F > 0.0012 AND proportion_M > 0.0012", "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.unisex_above_share(facts, names, 0.0012)


_PEAKS = f"""
SELECT name, region, max(@_M) AS @_M, max(@_F) AS @_F FROM widefacts
WHERE proportion_F IS NOT NULL AND proportion_M IS NOT NULL AND number_F >= 30 AND number_M >= 30 AND {_NOT_PLACE}
GROUP BY ALL"""


@query("peak_counts", _PEAKS.replace("@", "number"), "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.peak_counts(facts, names, 30, placeholders=PLACE)


@query("peak_shares", _PEAKS.replace("@", "proportion"), "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.peak_counts(facts, names, 30, "proportion", PLACE)


@query("region_coverage", f"SELECT name, count(*) AS regions FROM ({_PEAKS.replace('@', 'number')}) AS p GROUP BY name", "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    peaks = balance.peak_counts(facts, names, 30, placeholders=PLACE)
    return balance.region_coverage(peaks)


def _international(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.international_unisex(facts, names, 0.3, 20)


@query("international_unisex", "SELECT * FROM international", "international")
def _(spark, sf):
    return _international(spark, sf)


@query("columns_by_count", """
SELECT position, max(name) FILTER (WHERE count = 3) AS n3, max(name) FILTER (WHERE count = 4) AS n4, max(name) FILTER (WHERE count = 5) AS n5
FROM (SELECT count, name, CAST(row_number() OVER (PARTITION BY count ORDER BY name) AS INTEGER) AS position FROM international) AS p
GROUP BY position HAVING max(name) FILTER (WHERE count = 3) IS NOT NULL""", "international")
def _(spark, sf):
    return balance.columns_by_count(_international(spark, sf), drop_below=3, through=len(standins.REGIONS))


@query("mutual_ratio_filter", f"""
SELECT name, year, region, number_F, number_M, proportion_F, proportion_M FROM widefacts
WHERE proportion_F > 0.0005 AND proportion_M > 0.0005 AND number_M / number_F > 0.25 AND number_F / number_M > 0.25 AND {_NOT_PLACE}""",
       "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.mutual_ratio_filter(facts, names, exclude=PLACE)


@query("trajectories", """
SELECT region, name, year, number_F, number_M FROM (
SELECT *, count(*) OVER (PARTITION BY region, name) AS points FROM widefacts WHERE proportion_F > 0.0005 AND proportion_M > 0.0005) AS t
WHERE points > 1""", "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.trajectories(facts, names, share=0.0005, min_points=2)


@query("trajectories_share", """
SELECT region, name, year, proportion_F, proportion_M FROM widefacts WHERE proportion_F > 0 AND proportion_M > 0""", "widefacts")
def _(spark, sf):
    facts, names = _facts_and_top(spark, sf)
    return balance.trajectories(facts, names, measure="proportion", two_sided=True)


@query("trajectories_filled", """
SELECT region, name, year, f AS number_F, m AS number_M FROM wide WHERE name IN (SELECT name FROM top)""", "wide top")
def _(spark, sf):
    facts = standins.stored(spark, sf)
    return balance.trajectories(facts, _top_of(facts), fill=0)


@query("pairwise_rank_summary", """
SELECT locale, name, rank_F, rank_M, count_F, count_M, total_F, total_M, rank_M - rank_F AS rank_diff, (rank_F + rank_M) / 2 AS rank_mean,
       (count_F + count_M) / 2 AS count_mean, total_F + total_M AS total_count, ln(total_F + total_M) AS log_count,
       abs(rank_M - rank_F) AS abs_diff
FROM (SELECT region AS locale, name, avg(rank) FILTER (WHERE asab = 'F') AS rank_F, avg(rank) FILTER (WHERE asab = 'M') AS rank_M,
             avg(number) FILTER (WHERE asab = 'F') AS count_F, avg(number) FILTER (WHERE asab = 'M') AS count_M,
             CAST(sum(number) FILTER (WHERE asab = 'F') AS BIGINT) AS total_F, CAST(sum(number) FILTER (WHERE asab = 'M') AS BIGINT) AS total_M
      FROM facts GROUP BY ALL) AS p
WHERE rank_F IS NOT NULL AND rank_M IS NOT NULL""", "facts",
       approx="log_count")
def _(spark, sf):
    pairs = standins.names_combined(spark, sf).groupBy(F.col("region").alias("locale"), "name", "asab").agg(
        F.avg("rank").alias("rank"), F.avg("number").alias("count"), F.sum("number").alias("total"))
    return balance.pairwise_rank_summary(pairs)


def _dominance(source: str, ids: str, f: str, m: str, top: str, scale: int) -> str:
    return f"""
SELECT *, (max_f_prop + total_f_prop) / 2 * {scale} AS fem, (max_m_prop + total_m_prop) / 2 * {scale} AS masc FROM (
SELECT {ids}, {f}, {m}, max_asab, {f} / nullif(max_asab, 0) AS max_f_prop, {f} / nullif({f} + {m}, 0) AS total_f_prop,
       {m} / nullif(max_asab, 0) AS max_m_prop, {m} / nullif({f} + {m}, 0) AS total_m_prop
FROM (SELECT *, {top} AS max_asab FROM {source}) AS s) AS d"""


@query("dominance_shares", _dominance("combined", "name", "total_afab", "total_amab", "greatest(total_afab, total_amab)", 100), "combined")
def _(spark, sf):
    totals = balance.log_ratio_combined(standins.attestations(spark, sf)).select("name", "total_afab", "total_amab")
    return balance.dominance_shares(totals)


@query("dominance_shares_regional", _dominance(
    "(SELECT name, region, CAST(sum(f) AS BIGINT) AS total_afab, CAST(sum(m) AS BIGINT) AS total_amab FROM wide GROUP BY ALL)",
    "name, region", "total_afab", "total_amab", "greatest(total_afab, total_amab)", 100), "wide")
def _(spark, sf):
    totals = balance.log_ratio_regional(standins.attestations(spark, sf)).select("name", "region", "total_afab", "total_amab")
    return balance.dominance_shares(totals)


@query("dominance_shares_annual", _dominance(
    "cells", "name, year, region", "afab", "amab", "max(greatest(afab, amab)) OVER (PARTITION BY name)", 1), "cells")
def _(spark, sf):
    cells = balance.log_ratio_annual_regional(standins.attestations(spark, sf)).select("name", "year", "region", "afab", "amab")
    return balance.dominance_shares(cells, "afab", "amab", 1.0, ["name"])


_PEAKED = "(SELECT *, max(greatest(afab, amab)) OVER (PARTITION BY name, region) AS yr_max FROM cells)"


@query("log_scaled_share", f"""
SELECT name, year, region, afab, amab, yr_max, CASE WHEN afab > 0 AND yr_max > 1 THEN log10(afab) / log10(yr_max) END AS logprop_afab,
       CASE WHEN amab > 0 AND yr_max > 1 THEN log10(amab) / log10(yr_max) END AS logprop_amab FROM {_PEAKED} AS p""", "cells",
       approx="logprop_afab logprop_amab")
def _(spark, sf):
    cells = balance.log_ratio_annual_regional(standins.attestations(spark, sf)).select("name", "year", "region", "afab", "amab")
    return balance.log_scaled_share(cells)


@query("balance_angle", f"""
SELECT region, name, plot_degrees, count(*) AS n FROM (
SELECT region, name, CASE WHEN yr_max > 0 THEN CAST(round_even(degrees(atan2(amab / yr_max, afab / yr_max)), 0) AS INTEGER) - 45 END AS plot_degrees
FROM {_PEAKED} AS p) AS a GROUP BY ALL""", "cells")
def _(spark, sf):
    return balance.balance_angle(balance.log_ratio_annual_regional(standins.attestations(spark, sf)))


# --- stimuli ----------------------------------------------------------------------

_BLOCKS = """
SELECT name, count, CAST(CASE WHEN count <= 25 THEN round_even(count, -1) ELSE round_even(count, -2) END AS BIGINT) AS freq_block
FROM (SELECT name, count(*) AS count FROM attest GROUP BY name) AS c"""


@query("freq_block", _BLOCKS, "attest")
def _(spark, sf):
    return stimuli.freq_block(standins.attestations(spark, sf), 25)


@query("freq_block_histogram", f"SELECT freq_block, count(*) AS n FROM ({_BLOCKS}) AS b GROUP BY 1", "attest")
def _(spark, sf):
    return stimuli.freq_block_histogram(standins.attestations(spark, sf), 25)


_PILOT = """
SELECT 'Rating' AS display, name, CAST(round_even(tens, -2) AS BIGINT) AS freq_block
FROM (SELECT name, CAST(round_even(count(*), -1) AS BIGINT) AS tens FROM attest GROUP BY name HAVING count(*) >= 4) AS t WHERE tens >= 60"""


@query("pilot_list", _PILOT, "attest")
def _(spark, sf):
    return stimuli.pilot_list(standins.attestations(spark, sf), min_block=60)


_CUTS = dict(ratio_cut=0.2, amab_freq=6.6, afab_freq=6.5, equi_freq=7.0)


def _strata(spark, sf):
    return stimuli.biased_strata(balance.log_ratio_combined(standins.attestations(spark, sf)), **_CUTS)


def _stratum(label: str, members: str, total: str, cut: float, sign: str) -> str:
    return f"""SELECT name, log_ratio, total_afab, total_amab, total_people, ln({total}) AS freq, round_even(ln({total}), 0) AS freq_block,
       {total} / years AS ppl_per_year, '{label}' AS type,
       CAST(row_number() OVER (ORDER BY {sign} log_ratio, {total} / years, name) AS INTEGER) AS type_rank
FROM combined WHERE {members} AND {total} > 0 AND ln({total}) > {cut}"""


_STRATA = "(" + "\nUNION ALL\n".join([
    _stratum("amab-biased", "log_ratio > 0.2", "total_amab", 6.6, "-"),
    _stratum("afab-biased", "log_ratio > 0.2", "total_afab", 6.5, "-"),
    _stratum("equi-biased", "log_ratio <= 0.2", "total_people", 7.0, ""),
]) + ") AS strata"


@query("biased_strata", f"SELECT * FROM {_STRATA}", "combined", approx="log_ratio freq")
def _(spark, sf):
    return _strata(spark, sf)


@query("strata_summary", f"SELECT type, count(*) AS n, min(ppl_per_year) AS min_ppl_per_year FROM {_STRATA} GROUP BY type", "combined")
def _(spark, sf):
    return stimuli.strata_summary(_strata(spark, sf))


@query("block_by_rank", f"""
SELECT 'Rating' AS display, name, CASE WHEN type_rank <= 10 THEN 0 WHEN type_rank <= 30 THEN 1 WHEN type_rank <= 90 THEN 2
       WHEN type_rank <= 170 THEN 3 WHEN type_rank <= 300 THEN 4 ELSE 5 END AS freq_block, type FROM {_STRATA}""", "combined")
def _(spark, sf):
    return stimuli.block_by_rank(_strata(spark, sf))


@query("restrict_to_list", f"SELECT name, type, type_rank FROM {_STRATA} WHERE name IN (SELECT name FROM ({_PILOT}) AS p)", "combined attest")
def _(spark, sf):
    facts = standins.stored(spark, sf)
    strata = stimuli.biased_strata(balance.log_ratio_combined(facts), **_CUTS)
    return stimuli.restrict_to_list(strata, stimuli.pilot_list(facts, min_block=60)).select("name", "type", "type_rank")


# --- corpus profile -----------------------------------------------------------------

def _medium(spark, sf):
    return standins.stored(spark, sf, "medium")


@query("corpus_profile", """
SELECT count(*) AS entries, count(*) FILTER (WHERE asab = 'F') AS entries_f, count(*) FILTER (WHERE asab = 'M') AS entries_m,
       count(DISTINCT name) AS names, count(DISTINCT region) AS regions, count(*) FILTER (WHERE asab = 'F') / count(*) AS share_f
FROM attest""", "attest")
def _(spark, sf):
    return profile.corpus_profile(standins.attestations(spark, sf))


@query("region_year_span", """
SELECT region, min(year) AS earliest, max(year) AS latest, max(year) - min(year) + 1 AS years FROM attest GROUP BY region""", "attest")
def _(spark, sf):
    return profile.region_year_span(standins.attestations(spark, sf))


_CLASSES = """
SELECT name, fem, msc, CASE WHEN fem > 0 AND msc > 0 THEN 'both' WHEN fem > 0 THEN 'F only' WHEN msc > 0 THEN 'M only' END AS class
FROM (SELECT name, nullif(count(*) FILTER (WHERE asab = 'F'), 0) AS fem, nullif(count(*) FILTER (WHERE asab = 'M'), 0) AS msc
      FROM attest GROUP BY name) AS c"""


@query("attestation_class", _CLASSES, "attest")
def _(spark, sf):
    return profile.attestation_class(standins.attestations(spark, sf))


@query("attestation_class_counts", f"""
SELECT class, count(*) AS names, count(*) FILTER (WHERE name IN (SELECT name FROM ratings)) AS rated_names
FROM ({_CLASSES}) AS k WHERE class IS NOT NULL GROUP BY class""", "attest ratings")
def _(spark, sf):
    from attestry.operators import survey
    return profile.attestation_class_counts(standins.attestations(spark, sf), survey.clean_ratings(standins.rating_export(spark, sf)))


_STATS = """count(total) AS n, min(total) AS min, max(total) AS max, avg(total) AS mean, stddev_samp(total) AS sd,
       stddev_samp(total) / sqrt(count(*)) AS se, quantile_cont(total, 0.5) AS median"""


@query("total_distribution", f"""
SELECT region, asab, {_STATS} FROM (SELECT region, name, asab, CAST(sum(number) AS BIGINT) AS total FROM attest GROUP BY ALL) AS t
GROUP BY ALL""", "attest", approx="sd se")
def _(spark, sf):
    return profile.total_distribution(standins.attestations(spark, sf))


@query("coverage_distribution", f"""
SELECT regions, {_STATS} FROM (
SELECT name, CAST(sum(total) AS BIGINT) AS total, count(*) AS regions FROM (
SELECT name, region, CAST(sum(number) AS BIGINT) AS total FROM attest WHERE {_NOT_PLACE} GROUP BY ALL) AS r
WHERE total > 200 GROUP BY name) AS t GROUP BY ALL""", "attest", approx="sd se")
def _(spark, sf):
    return profile.coverage_distribution(standins.attestations(spark, sf), 200, PLACE)


@query("above_median", """
SELECT a.year, a.name, a.asab, a.region, a.number, median FROM medium AS a JOIN (
SELECT region, asab, quantile_cont(total, 0.5) AS median FROM (
SELECT region, name, asab, sum(number)::BIGINT AS total FROM attest GROUP BY ALL) AS t GROUP BY ALL) AS q USING (region, asab)
WHERE number > median""".replace("medium", "attest"), "attest")
def _(spark, sf):
    return profile.above_median(standins.stored(spark, sf))


@query("longevity", "SELECT * FROM longevities", "longevities")
def _(spark, sf):
    return profile.longevity(_medium(spark, sf))


@query("longstanding_unisex", """
SELECT DISTINCT name FROM (SELECT region, name FROM longevities WHERE attestations = total_years AND asab IN ('F', 'M')
GROUP BY region, name HAVING count(*) = 2) AS l""", "longevities")
def _(spark, sf):
    return profile.longstanding_unisex(profile.longevity(_medium(spark, sf)))


@query("longevity_series", """
SELECT m.year, region, name, asab, m.number, percent FROM medium AS m JOIN longevities USING (region, name, asab)
WHERE attestations = total_years AND percent >= 0.0012 AND percent < 0.002""", "medium longevities")
def _(spark, sf):
    facts = _medium(spark, sf)
    return profile.longevity_series(facts, profile.longevity(facts), 0.0012, 0.002)


_ALWAYS = """SELECT name, asab, count(*) AS count FROM medium WHERE region = 'USA' AND number > 50 GROUP BY name, asab HAVING count(*) >= 5"""


@query("always_attested", _ALWAYS, "medium")
def _(spark, sf):
    return profile.always_attested(_medium(spark, sf), min_years=5)


@query("always_attested_rows", f"""
SELECT year, name, asab, region, number FROM medium WHERE region = 'USA' AND name IN (SELECT name FROM ({_ALWAYS}) AS a)""", "medium")
def _(spark, sf):
    return profile.always_attested_rows(_medium(spark, sf), min_years=5)


@query("always_attested_series", f"""
SELECT m.year, name, asab, m.region, m.number, a.count FROM medium AS m JOIN ({_ALWAYS}) AS a USING (name, asab) WHERE m.region = 'USA'""",
       "medium")
def _(spark, sf):
    return profile.always_attested_series(_medium(spark, sf), min_years=5)


@query("sketched_profile")
def _(spark, sf):
    cells = materialize(sketches.name_sketches(standins.attestations(spark, sf)))
    by_region = sketches.unisex_sketch(cells, ["region"])
    return by_region.unionByName(sketches.unisex_sketch(cells).withColumn("region", F.lit(None).cast("string")))


@query("unisex_intersection", f"""
SELECT name FROM medium WHERE asab = 'F' INTERSECT SELECT name FROM medium WHERE asab = 'M' INTERSECT SELECT name FROM ({_ALWAYS}) AS a""",
       "medium")
def _(spark, sf):
    facts = _medium(spark, sf)
    return profile.unisex_intersection(facts, profile.always_attested(facts, min_years=5))


_AREA = """CASE WHEN region IN ('Canada', 'USA') THEN 'North America'
     WHEN region IN ('England and Wales', 'Northern Ireland', 'Ireland', 'Scotland') THEN 'Europe'
     WHEN region IN ('Australia', 'New Zealand') THEN 'Oceania' END"""


@query("top_per_area", f"""
SELECT name, area, sum, rank FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY area ORDER BY sum DESC, name) AS INTEGER) AS rank FROM (
SELECT name, {_AREA} AS area, CAST(sum(number) AS BIGINT) AS sum FROM attest GROUP BY ALL) AS s) AS r WHERE rank <= 100""", "attest")
def _(spark, sf):
    return profile.top_per_area(standins.attestations(spark, sf))


@query("decade_rollup", """
SELECT name, region, CAST(round_even(year, -1) AS INTEGER) AS decade, CAST(sum(afab) AS BIGINT) AS afab, CAST(sum(amab) AS BIGINT) AS amab,
       count(*) AS n FROM cells GROUP BY ALL""", "cells")
def _(spark, sf):
    return profile.decade_rollup(balance.log_ratio_annual_regional(standins.attestations(spark, sf), []))


@query("histogram_width", """
SELECT region, ceil(number / 50 - 0.5) * 50 + 0 AS bin_center, count(*) AS n FROM attest GROUP BY ALL""", "attest")
def _(spark, sf):
    return profile.histogram(standins.attestations(spark, sf), "number", ["region"], binwidth=50)


@query("histogram_log_bins", """
SELECT region, asab, ceil(x / w - 0.5) * w AS bin_center, count(*) AS n FROM (
SELECT region, asab, log10(total) AS x, (max(log10(total)) OVER () - min(log10(total)) OVER ()) / 49 AS w FROM (
SELECT region, name, asab, sum(number) AS total FROM attest GROUP BY ALL) AS t) AS b GROUP BY ALL""", "attest", approx="bin_center")
def _(spark, sf):
    return profile.histogram(profile.name_totals(standins.attestations(spark, sf)), "total", ["region", "asab"], bins=50, log=True)


@query("name_rows", "SELECT year, name, asab, region, number FROM attest WHERE name = 'red widget Brand#17' AND region = 'USA'", "attest")
def _(spark, sf):
    return profile.name_rows(standins.attestations(spark, sf), "red widget Brand#17", "USA")
