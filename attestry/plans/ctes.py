"""SQL subqueries that mirror the stand-in facts."""

from __future__ import annotations

from attestry.plans.registry import cte
from attestry.plans.standins import ETHNICITIES, FIRST_LANGUAGES, GENDER_TEXTS, GENDERS, LOCATIONS, REGIONS
from attestry.functions import vocab


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def case_of(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


def pick(values, index: str) -> str:
    return f"([{', '.join(text(v) for v in values)}])[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def title(column: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


_ITEM = """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {name} AS name,
       CASE WHEN l_returnflag = 'A' AND l_tax = 0.08 THEN 'X' WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS asab,
       {extra}, CAST(sum(l_quantity) AS BIGINT) AS number
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL"""
_REGION = case_of("r_name", REGIONS) + " AS region"
_FINE = "p_name || ' ' || p_brand"

cte("attest", _ITEM.format(name=_FINE, extra=_REGION))
cte("medium", _ITEM.format(name="p_name || ' ' || p_type", extra=_REGION))
cte("country", _ITEM.format(name=_FINE, extra="n_nationkey % 8 AS country, l_linenumber AS state"))
cte("reg", "SELECT year, name, asab, CAST(sum(number) AS BIGINT) AS number FROM attest GROUP BY ALL", "attest")
cte("births", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (WHERE o_orderstatus = 'O') AS male,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS female, count(*) AS total
FROM orders GROUP BY 1""")
cte("births_since", """
SELECT year, CASE WHEN year >= 1998 THEN male END AS male, CASE WHEN year >= 1998 THEN female END AS female, total
FROM births""", "births")
cte("facts", """
SELECT *, CAST(row_number() OVER (PARTITION BY region, year, asab ORDER BY number DESC, name) AS INTEGER) AS rank,
       number / sum(number) OVER (PARTITION BY region, year, asab) AS proportion
FROM attest""", "attest")
cte("wide", """
SELECT name, year, region, coalesce(max(number) FILTER (WHERE asab = 'F'), 0) AS f,
       coalesce(max(number) FILTER (WHERE asab = 'M'), 0) AS m, coalesce(max(number) FILTER (WHERE asab = 'X'), 0) AS x
FROM attest GROUP BY ALL""", "attest")
cte("cells", """
SELECT name, year, region, f AS afab, m AS amab, x, CASE WHEN f > 0 AND m > 0 THEN abs(ln(f / m)) END AS log_ratio
FROM wide""", "wide")
cte("combined", """
SELECT name, count(DISTINCT region) AS regions, count(DISTINCT year) AS years,
       CAST(sum(f) AS BIGINT) AS total_afab, CAST(sum(m) AS BIGINT) AS total_amab,
       CAST(sum(f) + sum(m) AS BIGINT) AS total_people,
       CASE WHEN sum(f) > 0 AND sum(m) > 0 THEN abs(ln(sum(f) / sum(m))) END AS log_ratio
FROM wide GROUP BY name""", "wide")


def profile(group: str = "name", scaled: bool = True, source: str = "cells") -> str:
    by_region = "/ regions" if scaled else ""
    mean2 = "" if scaled else ", abs(ln(mean_F / mean_M)) AS mean_logratio2"
    return f"""
SELECT * {mean2} FROM (
SELECT {group}, total_F, total_M, entries, regions, total_F / entries {by_region} AS mean_F,
       total_M / entries {by_region} AS mean_M, mean_logratio, median_logratio, sd_logratio,
       sd_logratio / sqrt(entries) AS se_logratio, max_logratio, min_logratio
FROM (SELECT {group}, CAST(sum(afab) AS BIGINT) AS total_F, CAST(sum(amab) AS BIGINT) AS total_M, count(*) AS entries,
             count(DISTINCT region) AS regions, avg(log_ratio) AS mean_logratio,
             quantile_cont(log_ratio, 0.5) AS median_logratio, stddev_samp(log_ratio) AS sd_logratio,
             max(log_ratio) AS max_logratio, min(log_ratio) AS min_logratio
      FROM {source} WHERE log_ratio IS NOT NULL GROUP BY {group}) AS s) AS p"""


cte("profile", profile(), "cells")
cte("profile_usa", profile(scaled=False, source="(SELECT * FROM cells WHERE region = 'USA')"), "cells")
cte("ranked", """
SELECT *, CAST(row_number() OVER (ORDER BY combined_order, order_common) AS INTEGER) AS rank_order FROM (
SELECT *, order_logratio + order_mean + order_common * 3 AS combined_order FROM (
SELECT *, CAST(row_number() OVER (ORDER BY weighted_frequency DESC, round(sd_logratio, 12) NULLS LAST, order_mean) AS INTEGER) AS order_common FROM (
SELECT *, CAST(row_number() OVER (ORDER BY round(mean_logratio, 12), round(median_logratio, 12), round(se_logratio, 12) NULLS LAST, weighted_frequency DESC, order_logratio) AS INTEGER) AS order_mean FROM (
SELECT *, CAST(row_number() OVER (ORDER BY round(min_logratio, 12), round(max_logratio, 12), round(sd_logratio, 12) NULLS LAST, weighted_frequency DESC,
                             mean_asab DESC, regions DESC, entries DESC, name) AS INTEGER) AS order_logratio FROM (
SELECT *, (mean_F + mean_M) / 2 AS mean_asab, (mean_F + mean_M) / 2 * (entries * regions) AS weighted_frequency
FROM profile))))) AS r""", "profile")


def ranked_single(source: str, last: str) -> str:
    return f"""
SELECT *, CAST(row_number() OVER (ORDER BY combined_order, round({last}, 12) NULLS LAST, order_common) AS INTEGER) AS rank_order FROM (
SELECT *, order_logratio + order_mean + order_common AS combined_order FROM (
SELECT *, CAST(row_number() OVER (ORDER BY weighted_frequency DESC, order_mean) AS INTEGER) AS order_common FROM (
SELECT *, CAST(row_number() OVER (ORDER BY round(mean_logratio, 12), round(median_logratio, 12), round(se_logratio, 12) NULLS LAST, order_logratio) AS INTEGER) AS order_mean FROM (
SELECT *, CAST(row_number() OVER (ORDER BY round(min_logratio, 12), round(max_logratio, 12), round(sd_logratio, 12) NULLS LAST, name) AS INTEGER) AS order_logratio FROM (
SELECT *, (mean_F + mean_M) / 2 AS mean_asab, (mean_F + mean_M) / 2 * (entries * 1) AS weighted_frequency
FROM {source}))))) AS r"""


cte("top", "SELECT name FROM ranked WHERE rank_order <= 300", "ranked")
cte("widefacts", """
SELECT name, year, region,
       max(number) FILTER (WHERE asab = 'F') AS number_F, max(number) FILTER (WHERE asab = 'M') AS number_M,
       max(proportion) FILTER (WHERE asab = 'F') AS proportion_F, max(proportion) FILTER (WHERE asab = 'M') AS proportion_M
FROM facts WHERE name IN (SELECT name FROM top) GROUP BY ALL""", "facts", "top")
cte("peaks", """
SELECT name, region, max(number_M) AS number_M, max(number_F) AS number_F FROM widefacts
WHERE proportion_F IS NOT NULL AND proportion_M IS NOT NULL GROUP BY ALL""", "widefacts")
cte("international", """
SELECT name, count(*) AS count, string_agg(region, '; ' ORDER BY region) AS countries FROM peaks
WHERE number_M / number_F >= 0.3 AND number_F / number_M >= 0.3 AND number_M > 20 AND number_F > 20 GROUP BY name""", "peaks")
cte("longevities", """
SELECT region, name, asab, attestations, count, total_years, total_count,
       attestations / total_years AS longstandingness, count / total_count AS percent
FROM (SELECT region, name, asab, count(*) AS attestations, CAST(sum(number) AS BIGINT) AS count FROM medium GROUP BY ALL) AS n
JOIN (SELECT region, count(DISTINCT year) AS total_years, CAST(sum(number) AS BIGINT) AS total_count FROM medium GROUP BY ALL) AS r
USING (region)""", "medium")

# --- surveys ----------------------------------------------------------------------
cte("answers", """
SELECT CAST(user_id AS VARCHAR) AS participant, CAST(user_id % 3 + 3 AS INTEGER) AS version, name, length(name) % 6 AS block,
       event_type, arg_max(value, event_id) AS value
FROM events JOIN (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part) AS p
     ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)
GROUP BY ALL""")


def rated(where: str, block: str) -> str:
    return f"""
SELECT participant, 'complete' AS status, version, 'Rating' AS task, name, {block} AS freq_block,
       max(value) FILTER (WHERE event_type = 'view') AS masc, max(value) FILTER (WHERE event_type = 'click') AS fem,
       max(value) FILTER (WHERE event_type = 'purchase') AS neut,
       CAST(max(value) FILTER (WHERE event_type = 'signup') AS VARCHAR) AS comment
FROM answers WHERE {where} GROUP BY ALL"""


cte("practice", rated("block <> 5 AND event_type <> 'error'", "CAST(NULL AS VARCHAR)"), "answers")
cte("ratings", rated("block <> 5", "CAST(block AS VARCHAR)"), "answers")
_YEAR = "(1930 + c_custkey * 7 % 75)"
cte("demographics", f"""
SELECT CAST(c_custkey AS VARCHAR) AS participant, 'complete' AS status, CAST(c_custkey % 3 + 3 AS INTEGER) AS version,
       lower({pick(GENDERS, 'c_custkey')}) AS gender_free, {pick(GENDERS, 'c_custkey')} AS gender_cat,
       {pick(['Female', 'Male'], 'c_custkey')} AS asb, c_mktsegment AS familiarity,
       {pick(LOCATIONS, 'c_custkey')} AS location_childhood, {pick(LOCATIONS, 'c_custkey + 1')} AS location_adulthood,
       {case_of('c_mktsegment', ETHNICITIES)} AS ethnicity, {pick(LOCATIONS[:-1], 'c_custkey + 3')} AS location_longest,
       {pick(LOCATIONS, 'c_nationkey')} AS location_influence, CAST({_YEAR} AS DOUBLE) AS birthyear,
       CAST({_YEAR} - 30 AS DOUBLE) AS parent1, CAST({_YEAR} - 28 AS DOUBLE) AS parent2, CAST({_YEAR} - 60 AS DOUBLE) AS gpar1,
       CAST({_YEAR} - 58 AS DOUBLE) AS gpar2, CAST({_YEAR} - 56 AS DOUBLE) AS gpar3, CAST({_YEAR} - 54 AS DOUBLE) AS gpar4,
       CASE WHEN c_custkey % 2 = 0 THEN CAST({_YEAR} + 30 AS DOUBLE) END AS child1, CAST(NULL AS DOUBLE) AS child2,
       CAST(NULL AS DOUBLE) AS gchild1, CAST(NULL AS DOUBLE) AS gchild2, c_name AS exp_comment
FROM customer""")
_PRACTICE_PART = rated("block = 0 AND event_type <> 'error'", "CAST(NULL AS VARCHAR)")
_RATING_PART = rated("block NOT IN (0, 5)", "CAST(block AS VARCHAR)")
cte("rating_data", f"""
SELECT * FROM ({_PRACTICE_PART} UNION ALL {_RATING_PART}) AS r LEFT JOIN demographics USING (participant, status, version)""",
    "answers", "demographics")
_PLACE = "CASE WHEN location_influence = '__other' THEN location_longest ELSE location_influence END"
cte("placed", f"""
SELECT *, {case_of('(' + _PLACE + ')', vocab.PARTICIPANT_AREAS)} AS area,
       CAST(round_even(birthyear, -1) AS INTEGER) AS decade FROM rating_data""", "rating_data")

# --- experiment -------------------------------------------------------------------
_TEXT = pick(GENDER_TEXTS, "c_custkey")
cte("gender", f"""
SELECT c_custkey AS participant, {_TEXT} AS gender_text, CAST(c_custkey % 101 AS DOUBLE) AS feminine,
       CAST(c_custkey * 3 % 101 AS DOUBLE) AS masculine,
       CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 7 % 101 AS DOUBLE) END AS agender,
       {case_of(_TEXT, vocab.GENDER_COARSE, "'other'")} AS gender_coarse,
       {case_of(_TEXT, vocab.GENDER_FINE, "'nonbinary'")} AS gender_fine
FROM customer""")
_L1 = case_of("c_mktsegment", FIRST_LANGUAGES)
cte("language", f"""
SELECT c_custkey AS participant, {pick(LOCATIONS, 'c_custkey')} AS loc_eng,
       CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 240 AS VARCHAR) END AS date_eng_acq,
       CASE WHEN {_L1} = 'English' THEN '~100%' ELSE CAST(c_custkey % 100 AS VARCHAR) || '%' END AS timeuse_eng, {_L1} AS l1
FROM customer""")
cte("trials", """
SELECT o_custkey AS participant, CAST(o_orderkey % 20 AS INTEGER) AS spreadsheet_row, CAST(o_orderkey AS VARCHAR) AS trial_number,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'fem- dive.jpg' WHEN '2-HIGH' THEN 'Masc- run.jpg' WHEN '3-MEDIUM' THEN 'Fem- read.jpg'
            WHEN '4-NOT SPECIFIED' THEN 'masc- cook.jpg' ELSE 'nb- swim.jpg' END AS image,
       CASE WHEN o_orderkey % 50 = 0 THEN 'PRONOUN...' WHEN o_orderstatus = 'F' THEN 'She' WHEN o_orderstatus = 'O' THEN 'He' ELSE 'They' END AS subject,
       o_orderpriority AS predicate
FROM orders""")
cte("practice_points", """
SELECT user_id AS participant, CAST(sum(CASE WHEN (k % 2 = 0 AND zone = 'buttonA' AND answer = 'Someone')
    OR (k % 2 = 0 AND zone = 'buttonB' AND answer = 'blew bubbles.') OR (k % 2 = 1 AND zone = 'buttonA' AND answer = 'They')
    OR (k % 2 = 1 AND zone = 'buttonB' AND answer = 'did their hair.') THEN 1 ELSE 0 END) AS BIGINT) AS practice_accuracy
FROM (SELECT user_id, event_type, k, CASE WHEN event_type IN ('click', 'purchase') THEN 'buttonA' ELSE 'buttonB' END AS zone,
             (['Someone', 'blew bubbles.', 'They', 'did their hair.'])[k % 4 + 1] AS answer
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) AS e
      WHERE event_type <> 'error' AND k % 9 <> 0) AS z
GROUP BY 1""")
cte("consent", """
SELECT c_custkey AS participant, c_mktsegment AS device_type, c_name AS device, 'Linux' AS os,
       (['Firefox', 'Chrome'])[CAST(c_custkey % 2 AS INTEGER) + 1] AS browser,
       CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS consent_form
FROM customer""")
cte("assembled", """
SELECT * FROM consent FULL JOIN practice_points USING (participant) FULL JOIN language USING (participant)
     FULL JOIN gender USING (participant) FULL JOIN trials USING (participant)""",
    "consent", "practice_points", "language", "gender", "trials")
cte("analysis", """
SELECT * REPLACE (CASE WHEN l1 = 'Both simultaneously' THEN 'Spanish' ELSE l1 END AS l1),
       lower(image)[1] AS image_gender,
       CASE lower(image)[1] WHEN 'f' THEN 'feminine' WHEN 'm' THEN 'masculine' ELSE 'nonbinary / other' END AS picture
FROM assembled WHERE subject <> 'PRONOUN...'""", "assembled")
