"""Queries for reshaping, cleaning and the registers, over layouts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.exprs import title_case
from attestry.operators import clean, reshape
from attestry.plans import registers as reg
from attestry.plans import standins as st
from attestry.plans.ctes import title
from attestry.plans.registry import cte, query
from attestry.session import materialize


def _two(spark, sf):
    """The whole register as ranked two-sex lists."""
    return st.ranked(st.two_sexes(st.register_rows(spark, sf)))


# --- generic reshaping ------------------------------------------------------------

cte("two", """
SELECT year, name, CASE WHEN asab = 'F' THEN 'F' ELSE 'M' END AS asab, CAST(sum(number) AS BIGINT) AS number FROM reg GROUP BY ALL""", "reg")
cte("two_ranked", """
SELECT *, CAST(row_number() OVER (PARTITION BY year, asab ORDER BY number DESC, name) AS INTEGER) AS rank FROM two""", "two")


@query("unpivot_year_type", """
SELECT n.asab, n.name AS "Name", y.year, r.rank, r.number FROM (SELECT DISTINCT asab, name FROM two) AS n
CROSS JOIN (SELECT DISTINCT year FROM two) AS y LEFT JOIN two_ranked AS r ON r.name = n.name AND r.year = y.year AND r.asab = n.asab""", "two_ranked")
def _(spark, sf):
    lists = materialize(_two(spark, sf))
    rows = [
        reshape.unpivot_year_type(st.year_grid(lists, sex, st.years(sf)), ["Name"], {"Rank": ("rank", "int"), "Count": ("number", "bigint")})
        .withColumn("asab", F.lit(sex)) for sex in ("F", "M")]
    return rows[0].unionByName(rows[1])


@query("unpivot_alternating", """
SELECT k.asab, k.rank, y.year, r.name, CAST(r.number AS VARCHAR) AS number FROM (SELECT DISTINCT asab, rank FROM two_ranked) AS k
CROSS JOIN (SELECT DISTINCT year FROM two) AS y LEFT JOIN two_ranked AS r ON r.rank = k.rank AND r.year = y.year AND r.asab = k.asab""", "two_ranked")
def _(spark, sf):
    lists = materialize(_two(spark, sf))
    rows = [reshape.unpivot_alternating(st.alternating_grid(lists, sex, st.years(sf))).withColumn("asab", F.lit(sex)) for sex in ("F", "M")]
    return rows[0].unionByName(rows[1])


@query("unpivot_sex_pairs", """
SELECT p.year, s.asab, r.name, r.number FROM (SELECT DISTINCT year, rank FROM two_ranked) AS p CROSS JOIN (VALUES ('F'), ('M')) AS s(asab)
LEFT JOIN two_ranked AS r ON r.year = p.year AND r.rank = p.rank AND r.asab = s.asab""", "two_ranked")
def _(spark, sf):
    pairs = st.sex_pairs(_two(spark, sf)).withColumnsRenamed({
        "girl_names": "name_F", "count_of_girl_names": "number_F", "boy_names": "name_M", "count_of_boy_names": "number_M"})
    return reshape.unpivot_sex_pairs(pairs, ["year"])


@query("pivot_indicator", """
SELECT event_id, user_id, max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'click') AS click,
       max(value) FILTER (WHERE event_type = 'purchase') AS purchase, max(value) FILTER (WHERE event_type = 'signup') AS signup,
       max(value) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY event_id, user_id""")
def _(spark, sf):
    events = st.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return reshape.pivot_indicator(events, ["event_id", "user_id"], "event_type", "value", {k: k for k in st.OBJECTS})


@query("pivot_conversations", """
SELECT conv_id, turn, max(text) FILTER (WHERE role = 'system') AS system,
       max(text) FILTER (WHERE role = 'user') AS "user", max(text) FILTER (WHERE role = 'assistant') AS assistant
FROM conversations GROUP BY conv_id, turn""")
def _(spark, sf):
    turns = st.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return reshape.pivot_values(turns, ["conv_id", "turn"], "role", "text",
                                {"system": "system", "user": "user", "assistant": "assistant"}, F.max)


@query("recode_column", """
SELECT o_orderpriority, code, count(*) AS n FROM (
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'M' WHEN '2-HIGH' THEN 'F' ELSE 'X' END AS code FROM orders) AS o GROUP BY ALL""")
def _(spark, sf):
    orders = st.table(spark, sf, "orders").select("o_orderpriority")
    coded = clean.recode_column(orders, "o_orderpriority", {"1-URGENT": "M", "2-HIGH": "F"}, out="code")
    return coded.groupBy("o_orderpriority", "code").agg(F.count("*").alias("n"))


# the full case mapping titles a leading sharp s as two letters, which upper() here does not
@query("normalize_name", """
SELECT CASE token[1] WHEN 'ß' THEN 'Ss' ELSE upper(token[1]) END || lower(token[2:]) AS name, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS token FROM documents) AS t GROUP BY 1""")
def _(spark, sf):
    words = st.table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("name"))
    # equal spellings are counted before the costly case mapping
    spellings = words.groupBy("name").agg(F.count("*").alias("n"))
    return clean.normalize_name(spellings).groupBy("name").agg(F.sum("n").alias("n"))


@query("collapse_duplicates", f"""
SELECT year, name, asab, CASE WHEN count(*) = count(number) THEN CAST(sum(number) AS BIGINT) END AS number FROM (
SELECT year, {title("split_part(name, ' Brand', 1)")} AS name, asab, nullif(number, 7) AS number FROM attest) AS a GROUP BY ALL""", "attest")
def _(spark, sf):
    rows = st.attestations(spark, sf).select(
        "year", F.split_part("name", F.lit(" Brand"), F.lit(1)).alias("name"), "asab",
        F.nullif(F.col("number"), F.lit(7)).alias("number"))
    return clean.collapse_duplicates(clean.normalize_name(rows))


@query("share_of_group", """
SELECT *, number / sum(number) OVER (PARTITION BY region, year, asab) AS proportion FROM attest""", "attest")
def _(spark, sf):
    return clean.share_of_group(st.attestations(spark, sf), ["region", "year", "asab"])


_BY_SEX = "number / CASE asab WHEN 'M' THEN nullif(male, 0) WHEN 'F' THEN nullif(female, 0) END"


@query("share_of_population", f"SELECT reg.*, {_BY_SEX} AS proportion FROM reg LEFT JOIN births USING (year)", "reg births")
def _(spark, sf):
    return clean.share_of_population(st.register_rows(spark, sf), st.births(spark, sf))


_FALLBACK = f"""CASE WHEN male IS NULL OR female IS NULL THEN number / sum(number) OVER (PARTITION BY year, asab) ELSE {_BY_SEX} END"""


@query("share_with_group_fallback", f"SELECT reg.*, {_FALLBACK} AS proportion FROM reg LEFT JOIN births_since USING (year)",
       "reg births_since")
def _(spark, sf):
    return clean.share_with_group_fallback(st.register_rows(spark, sf), st.births_by_sex_since(st.births(spark, sf)))


@query("share_with_total_fallback", f"""
SELECT reg.*, coalesce({_BY_SEX}, number / (total * 0.5)) AS proportion FROM reg LEFT JOIN births_since USING (year)""",
       "reg births_since")
def _(spark, sf):
    b = st.births(spark, sf)
    shared = clean.share_of_population(st.register_rows(spark, sf), st.births_by_sex_since(b))
    return clean.share_with_total_fallback(shared, b.select("year", F.col("total").alias("population")))


@query("rank_first", "SELECT year, name, asab, region, number, rank FROM facts", "facts")
def _(spark, sf):
    return clean.rank_in_group(st.attestations(spark, sf), ["region", "year", "asab"])


@query("rank_average", """
SELECT *, CAST(floor(rank() OVER w + (count(*) OVER (PARTITION BY region, year, asab, number) - 1) / 2) AS INTEGER) AS rank
FROM attest WINDOW w AS (PARTITION BY region, year, asab ORDER BY number DESC)""", "attest")
def _(spark, sf):
    return clean.rank_in_group(st.attestations(spark, sf), ["region", "year", "asab"], ties="average")


@query("rank_random", """
SELECT *, CAST(row_number() OVER (PARTITION BY region, year, asab ORDER BY number DESC, md5(name || '231'), name) AS INTEGER) AS rank
FROM attest""", "attest")
def _(spark, sf):
    return clean.rank_in_group(st.attestations(spark, sf), ["region", "year", "asab"], ties="random", seed=231)


@query("drop_rows", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'""")
def _(spark, sf):
    orders = st.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return clean.drop_rows(orders, [F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"])


@query("assert_unique", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) <> 1")
def _(spark, sf):
    return clean.assert_unique(st.table(spark, sf, "events"), ["user_id", "event_type"])


@query("remap_births", "SELECT year, male, female FROM births WHERE year >= 1998", "births")
def _(spark, sf):
    return clean.remap_births(st.official_births(st.births(spark, sf)))


# --- registers ----------------------------------------------------------------------
# Every SQL text takes its rows (year, name, asab, number) from ``src``.

_T = title("name")
_SHARE = "number / sum(number) OVER (PARTITION BY year, asab)"
_RANK = "CAST(row_number() OVER (PARTITION BY year, asab ORDER BY number DESC, name) AS INTEGER)"
_TWO = "(SELECT year, name, CASE WHEN asab = 'F' THEN 'F' ELSE 'M' END AS asab, CAST(sum(number) AS BIGINT) AS number FROM src GROUP BY ALL)"


def _columns(region: str, rank: str = _RANK, proportion: str = _SHARE, name: str = _T) -> str:
    return f"year, {name} AS name, number, {rank} AS rank, asab, '{region}' AS region, {proportion} AS proportion"


USA = f"SELECT {_columns('USA', proportion=_BY_SEX)} FROM src LEFT JOIN births USING (year)"
CANADA = f"SELECT {_columns('Canada', proportion='(' + _SHARE + ') * 100 / 100')} FROM src"
ENGLAND_WALES = f"SELECT {_columns('England and Wales')} FROM {_TWO} AS t"
NORTHERN_IRELAND = f"SELECT {_columns('Northern Ireland', proportion=_BY_SEX)} FROM src LEFT JOIN births USING (year)"
SCOTLAND = f"SELECT {_columns('Scotland')} FROM src"
IRELAND = f"SELECT {_columns('Ireland')} FROM {_TWO} AS t"


def new_zealand(condition: str) -> str:
    return f"""SELECT * FROM (SELECT {_columns('New Zealand', rank='rank', proportion=_FALLBACK)}
FROM (SELECT *, {_RANK} AS rank FROM {_TWO} AS t) AS r LEFT JOIN births_since USING (year)) AS z WHERE {condition}"""


_ARTIFACT = (1998, 100, "Red Ring Brand#1")
NEW_ZEALAND = new_zealand("year <> 1998 AND rank <> 100 AND name <> 'Red Ring Brand#1'")
# states: rows after each register's own rules, before they are added up
STATES = {
    "nsw": f"SELECT year, {_T} AS name, asab, number, {_RANK} AS rank FROM src",
    "nt": f"SELECT year, {_T} AS name, asab, number, {_RANK} AS rank FROM src",
    "qld": f"""SELECT year, {_T} AS name, asab, number, {_RANK} AS rank FROM {_TWO} AS t WHERE year >= 1998 UNION ALL
SELECT year, {_T} AS name, asab, number, CAST(floor(rank() OVER (PARTITION BY year, asab ORDER BY number DESC)
       + (count(*) OVER (PARTITION BY year, asab, number) - 1) / 2) AS INTEGER) AS rank FROM src WHERE year < 1998""",
    # the total leads its list and is dropped after ranking
    "sa": f"""SELECT year, {_T} AS name, asab, number, rank FROM (SELECT *, {_RANK} AS rank FROM (
SELECT * FROM {_TWO} AS t UNION ALL SELECT year, 'Total' AS name, asab, CAST(sum(number) AS BIGINT) AS number FROM {_TWO} AS t GROUP BY year, asab) AS u) AS s
WHERE name <> 'Total'""",
    "tas": f"""SELECT CAST(year AS INTEGER) AS year, {_T} AS name, asab, number, CASE WHEN year = 2016 THEN {_RANK}
       ELSE CAST(floor(rank() OVER (PARTITION BY year, asab ORDER BY number DESC) + (count(*) OVER (PARTITION BY year, asab, number) - 1) / 2) AS INTEGER) END AS rank
FROM (SELECT 2016 - year % 2 AS year, name, CASE WHEN asab = 'F' THEN 'F' ELSE 'M' END AS asab, CAST(sum(number) AS BIGINT) AS number FROM src GROUP BY ALL) AS t""",
    "vic": f"SELECT year, {_T} AS name, asab, number, {_RANK} AS rank FROM src",
    "wa": f"SELECT year, {_T} AS name, asab, number, {_RANK} AS rank FROM src",
}
STATE_NAMES = {"nsw": "New South Wales", "nt": "Northern Territory", "qld": "Queensland", "sa": "South Australia",
               "tas": "Tasmania", "vic": "Victoria", "wa": "Western Australia"}


def _from(text: str, source: str) -> str:
    return text.replace(" src", f" {source}")


def australia(source: str) -> str:
    states = " UNION ALL ".join(
        f"SELECT name, asab, year, number FROM ({_from(q, f'(SELECT year, name, asab, CAST(sum(number) AS BIGINT) AS number FROM {source} WHERE state = {i} GROUP BY ALL) AS s')}) AS state{i}"
        for i, q in enumerate(STATES.values(), 1))
    pooled = f"(SELECT name, asab, year, CAST(sum(number) AS BIGINT) AS number FROM ({states}) AS u GROUP BY ALL)"
    share = f"coalesce({_BY_SEX}, number / (total * 0.5))"
    return f"SELECT {_columns('Australia', proportion=share, name='name')} FROM {pooled} AS p LEFT JOIN births_since USING (year)"


class Rows:
    """One register's rows in the forms the layouts start from, each made when first asked for."""

    def __init__(self, rows, years, ranked=None, ranked_two=None):
        self.rows, self.years = rows, years
        self._ranked, self._two = ranked, ranked_two

    @property
    def ranked(self):
        if self._ranked is None:
            self._ranked = st.ranked(self.rows)
        return self._ranked

    @property
    def two(self):
        if self._two is None:
            self._two = st.ranked(st.two_sexes(self.rows))
        return self._two


def split_by(rows, unit: str, years) -> dict[int, Rows]:
    """The registers of every ``unit`` value, ranked together instead of one by one."""
    # a folder for each unit, so that its register reads no other's rows
    summed = materialize(rows.groupBy(unit, "year", "name", "asab").agg(F.sum("number").alias("number")), "registers", [unit])
    three = materialize(st.ranked(summed, (unit,)), "registers", [unit])
    two = materialize(st.ranked(st.two_sexes(summed, (unit,)), (unit,)), "registers", [unit])

    def part(df, i):
        return df.where(F.col(unit) == i).drop(unit)

    return {i: Rows(part(summed, i), years, part(three, i), part(two, i)) for i in range(8)}


def usa_of(r: Rows, b):
    return reg.names_usa(r.rows.select("name", "asab", "number", "year"), b)


def canada_of(r: Rows):
    return reg.names_canada(st.canada_layout(r.ranked))


def england_wales_of(r: Rows):
    return reg.names_england_wales(st.year_grid(r.two, "M", r.years), st.year_grid(r.two, "F", r.years))


def northern_ireland_of(rows, b):
    return reg.names_northern_ireland(st.northern_ireland_layout(rows), st.northern_ireland_births(b))


def scotland_of(r: Rows):
    return reg.names_scotland(st.scotland_layout(r.ranked))


def ireland_of(r: Rows):
    return reg.names_ireland(st.ireland_layout(r.two, "M"), st.ireland_layout(r.two, "F"))


def new_zealand_of(r: Rows, b, mode="reference"):
    grids = [st.alternating_grid(r.two, sex, r.years) for sex in ("M", "F")]
    return reg.names_new_zealand(*grids, st.births_by_sex_since(b), mode, _ARTIFACT)


def queensland_of(r: Rows):
    pairs = st.sex_pairs(r.two.where(F.col("year") >= 1998))
    return reg.names_queensland(pairs, st.queensland_history(r.rows.where(F.col("year") < 1998)))


STATE_BUILDERS = {
    "nsw": lambda r: reg.names_nsw(st.nsw_layout(r.ranked)),
    "nt": lambda r: reg.names_northern_territory(r.rows),
    "qld": queensland_of,
    "sa": lambda r: reg.names_south_australia(st.south_australia_layout(r.two)),
    "tas": lambda r: reg.names_tasmania(st.tasmania_blocks(r.rows)),
    "vic": lambda r: reg.names_victoria(st.victoria_layout(r.ranked)),
    "wa": lambda r: reg.names_western_australia(r.ranked),
}


def australia_of(rows, b, years):
    units = split_by(rows, "state", years)
    states = [build(units[i]) for i, build in enumerate(STATE_BUILDERS.values(), 1)]
    by_sex = clean.remap_births(st.official_births(b))
    return reg.names_australia(states, by_sex, b.select("year", F.col("total").alias("population")))


def _whole(spark, sf) -> Rows:
    return Rows(st.register_rows(spark, sf), st.years(sf))


def _register(name: str, sql: str, uses: str, build) -> None:
    query(name, _from(sql, "reg"), f"reg {uses}".strip())(build)


_register("names_usa", USA, "births", lambda s, sf: usa_of(_whole(s, sf), st.births(s, sf)))
_register("names_canada", CANADA, "", lambda s, sf: canada_of(_whole(s, sf)))
_register("names_england_wales", ENGLAND_WALES, "", lambda s, sf: england_wales_of(_whole(s, sf)))
# one row per place, so the same name is there several times a year
_register("names_northern_ireland", NORTHERN_IRELAND, "births",
          lambda s, sf: northern_ireland_of(st.attestations(s, sf).drop("region"), st.births(s, sf)))
_register("names_scotland", SCOTLAND, "", lambda s, sf: scotland_of(_whole(s, sf)))
_register("names_ireland", IRELAND, "", lambda s, sf: ireland_of(_whole(s, sf)))
_register("names_new_zealand", NEW_ZEALAND, "births_since", lambda s, sf: new_zealand_of(_whole(s, sf), st.births(s, sf)))
_register("names_new_zealand_intended", new_zealand("NOT (year = 1998 AND rank = 100 AND name = 'Red Ring Brand#1')"), "births_since",
          lambda s, sf: new_zealand_of(_whole(s, sf), st.births(s, sf), "intended"))

_STATE_QUERIES = {"nsw": "names_nsw", "nt": "names_northern_territory", "qld": "names_queensland", "sa": "names_south_australia",
                  "tas": "names_tasmania", "vic": "names_victoria", "wa": "names_western_australia"}
for _key, _name in _STATE_QUERIES.items():
    _sql = f"SELECT year, name, number, rank, asab, '{STATE_NAMES[_key]}' AS region FROM ({_from(STATES[_key], 'reg')}) AS state"
    query(_name, _sql, "reg")(lambda s, sf, k=_key: STATE_BUILDERS[k](_whole(s, sf)))


@query("names_australia", australia("country"), "country births_since")
def _(spark, sf):
    # seven branches read these rows
    return australia_of(materialize(st.country_rows(spark, sf)), materialize(st.births(spark, sf)), st.years(sf))


_COUNTRIES = [("australia", None), ("canada", CANADA), ("england_wales", ENGLAND_WALES), ("ireland", IRELAND),
              ("northern_ireland", NORTHERN_IRELAND), ("new_zealand", NEW_ZEALAND), ("scotland", SCOTLAND), ("usa", USA)]
_UNION = " UNION ALL ".join(
    f"SELECT * FROM ({australia('(SELECT * FROM country WHERE country = 0) AS c') if sql is None else _from(sql, f'(SELECT year, name, asab, CAST(sum(number) AS BIGINT) AS number FROM country WHERE country = {i} GROUP BY ALL) AS c')}) AS r{i}"
    for i, (_, sql) in enumerate(_COUNTRIES))


@query("names_combined", _UNION, "country births births_since")
def _(spark, sf):
    places, b = materialize(st.country_rows(spark, sf)), materialize(st.births(spark, sf))

    country = split_by(places, "country", st.years(sf))
    return reg.names_combined([
        australia_of(places.where(F.col("country") == 0), b, st.years(sf)), canada_of(country[1]), england_wales_of(country[2]),
        ireland_of(country[3]), northern_ireland_of(country[4].rows, b), new_zealand_of(country[5], b),
        scotland_of(country[6]), usa_of(country[7], b),
    ])


@query("title_case_punctuation", """
SELECT p_name, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || '-' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]
       AS hyphenated, '(' || upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) AS opened FROM (SELECT DISTINCT p_name FROM part) AS p""")
def _(spark, sf):
    names = st.table(spark, sf, "part").select("p_name").distinct()
    return names.select(
        "p_name", title_case(F.translate(F.upper("p_name"), " ", "-")).alias("hyphenated"),
        title_case(F.concat(F.lit("("), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))).alias("opened"))
