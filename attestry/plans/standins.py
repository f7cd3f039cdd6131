"""Canonical facts and raw register layouts derived from the driver's tables.

``attestations`` reads line items as births: the part is the name, the supplier's
region the register, the ship year the year. The layouts below turn such rows
into the shapes in which the registers and surveys are published.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.exprs import recode
from attestry.functions.vocab import DEMOGRAPHIC_FIELDS, GENDER_COARSE
from attestry.operators import clean
from attestry.session import materialize

REGIONS = {
    "AFRICA": "Australia",
    "AMERICA": "USA",
    "ASIA": "New Zealand",
    "EUROPE": "England and Wales",
    "MIDDLE EAST": "Northern Ireland",
}


@lru_cache(maxsize=None)
def _schema(path: str) -> T.StructType:
    """A table's schema, inferred by one job per path instead of one per query."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


# What makes a name: few names attested everywhere, or many with gaps.
NAME_COLUMNS = {"fine": ("p_name", "p_brand"), "medium": ("p_name", "p_type")}


def _births_of_items(spark: SparkSession, sf_dir: str, names: str = "fine") -> DataFrame:
    """One row per line item, with name, sex, year, place."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", *NAME_COLUMNS[names]).alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", recode(F.col("r_name"), REGIONS).alias("region"))
    other = (F.col("l_returnflag") == "A") & (F.col("l_tax") == 0.08)
    sex = F.when(other, "X").when(F.col("l_linestatus") == "F", "F").otherwise("M")
    rows = items.select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.year("l_shipdate").alias("year"), sex.alias("asab"),
    )
    # joined table by table and without hints: each lookup is broadcast if its files are
    # small, else both sides are shuffled and hot keys split
    return rows.join(parts, "l_partkey").join(suppliers, "l_suppkey").join(nations, "n_nationkey").join(regions, "r_regionkey")


def _number() -> Column:
    return F.sum("l_quantity").cast("bigint").alias("number")


def attestations(spark: SparkSession, sf_dir: str, names: str = "fine") -> DataFrame:
    """(year, name, asab, region, number)."""
    return _births_of_items(spark, sf_dir, names).groupBy("year", "name", "asab", "region").agg(_number())


def stored(spark: SparkSession, sf_dir: str, names: str = "fine") -> DataFrame:
    """The fact written once, for queries that read it several times."""
    return materialize(attestations(spark, sf_dir, names))


def names_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fact with rank and share inside (region, year, sex)."""
    keys = ["region", "year", "asab"]
    return clean.share_of_group(clean.rank_in_group(attestations(spark, sf_dir), keys), keys)


def with_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.share_of_group(stored(spark, sf_dir), ["region", "year", "asab"])


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, name, asab, number) over all places: one register holding everything."""
    return _births_of_items(spark, sf_dir).groupBy("year", "name", "asab").agg(_number())


def country_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country 0..7, state 1..7, year, name, asab, number): every nation belongs to one of eight registers."""
    rows = _births_of_items(spark, sf_dir).withColumns({
        "country": F.col("n_nationkey") % 8, "state": F.col("l_linenumber")})
    return rows.groupBy("country", "state", "year", "name", "asab").agg(_number())


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, male, female, total) from orders."""
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("male"),
        F.count_if(F.col("o_orderstatus") == "F").alias("female"),
        F.count("*").alias("total"),
    )


def births_by_sex_since(b: DataFrame, year: int = 1998) -> DataFrame:
    """Earlier years lack the split by sex."""
    known = F.col("year") >= year
    return b.select("year", F.when(known, F.col("male")).alias("male"),
                    F.when(known, F.col("female")).alias("female"), "total")


# --- register layouts -------------------------------------------------------------

def _labels(c: str, m: str, f: str, other: str) -> Column:
    return F.when(F.col(c) == "M", m).when(F.col(c) == "F", f).otherwise(other)


def two_sexes(rows: DataFrame, unit: tuple[str, ...] = ()) -> DataFrame:
    """Layouts that know two sexes count everyone who is not F as M."""
    two = rows.withColumn("asab", F.when(F.col("asab") == "F", "F").otherwise("M"))
    return two.groupBy(*unit, "year", "name", "asab").agg(F.sum("number").alias("number"))


def ranked(rows: DataFrame, unit: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the rank a register publishes; ``unit`` ranks many registers in one pass."""
    return clean.rank_in_group(rows, [*unit, "year", "asab"])


def canada_layout(ranked_rows: DataFrame, geo: str = "Canada") -> DataFrame:
    return clean.share_of_group(ranked_rows).select(
        F.col("year").alias("ref_date"), F.lit(geo).alias("geo"), _labels("asab", "Male", "Female", "Total").alias("sex_at_birth"),
        F.upper("name").alias("first_name_at_birth"),
        F.inline(F.array(
            F.struct(F.lit("Frequency").alias("indicator"), F.col("number").cast("double").alias("value")),
            F.struct(F.lit("Rank").alias("indicator"), F.col("rank").cast("double").alias("value")),
            F.struct(F.lit("Proportion (%)").alias("indicator"), (F.col("proportion") * 100).alias("value")),
        )),
    )


@lru_cache(maxsize=None)
def years(sf_dir: str) -> tuple[int, ...]:
    """All years of the line items: they head the columns of the published grids."""
    items = table(SparkSession.active(), sf_dir, "lineitem")
    found = items.select(F.year("l_shipdate").alias("year")).distinct().where("year IS NOT NULL").collect()
    return tuple(sorted(r["year"] for r in found))


def year_grid(ranked_two: DataFrame, sex: str, years: tuple[int, ...]) -> DataFrame:
    """``Name, 1995 Rank, 1995 Count, ...`` for one sex."""
    cells = []
    for y in years:
        here = F.col("year") == y
        cells.append(F.max(F.when(here, F.col("rank"))).alias(f"{y} Rank"))
        cells.append(F.max(F.when(here, F.col("number"))).alias(f"{y} Count"))
    return ranked_two.where(F.col("asab") == sex).groupBy(F.col("name").alias("Name")).agg(*cells)


def alternating_grid(ranked_two: DataFrame, sex: str, years: tuple[int, ...]) -> DataFrame:
    """``Rank, x1995...2, x1995...3, ...``: the list of one sex, all ranks of it."""
    cells, position = [], 2
    for y in years:
        here = F.col("year") == y
        for c in ("name", "number"):
            cells.append(F.max(F.when(here, F.col(c))).alias(f"x{y}...{position}"))
            position += 1
    return ranked_two.where(F.col("asab") == sex).groupBy("rank").agg(*cells)


def northern_ireland_layout(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("year").alias("year_of_registration"),
                       F.when(F.col("asab") == "M", 1).when(F.col("asab") == "F", 2).otherwise(3).alias("sex"),
                       F.col("name").alias("first_name"), F.col("number").alias("number_given_this_name"))


def northern_ireland_births(b: DataFrame) -> DataFrame:
    return b.select(F.col("year").cast("string").alias("year"), F.col("male").alias("males"), F.col("female").alias("females"))


def scotland_layout(ranked_rows: DataFrame) -> DataFrame:
    return ranked_rows.select(F.col("year").alias("yr"), _labels("asab", "B", "G", "U").alias("sex"),
                         F.col("name").alias("firstforename"), "number", "rank",
                         F.concat(F.col("rank").cast("string"), F.lit("=")).alias("position"))


def ireland_layout(ranked_two: DataFrame, sex: str) -> DataFrame:
    """Rank rows carry an R at character 50 (boys) or 51 (girls) of the label."""
    stem = "-" * (49 if sex == "M" else 50)
    return ranked_two.where(F.col("asab") == sex).select("year", F.col("name").alias("names"), F.inline(F.array(
        F.struct(F.lit(stem + "Rank").alias("statistic_label"), F.lit("Rank").alias("unit"),
                 F.col("rank").cast("double").alias("value")),
        F.struct(F.lit(stem + "Number").alias("statistic_label"), F.lit("Persons").alias("unit"),
                 F.col("number").cast("double").alias("value")),
    )))


def nsw_layout(ranked_rows: DataFrame) -> DataFrame:
    return ranked_rows.select("rank", "name", "number", _labels("asab", "Male", "Female", "Other").alias("gender"), "year")


def sex_pairs(ranked_two: DataFrame) -> DataFrame:
    """Girls and boys side by side by position in their list."""
    cells = []
    for sex, word in (("F", "girl"), ("M", "boy")):
        here = F.col("asab") == sex
        cells.append(F.max(F.when(here, F.col("name"))).alias(f"{word}_names"))
        cells.append(F.max(F.when(here, F.col("number"))).alias(f"count_of_{word}_names"))
    return ranked_two.groupBy("year", "rank").agg(*cells).drop("rank")


def queensland_history(rows: DataFrame) -> DataFrame:
    return rows.select("name", _labels("asab", "Male", "Female", "Other").alias("sex"), "year", F.col("number").alias("count"))


def south_australia_layout(two: DataFrame) -> DataFrame:
    """Two-sex lists with a TOTAL row per list, upper-case as published."""
    two = two.select("year", "asab", "name", "number")
    totals = two.groupBy("year", "asab").agg(F.lit("TOTAL").alias("name"), F.sum("number").alias("number"))
    both = two.unionByName(totals)
    return both.select(F.when(F.col("asab") == "F", "female").otherwise("male").alias("sex"), "year",
                       F.upper("name").alias("given_name"), F.col("number").alias("amount"), F.lit(1).alias("position"))


def tasmania_blocks(rows: DataFrame) -> dict[tuple[int, str], DataFrame]:
    """Two sheets: odd years are published as 2015, even years as 2016."""
    sheets = two_sexes(rows.withColumn("year", F.lit(2016) - F.col("year") % 2))
    return {
        (year, sex): sheets.where((F.col("year") == year) & (F.col("asab") == sex)).select("name", "number")
        for year in (2016, 2015) for sex in ("F", "M")
    }


def victoria_layout(ranked_rows: DataFrame) -> DataFrame:
    return ranked_rows.select(F.col("rank").alias("position"), "name",
                                            _labels("asab", "MALE", "FEMALE", "OTHER").alias("sex"), "year",
                                            F.col("number").alias("count"))


def official_births(b: DataFrame) -> DataFrame:
    """Long births table with measures and regions, years without sexes left out."""
    known = b.where(F.col("year") >= 1998)
    measures = F.inline(F.array(
        F.struct(F.lit("1: Births").alias("measure"), F.col("total").alias("population")),
        F.struct(F.lit("4: Male births").alias("measure"), F.col("male").alias("population")),
        F.struct(F.lit("5: Female births").alias("measure"), F.col("female").alias("population")),
    ))
    long = known.select("year", measures)
    return long.select("*", F.explode(F.array(F.lit("AUS: Australia"), F.lit("1: New South Wales"))).alias("region"))


# --- survey and experiment layouts --------------------------------------------------

LOCATIONS = ["Canada", "United States of America", "UK - England and Wales", "Ireland", "UK - Scotland", "Australia",
             "New Zealand", "__other"]
ETHNICITIES = {"AUTOMOBILE": "White", "BUILDING": "White and Jewish", "FURNITURE": "Ashkenazi Jewish",
               "HOUSEHOLD": "Mixed", "MACHINERY": "Asian American"}
GENDERS = ["Female", "Male", "Non binary"]
OBJECTS = {"view": "Masc Slider", "click": "Fem Slider", "purchase": "Neut slider", "signup": "Text Entry",
           "error": "Continue Button"}
GENDER_TEXTS = [*GENDER_COARSE, "something else"]


# People whose answers one task lays out: 25,000 take 84 MB to sort their demographic answers.
PEOPLE_PER_TASK = 25_000


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt to tasks of PEOPLE_PER_TASK.

    Their files are small, but a person becomes up to 42 rows that the same task sorts
    for its pivot; without this, its memory would follow the file.
    """
    people = table(spark, sf_dir, "customer")
    tasks = -(-people.count() // PEOPLE_PER_TASK)
    return people.repartition(tasks, *people.columns) if tasks > 1 else people


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def rating_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: the user rates the part named by ``props.k``; the last answer per object counts."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("p_partkey"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    answers = events.join(names, "p_partkey").groupBy("user_id", "name", "event_type").agg(
        F.max_by("value", "event_id").alias("value"))
    block = F.length("name") % 6
    return answers.select(
        F.col("user_id").cast("string").alias("participant_private_id"), F.lit("complete").alias("participant_status"),
        (F.col("user_id") % 3 + 3).cast("int").alias("version"), F.lit("Rating").alias("spreadsheet_display"),
        F.col("name").alias("spreadsheet_name"), block.cast("string").alias("spreadsheet_freq_block"),
        recode(F.col("event_type"), OBJECTS).alias("object_name"), F.col("value").cast("string").alias("response"),
        F.when(block != 5, "trial").alias("display"),
        F.when(F.col("event_type") == "error", "info").otherwise("response").alias("response_type"),
    )


def demographic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide answers per customer, all as text."""
    key = F.col("c_custkey")
    year = F.lit(1930) + key * 7 % 75
    answers = {
        "gender_free": F.lower(pick(GENDERS, key)), "gender_cat": pick(GENDERS, key), "asb": pick(["Female", "Male"], key),
        "familiarity": F.col("c_mktsegment"), "location_childhood": pick(LOCATIONS, key), "location_adulthood": pick(LOCATIONS, key + 1),
        "ethnicity": recode(F.col("c_mktsegment"), ETHNICITIES), "location_longest": pick(LOCATIONS[:-1], key + 3),
        "location_influence": pick(LOCATIONS, F.col("c_nationkey")), "birthyear": year,
        "parent1": year - 30, "parent2": year - 28, "gpar1": year - 60, "gpar2": year - 58, "gpar3": year - 56, "gpar4": year - 54,
        "child1": F.when(key % 2 == 0, (year + 30).cast("string")).otherwise("none"), "child2": F.lit(None),
        "gchild1": F.lit(None), "gchild2": F.lit(None), "exp_comment": F.col("c_name"),
    }
    return customers(spark, sf_dir).select(
        key.cast("string").alias("participant_private_id"), F.lit("complete").alias("participant_status"),
        (key % 3 + 3).cast("int").alias("version"), *[c.cast("string").alias(out) for out, c in answers.items()],
    )


def demographics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answer, plus the quantised copies that the export contains."""
    ids = ["participant_private_id", "participant_status", "version"]
    answers = F.inline(F.array(*[
        F.struct(F.lit(field).alias("object_name"), F.col(out).alias("response"))
        for field, out in DEMOGRAPHIC_FIELDS.items()
    ]))
    long = demographic_answers(spark, sf_dir).select(*ids, answers)
    return long.select("*", F.explode(F.array(F.lit("value"), F.lit("quantised"))).alias("key"))


def _questionnaire(people: DataFrame, answers: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Long questionnaire export with its begin, end and end-of-file rows."""
    rows = {"BEGIN QUESTIONNAIRE": F.lit("x"), **answers, "END QUESTIONNAIRE": F.lit("x")}
    structs = [F.struct(F.lit("1").alias("event_index"), F.lit(k).alias("question_key"), c.cast("string").alias("response"))
               for k, c in rows.items()]
    structs.append(F.struct(F.lit("END OF FILE").alias("event_index"), F.lit(None).cast("string").alias("question_key"),
                            F.lit(None).cast("string").alias("response")))
    return people.select(F.col("c_custkey").alias("participant_private_id"), *keep, F.inline(F.array(*structs)))


def consent_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir).withColumns({
        "participant_device_type": F.col("c_mktsegment"), "participant_device": F.col("c_name"),
        "participant_os": F.lit("Linux"), "participant_browser": pick(["Firefox", "Chrome"], F.col("c_custkey")),
    })
    keep = ("participant_device_type", "participant_device", "participant_os", "participant_browser")
    return _questionnaire(people, {"consent": F.when(F.col("c_acctbal") > 0, "1").otherwise("2")}, keep)


def gender_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _questionnaire(customers(spark, sf_dir), {
        "GenderText": pick(GENDER_TEXTS, key), "feminine": key % 101, "masculine": key * 3 % 101,
        "agender": F.when(key % 5 == 0, "n/a").otherwise((key * 7 % 101).cast("string")),
    })


FIRST_LANGUAGES = {"AUTOMOBILE": "English", "BUILDING": "Spanish", "FURNITURE": "Both simultaneously",
                   "HOUSEHOLD": "English", "MACHINERY": "Spanish"}


def language_exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First language, and the branch for English or for Spanish speakers; some dates are missing."""
    people = customers(spark, sf_dir).withColumn("l1", recode(F.col("c_mktsegment"), FIRST_LANGUAGES))
    key = F.col("c_custkey")
    place = pick(LOCATIONS, key)
    months = F.when(key % 4 != 0, key % 240)
    first = _questionnaire(people, {"L1": F.col("l1"), "L1-quantised": F.lit("1")})
    english = _questionnaire(people.where("l1 = 'English'"), {
        "LocL1Eng": place, "LocL1Eng-quantised": F.lit("1"), "DateL1Eng-inmonths": months})
    spanish = _questionnaire(people.where("l1 <> 'English'"), {
        "LocL2Eng": place, "LocL2Eng-quantised": F.lit("1"), "DateL2Eng-inmonths": months,
        "TimeuseEng": F.concat((key % 100).cast("string"), F.lit("%")), "TimeuseEng-quantised": F.lit("1")})
    return first, english, spanish


IMAGES = {"1-URGENT": "fem- dive.jpg", "2-HIGH": "Masc- run.jpg", "3-MEDIUM": "Fem- read.jpg", "4-NOT SPECIFIED": "masc- cook.jpg",
          "5-LOW": "nb- swim.jpg"}
SUBJECTS = {"F": "She", "O": "He", "P": "They"}


def trials_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a trial of its customer, with two answered zones and one display zone."""
    orders = table(spark, sf_dir, "orders")
    subject = F.when(F.col("o_orderkey") % 50 == 0, "PRONOUN...").otherwise(recode(F.col("o_orderstatus"), SUBJECTS))
    zones = F.inline(F.array(
        F.struct(F.lit("buttonB").alias("zone_name"), subject.alias("response")),
        F.struct(F.lit("buttonA").alias("zone_name"), F.col("o_orderpriority").alias("response")),
        F.struct(F.lit("Zone1").alias("zone_name"), F.lit(None).cast("string").alias("response")),
    ))
    return orders.select(
        F.col("o_custkey").alias("participant_private_id"), F.lit("1").alias("event_index"),
        (F.col("o_orderkey") % 20).cast("int").alias("spreadsheet_row"), F.col("o_orderkey").cast("string").alias("trial_number"),
        F.lit("trial").alias("display"), recode(F.col("o_orderpriority"), IMAGES).alias("image"), zones,
    )


PRACTICE_ZONES = {"click": "buttonA", "view": "buttonB", "purchase": "buttonA", "signup": "buttonB", "error": "Zone1"}
PRACTICE_ANSWERS = ["Someone", "blew bubbles.", "They", "did their hair."]


def practice_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a practice answer of its user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("participant_private_id"), F.lit("1").alias("event_index"),
        F.when(k % 2 == 0, 1).otherwise(3).alias("spreadsheet_row"), F.col("event_id").cast("string").alias("trial_number"),
        F.when(k % 9 == 0, "instruction").otherwise("trial").alias("display"),
        recode(F.col("event_type"), PRACTICE_ZONES).alias("zone_name"), pick(PRACTICE_ANSWERS, k).alias("response"),
    )
