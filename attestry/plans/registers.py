"""The national registers as configurations of the generic operators.

Every function takes the register's tables as read (snake-case columns) and
returns the canonical fact: year, name, number, rank, asab, region, proportion.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.exprs import title_case
from attestry.operators import clean
from attestry.operators.reshape import (
    label_by_character, pivot_indicator, unpivot_alternating, unpivot_sex_pairs, unpivot_year_type,
)

CANONICAL = {
    "year": "int", "name": "string", "number": "bigint", "rank": "int", "asab": "string", "region": "string",
    "proportion": "double",
}

# Sex labels of the registers; anything else is X.
SEX_WORDS = {"Male": "M", "Female": "F"}
SEX_CAPITALS = {"MALE": "M", "FEMALE": "F"}
SEX_LOWER = {"male": "M", "female": "F"}
SEX_CODES = {"1": "M", "2": "F"}
SEX_CHILD = {"B": "M", "G": "F"}
# Entries of the South Australian files that are not names.
NOT_NAMES = ["TOTAL", "Total", "(Not"]


def canonical(df: DataFrame, region: str | None = None) -> DataFrame:
    if region is not None:
        df = df.withColumn("region", F.lit(region))
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in CANONICAL.items()])


def _state(df: DataFrame, region: str) -> DataFrame:
    """A state register has no share of its own."""
    return canonical(df.withColumn("proportion", F.lit(None)), region).drop("proportion")


def names_usa(year_files: DataFrame, births: DataFrame) -> DataFrame:
    """(name, asab, number, year) files with births by sex; ties keep the files' name order."""
    ranked = clean.rank_in_group(year_files)
    return canonical(clean.normalize_name(clean.share_of_population(ranked, births)), "USA")


def names_canada(table: DataFrame) -> DataFrame:
    """Indicator rows; the published proportion is a percentage."""
    ids = ["ref_date", "geo", "sex_at_birth", "first_name_at_birth"]
    wide = pivot_indicator(table, ids, "indicator", "value",
                           {"Frequency": "number", "Rank": "rank", "Proportion (%)": "percent"})
    recoded = clean.recode_column(wide, "sex_at_birth", SEX_WORDS, "X", "asab")
    return canonical(recoded.select(
        F.col("ref_date").alias("year"), F.col("geo").alias("region"), "asab", "number", "rank",
        title_case(F.col("first_name_at_birth")).alias("name"), (F.col("percent") / 100).alias("proportion"),
    ))


def names_england_wales(boys: DataFrame, girls: DataFrame) -> DataFrame:
    """Two grids of ``<year> Rank`` and ``<year> Count`` columns."""
    types = {"Rank": ("rank", "int"), "Count": ("number", "bigint")}
    long = [
        unpivot_year_type(grid, ["Name"], types).withColumn("asab", F.lit(sex))
        for grid, sex in ((boys, "M"), (girls, "F"))
    ]
    rows = reduce(DataFrame.unionByName, long).withColumnRenamed("Name", "name").where(F.col("number").isNotNull())
    return canonical(clean.normalize_name(clean.share_of_group(rows)), "England and Wales")


def names_northern_ireland(table: DataFrame, births: DataFrame) -> DataFrame:
    """Duplicate spellings are added up before ranking; note rows in the births table have no girls."""
    rows = table.select(
        F.col("year_of_registration").cast("int").alias("year"), F.col("sex").alias("asab"),
        F.col("first_name").alias("name"), F.col("number_given_this_name").alias("number"),
    )
    summed = clean.collapse_duplicates(clean.normalize_name(clean.recode_column(rows, "asab", SEX_CODES)))
    years = births.where(F.col("females").isNotNull()).withColumn("year", F.col("year").try_cast("int"))
    shared = clean.share_of_population(summed, years, male="males", female="females")
    return canonical(clean.rank_in_group(shared), "Northern Ireland")


def names_scotland(table: DataFrame) -> DataFrame:
    """The file's own rank is kept; its textual position is not."""
    rows = table.drop("position").withColumnsRenamed({"yr": "year", "sex": "asab", "firstforename": "name"})
    named = clean.normalize_name(clean.recode_column(rows, "asab", SEX_CHILD))
    return canonical(clean.share_of_group(named), "Scotland")


def names_ireland(boys: DataFrame, girls: DataFrame) -> DataFrame:
    """One character of the long statistic label tells rank rows from count rows."""
    parts = []
    for table, sex, position in ((boys, "M", 50), (girls, "F", 51)):
        # the unit differs between the statistics and must not split the pivot
        wide = pivot_indicator(table.drop("unit"), ["year", "names"], "statistic_label", "value",
                               {"rank": "rank", "number": "number"},
                               label_by_character(position, "R", "rank", "number"))
        parts.append(wide.withColumn("asab", F.lit(sex)))
    rows = reduce(DataFrame.unionByName, parts).withColumnRenamed("names", "name").where(F.col("number").isNotNull())
    return canonical(clean.share_of_group(clean.normalize_name(rows)), "Ireland")


def names_new_zealand(boys: DataFrame, girls: DataFrame, births: DataFrame, mode: str = "reference",
                      artifact: tuple[int, int, str] = (1988, 100, "Michael")) -> DataFrame:
    """Grids of top lists with alternating name and count columns; cells without a name are no rows.

    One record appears twice. ``mode="reference"`` removes everything that shares
    its year, its rank or its name, as published; ``mode="intended"`` removes the
    record alone.
    """
    parts = [unpivot_alternating(grid).withColumn("asab", F.lit(sex)) for grid, sex in ((boys, "M"), (girls, "F"))]
    rows = clean.normalize_name(reduce(DataFrame.unionByName, parts).where(F.col("name").isNotNull())).withColumn(
        "number", F.col("number").try_cast("double"))
    shared = clean.share_with_group_fallback(rows, births)
    year, rank, name = artifact
    same = [F.col("year") == year, F.col("rank") == rank, F.col("name") == name]
    if mode == "reference":
        # plain inequalities also drop rows in which one of the three is unknown
        kept = shared.where(~same[0] & ~same[1] & ~same[2])
    else:
        kept = clean.drop_rows(shared, [same[0] & same[1] & same[2]])
    return canonical(kept, "New Zealand")


def names_nsw(table: DataFrame) -> DataFrame:
    return _state(clean.normalize_name(clean.recode_column(table, "gender", SEX_WORDS, "X", "asab")), "New South Wales")


def names_northern_territory(table: DataFrame) -> DataFrame:
    return _state(clean.normalize_name(clean.rank_in_group(table)), "Northern Territory")


def names_queensland(yearly: DataFrame, history: DataFrame) -> DataFrame:
    """Yearly files pair girls and boys on one row; the long history shares ranks among ties."""
    pairs = yearly.withColumnsRenamed({
        "girl_names": "name_F", "count_of_girl_names": "number_F", "boy_names": "name_M", "count_of_boy_names": "number_M",
    })
    recent = clean.rank_in_group(unpivot_sex_pairs(pairs, ["year"])).where(F.col("name").isNotNull())
    older = history.select("year", clean.recode(F.col("sex"), SEX_WORDS, "X").alias("asab"),
                           title_case(F.col("name")).alias("name"), F.col("count").alias("number"))
    older = clean.rank_in_group(older, ties="average")
    columns = ["year", "asab", "name", "number", "rank"]
    both = recent.select(*columns).unionByName(older.select(*columns))
    return _state(clean.normalize_name(both), "Queensland")


def names_south_australia(table: DataFrame) -> DataFrame:
    """(sex, year, given_name, amount, position); ranks are taken before artifact rows go."""
    rows = table.select(
        F.col("sex").alias("asab"), F.col("year").cast("int").alias("year"),
        title_case(F.col("given_name")).alias("name"), F.col("amount").alias("number"),
    )
    ranked = clean.recode_column(clean.rank_in_group(rows), "asab", SEX_LOWER)
    return _state(clean.drop_rows(ranked, [F.col("name").isin(NOT_NAMES)]), "South Australia")


def names_tasmania(blocks: Mapping[tuple[int, str], DataFrame], shared_rank_years: tuple[int, ...] = (2015,)) -> DataFrame:
    """Two-column sheet blocks per (year, sex); older sheets share ranks among ties."""
    parts = [b.select("name", "number", F.lit(year).alias("year"), F.lit(sex).alias("asab"))
             for (year, sex), b in blocks.items()]
    rows = clean.normalize_name(reduce(DataFrame.unionByName, parts))
    shared = F.col("year").isin(*shared_rank_years)
    columns = ["year", "asab", "name", "number", "rank"]
    ranked = (
        clean.rank_in_group(rows.where(~shared)).select(*columns)
        .unionByName(clean.rank_in_group(rows.where(shared), ties="average").select(*columns))
    )
    return _state(ranked, "Tasmania")


def names_victoria(table: DataFrame) -> DataFrame:
    renamed = table.withColumnsRenamed({"position": "rank", "count": "number"})
    return _state(clean.normalize_name(clean.recode_column(renamed, "sex", SEX_CAPITALS, "X", "asab")), "Victoria")


def names_western_australia(table: DataFrame) -> DataFrame:
    return _state(clean.normalize_name(table), "Western Australia")


def names_australia(states: list[DataFrame], births: DataFrame, total_births: DataFrame) -> DataFrame:
    """States added up per (name, sex, year), ranked, with shares of births by sex or of half of all births."""
    pooled = clean.collapse_duplicates(reduce(DataFrame.unionByName, states), ["name", "asab", "year"])
    ranked = clean.rank_in_group(clean.share_of_population(pooled, births))
    return canonical(clean.share_with_total_fallback(ranked, total_births), "Australia")


def names_combined(registers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, registers)
