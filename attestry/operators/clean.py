"""Harmonising registers: recodes, duplicates, shares and ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.exprs import (
    join_dimension, ratio, recode, sum_strict, title_case,
)
from attestry.operators import ranking



def recode_column(df: DataFrame, column: str, mapping: Mapping[str, str], default: str = "X",
                  out: str | None = None) -> DataFrame:
    """Replace exact values; anything unknown, NULL included, becomes ``default``."""
    return df.withColumn(out or column, recode(F.col(column).cast("string"), mapping, default))


def normalize_name(df: DataFrame, column: str = "name") -> DataFrame:
    return df.withColumn(column, title_case(F.col(column)))


def collapse_duplicates(df: DataFrame, keys: Sequence[str] = ("year", "name", "asab"),
                        measure: str = "number") -> DataFrame:
    """Add up rows that share a key; an unknown count makes the sum unknown."""
    return df.groupBy(*keys).agg(sum_strict(F.col(measure)).alias(measure))


def share_of_group(df: DataFrame, keys: Sequence[str] = ("year", "asab"), measure: str = "number",
                   out: str = "proportion") -> DataFrame:
    """``measure`` over its group total, NULLs left out of the total.

    Totals are aggregated with map-side combine, stored and joined back: a window
    would put a whole (year, sex) group into one task, and so would a shuffle of
    the rows on these keys. Small totals are broadcast.
    """
    totals = df.groupBy(*keys).agg(F.sum(measure).alias("__total"))
    joined = join_dimension(df, totals, list(keys), null_safe=True)
    return joined.withColumn(out, ratio(F.col(measure), F.col("__total"))).drop("__total")


def _births_of_sex(sex: str, male: str, female: str) -> Column:
    return F.when(F.col(sex) == "M", F.col(male)).when(F.col(sex) == "F", F.col(female))


def share_of_population(df: DataFrame, births: DataFrame, on: str | list[str] = "year", male: str = "male",
                        female: str = "female", measure: str = "number", sex: str = "asab",
                        out: str = "proportion") -> DataFrame:
    """``measure`` over the births of that sex and year; other sexes get NULL."""
    dims = births.select(*([on] if isinstance(on, str) else on), F.col(male).alias("__m"), F.col(female).alias("__f"))
    joined = join_dimension(df, dims, on)
    return joined.withColumn(out, ratio(F.col(measure), _births_of_sex(sex, "__m", "__f"))).drop("__m", "__f")


def share_with_group_fallback(df: DataFrame, births: DataFrame, keys: Sequence[str] = ("year", "asab"),
                              measure: str = "number", sex: str = "asab", out: str = "proportion") -> DataFrame:
    """Share of births, or of the listed names where either sex's births are unknown."""
    dims = births.select("year", F.col("male").alias("__m"), F.col("female").alias("__f"))
    joined = join_dimension(share_of_group(df, keys, measure, "__listed"), dims, "year")
    unknown = F.col("__m").isNull() | F.col("__f").isNull()
    by_births = ratio(F.col(measure), _births_of_sex(sex, "__m", "__f"))
    share = F.when(unknown, F.col("__listed")).otherwise(by_births)
    return joined.withColumn(out, share).drop("__m", "__f", "__listed")


def share_with_total_fallback(df: DataFrame, total_births: DataFrame, population: str = "population",
                              measure: str = "number", out: str = "proportion", half: float = 0.5) -> DataFrame:
    """Where the share is still NULL, use half of all births of the year as denominator."""
    dims = total_births.select("year", F.col(population).alias("__all"))
    joined = join_dimension(df, dims, "year")
    estimate = ratio(F.col(measure), F.col("__all") * F.lit(half))
    return joined.withColumn(out, F.coalesce(F.col(out), estimate)).drop("__all")


def rank_in_group(df: DataFrame, keys: Sequence[str] = ("year", "asab"), measure: str = "number",
                  ties: str = "first", tiebreak: Sequence[str] = ("name",), seed: int = 0,
                  out: str = "rank", slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """Rank by descending ``measure``; an unknown count has an unknown rank.

    ``ties``: "first" (by ``tiebreak``), "average" (mean position, truncated) or
    "random" (seeded).
    """
    if ties == "average":
        return ranking.average_rank(df, measure, keys, out, slice_rows=slice_rows)
    if ties == "random":
        return ranking.random_rank(df, measure, tiebreak[0], seed, keys, out, slice_rows)
    return ranking.ordinal_rank(df, [f"-{measure}", *tiebreak], keys, out, F.col(measure).isNull(), slice_rows)


def drop_rows(df: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    """Remove artifact rows; a predicate that is NULL does not remove a row."""
    hit = reduce(lambda a, b: a | b, predicates)
    return df.where(~F.coalesce(hit, F.lit(False)))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n <> 1")


def remap_births(df: DataFrame, measure: str = "measure", region: str = "region", year: str = "year",
                 value: str = "population", keep_region: str = "AUS: Australia",
                 male: str = "4: Male births", female: str = "5: Female births") -> DataFrame:
    """Official births table: keep one region, turn its two sex measures into columns."""
    kept = df.where((F.col(region) == keep_region) & F.col(measure).isin(male, female))
    return kept.groupBy(F.col(year).alias("year")).agg(
        F.max(F.when(F.col(measure) == male, F.col(value))).alias("male"),
        F.max(F.when(F.col(measure) == female, F.col(value))).alias("female"),
    )
