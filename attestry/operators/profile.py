"""Corpus profile, longevity and distribution summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.exprs import half_even, join_dimension, join_null_safe, not_in, ratio, recode, sum_strict
from attestry.functions.vocab import REGISTER_AREAS_WITH_NI
from attestry.operators import ranking
from attestry.operators.reshape import pivot_values


def corpus_profile(df: DataFrame) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("asab") == "F").alias("entries_f"),
        F.count_if(F.col("asab") == "M").alias("entries_m"),
        F.count_distinct("name").alias("names"),
        F.count_distinct("region").alias("regions"),
    )
    return counts.withColumn("share_f", ratio(F.col("entries_f"), F.col("entries")))


def region_year_span(df: DataFrame) -> DataFrame:
    spans = df.groupBy("region").agg(F.min("year").alias("earliest"), F.max("year").alias("latest"))
    return spans.withColumn("years", F.col("latest") - F.col("earliest") + 1).orderBy(F.col("years").desc(), "region")


def attestation_class(df: DataFrame) -> DataFrame:
    """Rows per name and sex, and whether the name is attested for both sexes or one."""
    counts = df.groupBy("name").agg(
        F.nullif(F.count_if(F.col("asab") == "F"), F.lit(0)).alias("fem"),
        F.nullif(F.count_if(F.col("asab") == "M"), F.lit(0)).alias("msc"),
    )
    has_f, has_m = F.col("fem").isNotNull(), F.col("msc").isNotNull()
    label = F.when(has_f & has_m, "both").when(has_f, "F only").when(has_m, "M only")
    return counts.withColumn("class", label)


def attestation_class_counts(df: DataFrame, rated: DataFrame) -> DataFrame:
    """Names per class, and how many of them were ever rated."""
    names = rated.select("name").distinct().withColumn("__rated", F.lit(True))
    return (
        attestation_class(df).where(F.col("class").isNotNull()).join(names, "name", "left")
        .groupBy("class").agg(F.count("*").alias("names"), F.count("__rated").alias("rated_names"))
    )


def _summaries(column: str) -> list[Column]:
    c = F.col(column)
    return [
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("sd"), (F.stddev_samp(c) / F.sqrt(F.count("*"))).alias("se"),
    ]


def _distribution(totals: DataFrame, column: str, by: Sequence[str], slice_rows: int | None) -> DataFrame:
    """Summary statistics per group; the median comes from counted values, as groups are unbounded."""
    medians = ranking.group_quantiles(totals, column, {"median": 0.5}, by, slice_rows)
    return join_null_safe(totals.groupBy(*by).agg(*_summaries(column)), medians, by, "left")


def name_totals(df: DataFrame, by: Sequence[str] = ("region", "name", "asab")) -> DataFrame:
    return df.groupBy(*by).agg(sum_strict(F.col("number")).alias("total"))


def total_distribution(df: DataFrame, slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """How names' totals are distributed per (region, sex)."""
    return _distribution(name_totals(df), "total", ["region", "asab"], slice_rows)


def coverage_distribution(df: DataFrame, min_total: int = 1, placeholders: Sequence[str] = ("Baby",),
                          slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """How names' totals are distributed per number of regions they occur in."""
    per_region = name_totals(df.where(not_in(F.col("name"), placeholders)), ("name", "region"))
    per_name = per_region.where(F.col("total") > min_total).groupBy("name").agg(
        F.sum("total").alias("total"), F.count("*").alias("regions"),
    )
    return _distribution(per_name, "total", ["regions"], slice_rows)


def above_median(df: DataFrame, slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """Rows whose count exceeds the median of name totals of their (region, sex)."""
    keys = ["region", "asab"]
    medians = ranking.group_quantiles(name_totals(df), "total", {"median": 0.5}, keys, slice_rows)
    return join_dimension(df, medians, keys, "inner", null_safe=True).where(F.col("number") > F.col("median"))


def longevity(df: DataFrame) -> DataFrame:
    """Per (region, name, sex): share of the region's years and of its total count."""
    regions = df.groupBy("region").agg(F.count_distinct("year").alias("total_years"),
                                       F.sum("number").alias("total_count"))
    names = df.groupBy("region", "name", "asab").agg(F.count("*").alias("attestations"),
                                                     sum_strict(F.col("number")).alias("count"))
    joined = join_null_safe(names, regions, ["region"])
    return joined.withColumns({
        "longstandingness": ratio(F.col("attestations"), F.col("total_years")),
        "percent": ratio(F.col("count"), F.col("total_count")),
    })


def longstanding_unisex(longevities: DataFrame) -> DataFrame:
    """Names that both sexes got in every year of some region."""
    always = longevities.where(F.col("attestations") == F.col("total_years"))
    wide = pivot_values(always, ["region", "name"], "asab", "count", {"F": "f", "M": "m"}, F.max)
    return wide.where(F.col("f").isNotNull() & F.col("m").isNotNull()).select("name").distinct()


def longevity_series(df: DataFrame, longevities: DataFrame, at_least: float = 0.01,
                     below: float | None = None) -> DataFrame:
    """Yearly rows of always-attested names whose share of the region's total is in a band."""
    band = (F.col("attestations") == F.col("total_years")) & (F.col("percent") >= at_least)
    if below is not None:
        band = band & (F.col("percent") < below)
    chosen = longevities.where(band).select("region", "name", "asab", "percent")
    return df.select("year", "region", "name", "asab", "number").join(chosen, ["region", "name", "asab"])


def always_attested(df: DataFrame, region: str = "USA", min_n: int = 50, min_years: int = 143) -> DataFrame:
    """(name, sex) with more than ``min_n`` bearers in at least ``min_years`` years of a region."""
    big = df.where((F.col("region") == region) & (F.col("number") > min_n))
    return big.groupBy("name", "asab").agg(F.count("*").alias("count")).where(F.col("count") >= min_years)


def always_attested_rows(df: DataFrame, region: str = "USA", min_n: int = 50, min_years: int = 143) -> DataFrame:
    """All rows of the region for names that qualify for either sex."""
    names = always_attested(df, region, min_n, min_years).select("name").distinct()
    return df.where(F.col("region") == region).join(names, "name", "left_semi")


def always_attested_series(df: DataFrame, region: str = "USA", min_n: int = 50, min_years: int = 143) -> DataFrame:
    """Rows of the region for the qualifying (name, sex), with the number of qualifying years."""
    chosen = always_attested(df, region, min_n, min_years)
    return df.where(F.col("region") == region).join(chosen, ["name", "asab"])


def unisex_intersection(df: DataFrame, also_in: DataFrame | None = None) -> DataFrame:
    """Names attested for both sexes, optionally also in a second list."""
    f = df.where(F.col("asab") == "F").select("name")
    m = df.where(F.col("asab") == "M").select("name")
    both = f.intersect(m)
    return both if also_in is None else both.intersect(also_in.select("name"))


def top_per_area(df: DataFrame, n: int = 100, areas: Mapping[str, str] = REGISTER_AREAS_WITH_NI) -> DataFrame:
    """The n most frequent names of each world area; unmapped regions form a NULL area."""
    sums = (
        df.withColumn("area", recode(F.col("region"), areas))
        .groupBy("name", "area").agg(sum_strict(F.col("number")).alias("sum"))
    )
    # the rank filter lets every task cut its part to n rows per area before the shuffle
    place = F.row_number().over(Window.partitionBy("area").orderBy(F.col("sum").desc_nulls_last(), "name"))
    return sums.withColumn("rank", place).where(F.col("rank") <= n)


def decade_rollup(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Sums per (name, region, decade) over (name, year, region) cells."""
    if names is not None:
        cells = cells.join(names.select("name").distinct(), "name", "left_semi")
    return cells.withColumn("decade", half_even(F.col("year"), -1)).groupBy("name", "region", "decade").agg(
        F.sum("afab").alias("afab"), F.sum("amab").alias("amab"), F.count("*").alias("n"),
    )


def histogram(df: DataFrame, column: str, by: Sequence[str] = (), binwidth: float | None = None,
              bins: int | None = None, log: bool = False) -> DataFrame:
    """Counts per facet and bin; bins are centred on multiples of their width and closed on the right.

    Give a width, or a number of bins over the range of the whole column. On a
    log10 scale values that are not positive are left out.
    """
    value = F.when(F.col(column) > 0, F.log10(column)) if log else F.col(column).cast("double")
    kept = df.select(*by, value.alias("__x")).where(F.col("__x").isNotNull())
    if binwidth is None:
        lo, hi = kept.agg(F.min("__x"), F.max("__x")).first()
        if lo is None:
            return kept.select(*by, F.col("__x").alias("bin_center"), F.lit(0).cast("bigint").alias("n")).limit(0)
        binwidth = (hi - lo) / (bins - 1) or 1.0
    center = F.ceil(F.col("__x") / F.lit(float(binwidth)) - 0.5) * F.lit(float(binwidth))
    return kept.groupBy(*by, center.alias("bin_center")).agg(F.count("*").alias("n"))


def name_rows(df: DataFrame, name: str, region: str | None = None) -> DataFrame:
    rows = df.where(F.col("name") == name)
    return rows if region is None else rows.where(F.col("region") == region)
