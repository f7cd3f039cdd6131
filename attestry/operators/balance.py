"""Sex-balance statistics on the attestation fact (year, name, number, rank, asab, region, proportion)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.exprs import (
    abs_log_ratio, half_even, join_null_safe, not_in, positive_log10, ratio, recode, sentence_case, sum_or_zero,
)
from attestry.functions.vocab import (
    PLACEHOLDERS, PLACEHOLDERS_INTERNATIONAL, PLACEHOLDERS_PEAKS, PLACEHOLDERS_PROFILE,
)
from attestry.operators import ranking
from attestry.operators.reshape import widen_by_sex
from attestry.session import materialize


def drop_placeholders(df: DataFrame, names: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    return df.where(not_in(F.col("name"), names))


# --- log ratios ---------------------------------------------------------------

def log_ratio_annual_regional(df: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """One row per (name, year, region), unattested sexes counted as 0."""
    wide = widen_by_sex(drop_placeholders(df, placeholders), fill=0)
    return wide.select(
        "name", "year", "region",
        F.col("number_F").alias("afab"), F.col("number_M").alias("amab"), F.col("number_X").alias("x"),
        abs_log_ratio(F.col("number_F"), F.col("number_M")).alias("log_ratio"),
    )


def _sex_total(sex: str) -> Column:
    return sum_or_zero(F.when(F.col("asab") == sex, F.col("number")))


def _log_ratio_by(df: DataFrame, by: Sequence[str], distinct: dict[str, str],
                  placeholders: Sequence[str]) -> DataFrame:
    counts = [F.count_distinct(c).alias(out) for c, out in distinct.items()]
    totals = drop_placeholders(df, placeholders).groupBy(*by).agg(
        *counts, _sex_total("F").alias("total_afab"), _sex_total("M").alias("total_amab"),
    )
    return totals.select(
        *by, *distinct.values(), "total_afab", "total_amab",
        (F.col("total_afab") + F.col("total_amab")).alias("total_people"),
        abs_log_ratio(F.col("total_afab"), F.col("total_amab")).alias("log_ratio"),
    )


def log_ratio_annual(df: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    return _log_ratio_by(df, ["name", "year"], {"region": "regions"}, placeholders)


def log_ratio_regional(df: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    return _log_ratio_by(df, ["name", "region"], {"year": "years"}, placeholders)


def log_ratio_combined(df: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    return _log_ratio_by(df, ["name"], {"region": "regions", "year": "years"}, placeholders)


def log_ratio_grains(df: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """The annual, regional and combined ratios in one pass over the fact.

    Cells are reduced to (name, year, region) first, so only those rows are
    multiplied by the grouping sets.
    """
    cells = drop_placeholders(df, placeholders).groupBy("name", "year", "region").agg(
        _sex_total("F").alias("afab"), _sex_total("M").alias("amab"),
    )
    sets = [["name", "year"], ["name", "region"], ["name"]]
    grains = cells.groupingSets(sets, "name", "year", "region").agg(
        F.grouping_id().alias("__gid"),
        F.count("*").alias("cells"), F.sum("afab").alias("total_afab"), F.sum("amab").alias("total_amab"),
    )
    grain = F.when(F.col("__gid") == 1, "annual").when(F.col("__gid") == 2, "regional").otherwise("combined")
    return grains.select(
        grain.alias("grain"), "name", "year", "region", "cells", "total_afab", "total_amab",
        (F.col("total_afab") + F.col("total_amab")).alias("total_people"),
        abs_log_ratio(F.col("total_afab"), F.col("total_amab")).alias("log_ratio"),
    )


# --- balance profile and ranking ------------------------------------------------

def _cell_ratios(df: DataFrame) -> DataFrame:
    wide = widen_by_sex(df, fill=0)
    return wide.withColumn("log_ratio", abs_log_ratio(F.col("number_F"), F.col("number_M")))


def balance_profile(df: DataFrame, group: Sequence[str] = ("name",), region_scaled: bool = True,
                    placeholders: Sequence[str] = PLACEHOLDERS_PROFILE) -> DataFrame:
    """Totals, means and log-ratio statistics over the cells where both sexes are attested.

    ``region_scaled`` divides the means by the number of regions; without it the
    ratio of the means is reported as ``mean_logratio2``. A name has at most
    years x regions cells, so the exact median stays small per group.
    """
    cells = _cell_ratios(drop_placeholders(df, placeholders)).where(F.col("log_ratio").isNotNull())
    stats = cells.groupBy(*group).agg(
        F.sum("number_F").alias("total_F"),
        F.sum("number_M").alias("total_M"),
        F.count("*").alias("entries"),
        F.count_distinct("region").alias("regions"),
        F.avg("log_ratio").alias("mean_logratio"),
        F.percentile("log_ratio", F.lit(0.5)).alias("median_logratio"),
        F.stddev_samp("log_ratio").alias("sd_logratio"),
        F.max("log_ratio").alias("max_logratio"),
        F.min("log_ratio").alias("min_logratio"),
    )
    scale = F.col("regions") if region_scaled else F.lit(1)
    profile = stats.select(
        *group, "total_F", "total_M", "entries", "regions",
        (F.col("total_F") / F.col("entries") / scale).alias("mean_F"),
        (F.col("total_M") / F.col("entries") / scale).alias("mean_M"),
        "mean_logratio", "median_logratio", "sd_logratio",
        (F.col("sd_logratio") / F.sqrt("entries")).alias("se_logratio"),
        "max_logratio", "min_logratio",
    )
    if not region_scaled:
        profile = profile.withColumn("mean_logratio2", abs_log_ratio(F.col("mean_F"), F.col("mean_M")))
    return profile


def discarded_entries(df: DataFrame) -> DataFrame:
    """How many (name, year, region) cells lack one sex, and their share."""
    cells = _cell_ratios(df).agg(
        F.count_if(F.col("log_ratio").isNull()).alias("discarded"), F.count("*").alias("entries"),
    )
    return cells.select(
        "discarded", (F.col("entries") - F.col("discarded")).alias("kept"),
        ratio(F.col("discarded"), F.col("entries")).alias("share"),
    )


def weigh_commonness(profile: DataFrame, region_scaled: bool = True) -> DataFrame:
    mean = (F.col("mean_F") + F.col("mean_M")) / 2
    weight = F.col("entries") * (F.col("regions") if region_scaled else F.lit(1))
    return profile.withColumns({"mean_asab": mean, "weighted_frequency": mean * weight})


# A ratio and its reciprocal have the same balance, but their logarithms may differ
# in the last bits; sort keys are compared to this many digits.
KEY_DIGITS = 12


def _key(c: str) -> Column:
    return F.round(F.col(c), KEY_DIGITS)


def _rank_combined(weighed: DataFrame, orders: dict[str, list], combined: Column, last: list, slice_rows: int | None) -> DataFrame:
    """The ranks of all orders, and the rank of their combination; profile rows are joined with them once."""
    held = materialize(weighed, "profile")
    ranks = ranking.independent_ranks(held, "name", orders, slice_rows).withColumn("combined_order", combined)
    extra = [c for c in last if isinstance(c, str) and c not in orders]
    if extra:
        ranks = join_null_safe(ranks, held.select("name", *extra), ["name"])
    keys = [F.col("combined_order").asc(), *[_key(c).asc_nulls_last() if c in extra else c for c in last]]
    final = ranking.ordinal_rank(ranks, keys, out="rank_order", slice_rows=slice_rows).drop(*extra)
    return join_null_safe(held, final, ["name"])


def balance_rank(profile: DataFrame, common_weight: int = 3, slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """International ranking: range, average and commonness ranks, weighted and ranked again.

    Every rank breaks ties by further keys and finally by the order before it,
    which starts alphabetically; a NULL deviation sorts last. The order before is
    spelled out key by key, so that the ranks do not wait for each other.
    """
    by_range = [_key("min_logratio"), _key("max_logratio"), _key("sd_logratio"), "-weighted_frequency", "-mean_asab", "-regions", "-entries", "name"]
    by_mean = [_key("mean_logratio"), _key("median_logratio"), _key("se_logratio"), "-weighted_frequency", *by_range]
    orders = {"order_logratio": by_range, "order_mean": by_mean, "order_common": ["-weighted_frequency", _key("sd_logratio"), *by_mean]}
    combined = F.col("order_logratio") + F.col("order_mean") + F.col("order_common") * common_weight
    return _rank_combined(weigh_commonness(profile), orders, combined, ["order_common"], slice_rows)


def balance_rank_single(profile: DataFrame, last_key: str = "mean_logratio",
                        slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """One-region ranking: plain sum of three ranks, ties by ``last_key``."""
    by_range = [_key("min_logratio"), _key("max_logratio"), _key("sd_logratio"), "name"]
    by_mean = [_key("mean_logratio"), _key("median_logratio"), _key("se_logratio"), *by_range]
    orders = {"order_logratio": by_range, "order_mean": by_mean, "order_common": ["-weighted_frequency", *by_mean]}
    combined = F.col("order_logratio") + F.col("order_mean") + F.col("order_common")
    return _rank_combined(weigh_commonness(profile, region_scaled=False), orders, combined, [last_key, "order_common"], slice_rows)


def norming_filter(profile: DataFrame, placeholders: Sequence[str] = PLACEHOLDERS, min_entries: int = 2,
                   min_at_most: float = 0.1, max_at_most: float = 2.0, sd_at_most: float = 0.5,
                   mean_at_most: float = 1.0, median_at_most: float = 1.0, mean2_at_most: float = 1.0,
                   total_at_least: int = 1000) -> DataFrame:
    """Names balanced and common enough to norm; expects the one-region profile."""
    return drop_placeholders(profile, placeholders).where(
        (F.col("entries") >= min_entries)
        & (F.col("min_logratio") <= min_at_most)
        & (F.col("max_logratio") <= max_at_most)
        & (F.col("sd_logratio") <= sd_at_most)
        & (F.col("mean_logratio") <= mean_at_most)
        & (F.col("median_logratio") <= median_at_most)
        & (F.col("mean_logratio2") <= mean2_at_most)
        & (F.col("total_F") >= total_at_least)
        & (F.col("total_M") >= total_at_least)
    )


def lookup_ranks(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """The ranks of the listed names."""
    return ranked.join(names.select("name").distinct(), "name", "left_semi").select(
        "rank_order", "name", "entries", "mean_logratio", "order_logratio", "order_mean", "order_common",
        "combined_order",
    )


def top_balanced(ranked: DataFrame, n: int = 100) -> DataFrame:
    return ranked.where(F.col("rank_order") <= n).select("name", "rank_order")


# --- unisex lists ---------------------------------------------------------------

def unisex_dataset(df: DataFrame) -> DataFrame:
    """Wide table of names given to both sexes in the same (year, region).

    ``year_count`` is the name's best regional count of years, taken over the
    smaller of the two sexes.
    """
    labels = {"F": "AFAB", "M": "AMAB"}
    long = df.select(
        "year", "region", "number", "rank", "proportion", F.lit(1).alias("attested"),
        sentence_case(F.col("name")).alias("name"), recode(F.col("asab"), labels, "X").alias("asab"),
    )
    wide = widen_by_sex(long, ("number", "rank", "proportion", "attested"), fill=0, sexes=("AFAB", "AMAB", "X"))
    # cells of a name number at most years x regions, so both windows stay small;
    # one shuffle on name serves them
    wide = widen_with_years(wide.repartition("name"))
    reg = F.least("year_count_AFAB", "year_count_AMAB")
    best = Window.partitionBy("name")
    return (
        wide.withColumn("year_count_reg", reg).drop("year_count_AFAB", "year_count_AMAB")
        .withColumn("year_count", F.max("year_count_reg").over(best))
        .where("year_count > 0")
    )


def widen_with_years(wide: DataFrame) -> DataFrame:
    """Years attested per (name, region, sex), 0 on rows where the sex is missing.

    A row attests its year whatever its count, be it unknown or 0.
    """
    years = Window.partitionBy("name", "region")
    cols = {}
    for s in ("AFAB", "AMAB", "X"):
        here = F.col(f"attested_{s}") == 1
        cols[f"year_count_{s}"] = F.when(here, F.count_if(here).over(years)).otherwise(F.lit(0))
    return wide.withColumns(cols).drop("attested_AFAB", "attested_AMAB", "attested_X")


def _listed(df: DataFrame, names: DataFrame) -> DataFrame:
    """Restrict the fact to listed names before any reshaping."""
    return df.join(names.select("name").distinct(), "name", "left_semi")


def _two_sided(df: DataFrame, names: DataFrame, values: Sequence[str] = ("number", "proportion")) -> DataFrame:
    wide = widen_by_sex(_listed(df, names), values)
    return wide.where(F.col("proportion_F").isNotNull() & F.col("proportion_M").isNotNull())


def unisex_above_share(df: DataFrame, names: DataFrame, share: float = 0.0005) -> DataFrame:
    """Listed names that pass ``share`` for both sexes in some (year, region)."""
    cells = _two_sided(df, names, ("proportion",))
    return cells.where((F.col("proportion_M") > share) & (F.col("proportion_F") > share)).select("name").distinct()


def peak_counts(df: DataFrame, names: DataFrame, min_n: int | None = 3, measure: str = "number",
                placeholders: Sequence[str] = PLACEHOLDERS_PEAKS) -> DataFrame:
    """Highest ``measure`` per (name, region) and sex, over cells with enough of both sexes."""
    cells = _two_sided(drop_placeholders(df, placeholders), names)
    if min_n is not None:
        cells = cells.where((F.col("number_M") >= min_n) & (F.col("number_F") >= min_n))
    return cells.groupBy("name", "region").agg(
        F.max(f"{measure}_M").alias(f"{measure}_M"), F.max(f"{measure}_F").alias(f"{measure}_F"),
    )


def region_coverage(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("name").agg(F.count("*").alias("regions")).orderBy(F.col("regions").desc(), "name")


def international_unisex(df: DataFrame, names: DataFrame, min_ratio: float = 0.1, min_n: int = 3,
                         placeholders: Sequence[str] = PLACEHOLDERS_INTERNATIONAL) -> DataFrame:
    """Per name: the regions in which neither sex is a small minority of the peaks."""
    peaks = peak_counts(df, names, None, placeholders=placeholders)
    f, m = F.col("number_F"), F.col("number_M")
    kept = peaks.where((ratio(m, f) >= min_ratio) & (ratio(f, m) >= min_ratio) & (m > min_n) & (f > min_n))
    # a name has one row per region here, so the list is as short as the list of regions
    return kept.groupBy("name").agg(
        F.count("*").alias("count"),
        F.array_join(F.array_sort(F.collect_list("region")), "; ").alias("countries"),
    )


def columns_by_count(summary: DataFrame, drop_below: int = 4, through: int = 0, prefix: str = "n",
                     slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """Ragged table: one column per region count, names stacked alphabetically.

    There is a column for every count from ``drop_below`` to the largest found, or to
    ``through`` if that is more, and rows that the first column does not reach are left out.
    """
    kept = materialize(summary.where(F.col("count") >= drop_below).select("count", "name"), "counts")
    max_count = max(kept.agg(F.max("count")).first()[0] or drop_below, through)
    placed = ranking.ordinal_rank(kept, ["name"], ["count"], "position", slice_rows=slice_rows)
    columns = [F.max(F.when(F.col("count") == i, F.col("name"))).alias(f"{prefix}{i}")
               for i in range(drop_below, max_count + 1)]
    return placed.groupBy("position").agg(*columns).where(F.col(f"{prefix}{drop_below}").isNotNull())


def mutual_ratio_filter(df: DataFrame, names: DataFrame, min_ratio: float = 0.25, share: float = 0.0005,
                        exclude: Sequence[str] = ("Mary",)) -> DataFrame:
    """Cells in which each sex has more than ``min_ratio`` of the other and more than ``share``."""
    cells = _two_sided(drop_placeholders(df, exclude), names)
    f, m = F.col("number_F"), F.col("number_M")
    return cells.where(
        (F.col("proportion_M") > share) & (F.col("proportion_F") > share)
        & (ratio(m, f) > min_ratio) & (ratio(f, m) > min_ratio)
    ).select("name", "year", "region", "number_F", "number_M", "proportion_F", "proportion_M")


def trajectories(df: DataFrame, names: DataFrame, measure: str = "number", fill: int | None = None,
                 two_sided: bool = False, share: float | None = None, min_points: int = 1) -> DataFrame:
    """Year series per (region, name), wide by sex, in plotting order.

    ``two_sided`` keeps cells with both sexes, ``share`` cells above a share for
    both, ``min_points`` series with that many cells left.
    """
    values = sorted({measure, "proportion"}) if share is not None else [measure]
    wide = widen_by_sex(_listed(df, names), values, fill, sexes=("F", "M"))
    f, m = f"{measure}_F", f"{measure}_M"
    if two_sided:
        wide = wide.where((F.col(f) > 0) & (F.col(m) > 0))
    if share is not None:
        wide = wide.where((F.col("proportion_F") > share) & (F.col("proportion_M") > share))
    if min_points > 1:
        # at most one row per year in a series
        points = F.count("*").over(Window.partitionBy("region", "name"))
        wide = wide.withColumn("__points", points).where(F.col("__points") >= min_points).drop("__points")
    return wide.select("region", "name", "year", f, m).orderBy("region", "name", "year")


def pairwise_rank_summary(df: DataFrame) -> DataFrame:
    """Rank and count comparison of the two sexes per (locale, name).

    Expects (locale, name, asab, rank, count, total); ``count`` is a yearly mean
    and may be NULL, then the totals are averaged instead.
    """
    wide = widen_by_sex(df, ("rank", "count", "total"), ids=("locale", "name"), sexes=("F", "M"))
    both = wide.where(F.col("rank_F").isNotNull() & F.col("rank_M").isNotNull())
    gap = F.col("rank_M") - F.col("rank_F")
    total = F.col("total_F") + F.col("total_M")
    return both.select(
        "locale", "name", "rank_F", "rank_M", "count_F", "count_M", "total_F", "total_M",
        gap.alias("rank_diff"),
        ((F.col("rank_F") + F.col("rank_M")) / 2).alias("rank_mean"),
        F.coalesce((F.col("count_F") + F.col("count_M")) / 2, total / 2).alias("count_mean"),
        total.alias("total_count"),
        F.when(total > 0, F.ln(total)).alias("log_count"),
        F.abs(gap).alias("abs_diff"),
    ).orderBy("locale", "abs_diff", "name")


# --- shares and angles ----------------------------------------------------------

def dominance_shares(df: DataFrame, f: str = "total_afab", m: str = "total_amab", scale: float = 100.0,
                     peak_within: Sequence[str] | None = None) -> DataFrame:
    """Each sex as a share of the larger sex and of both, and the mean of the two shares.

    ``peak_within`` takes the larger sex over a whole group (for example a name's
    cells) instead of over the row.
    """
    top = F.greatest(F.col(f), F.col(m))
    if peak_within is not None:
        top = F.max(top).over(Window.partitionBy(*peak_within))
    shared = df.withColumns({"max_asab": top, "__both": F.col(f) + F.col(m)})
    out = {}
    for sex, c in (("f", f), ("m", m)):
        out[f"max_{sex}_prop"] = ratio(F.col(c), F.col("max_asab"))
        out[f"total_{sex}_prop"] = ratio(F.col(c), F.col("__both"))
    shared = shared.withColumns(out)
    return shared.withColumns({
        "fem": (F.col("max_f_prop") + F.col("total_f_prop")) / 2 * scale,
        "masc": (F.col("max_m_prop") + F.col("total_m_prop")) / 2 * scale,
    }).drop("__both")


def _peak(by: Sequence[str], f: str, m: str) -> Column:
    """The larger sex's best cell; a group has at most years x regions cells."""
    return F.max(F.greatest(F.col(f), F.col(m))).over(Window.partitionBy(*by))


def log_scaled_share(df: DataFrame, by: Sequence[str] = ("name", "region"), f: str = "afab",
                     m: str = "amab") -> DataFrame:
    """log10 counts as a share of the log10 of the group's peak; undefined values are NULL."""
    peaked = df.withColumn("yr_max", _peak(by, f, m))
    top = F.when(F.col("yr_max") > 1, F.log10("yr_max"))
    return peaked.withColumns({
        "logprop_afab": positive_log10(F.col(f)) / top,
        "logprop_amab": positive_log10(F.col(m)) / top,
    })


def balance_angle(df: DataFrame, by: Sequence[str] = ("name", "region"), f: str = "afab", m: str = "amab") -> DataFrame:
    """Angle of (F, M) in whole degrees around the balanced diagonal, counted per facet."""
    peaked = df.withColumn("yr_max", _peak(by, f, m))
    angle = F.degrees(F.atan2(ratio(F.col(m), F.col("yr_max")), ratio(F.col(f), F.col("yr_max"))))
    return (
        peaked.withColumn("plot_degrees", (half_even(angle, 0) - 45).cast("int"))
        .groupBy("region", "name", "plot_degrees").agg(F.count("*").alias("n"))
    )


