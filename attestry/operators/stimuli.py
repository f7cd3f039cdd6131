"""Frequency blocks and stimulus lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.exprs import half_even
from attestry.operators import ranking

# Last type rank of each frequency block; later ranks form block 5.
BLOCK_LIMITS = [10, 30, 90, 170, 300]


def _rows_per_name(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("count"))


def _block(count: Column, fine_up_to: int) -> Column:
    return F.when(count <= fine_up_to, half_even(count, -1)).otherwise(half_even(count, -2))


def freq_block(df: DataFrame, fine_up_to: int = 100) -> DataFrame:
    """Attestations per name, rounded to tens up to ``fine_up_to`` and to hundreds above."""
    return _rows_per_name(df).withColumn("freq_block", _block(F.col("count"), fine_up_to))


def freq_block_histogram(df: DataFrame, fine_up_to: int = 100) -> DataFrame:
    return freq_block(df, fine_up_to).groupBy("freq_block").agg(F.count("*").alias("n"))


def pilot_list(df: DataFrame, min_count: int = 4, min_block: int = 100, digits: int = -2,
               display: str = "Rating") -> DataFrame:
    """Names in the larger blocks; the block is rounded to tens first and then again."""
    tens = _rows_per_name(df).where(F.col("count") >= min_count).withColumn("tens", half_even(F.col("count"), -1))
    return tens.where(F.col("tens") >= min_block).select(
        F.lit(display).alias("display"), "name", half_even(F.col("tens"), digits).alias("freq_block"),
    )


def biased_strata(combined: DataFrame, ratio_cut: float = 3.0, amab_freq: float = 11.0, afab_freq: float = 10.9,
                  equi_freq: float = 9.0, slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """Three frequent strata: AMAB-biased, AFAB-biased and balanced names.

    The ratio is unsigned, so a very frequent biased name can be in both biased
    strata. Ties in the ratio go to fewer people per year.
    """
    biased = F.col("log_ratio") > ratio_cut
    strata = [
        ("amab-biased", biased, "total_amab", amab_freq, -F.col("log_ratio")),
        ("afab-biased", biased, "total_afab", afab_freq, -F.col("log_ratio")),
        ("equi-biased", F.col("log_ratio") <= ratio_cut, "total_people", equi_freq, F.col("log_ratio")),
    ]
    parts = []
    for label, members, total, freq_cut, sort_key in strata:
        freq = F.when(F.col(total) > 0, F.ln(total))
        parts.append(
            combined.where(members & (freq > freq_cut)).select(
                "name", "log_ratio", "total_afab", "total_amab", "total_people",
                freq.alias("freq"), half_even(freq, 0).alias("freq_block"),
                (F.col(total) / F.col("years")).alias("ppl_per_year"),
                F.lit(label).alias("type"), sort_key.alias("__key"),
            )
        )
    pooled = reduce(DataFrame.unionByName, parts)
    ranked = ranking.ordinal_rank(pooled, ["__key", "ppl_per_year", "name"], ["type"], "type_rank",
                                  slice_rows=slice_rows)
    return ranked.drop("__key")


def strata_summary(strata: DataFrame) -> DataFrame:
    return strata.groupBy("type").agg(F.count("*").alias("n"), F.min("ppl_per_year").alias("min_ppl_per_year"))


def block_by_rank(strata: DataFrame, limits: Sequence[int] = BLOCK_LIMITS, display: str = "Rating") -> DataFrame:
    """Presentation blocks 0, 1, 2, ... by rank inside the stratum."""
    block = reduce(lambda rest, i: F.when(F.col("type_rank") <= limits[i], i).otherwise(rest),
                   reversed(range(len(limits))), F.lit(len(limits)))
    return strata.select(F.lit(display).alias("display"), "name", block.alias("freq_block"), "type")


def restrict_to_list(strata: DataFrame, names: DataFrame) -> DataFrame:
    return strata.join(names.select("name").distinct(), "name", "left_semi")
