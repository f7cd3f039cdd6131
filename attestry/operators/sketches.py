"""Mergeable name sets: sketches per fine cell, rolled up and intersected without reading the rows again.

A theta sketch keeps the smallest hashes of a set. One is built for each cell,
with partial aggregates, and stored; any coarser grain is the union of its cells,
and sets that hold in several cells at once are intersections. The exact queries
stay beside these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of the hashes a sketch keeps; fewer names are counted exactly.
LG_ENTRIES = 14


def standard_error(lg_entries: int = LG_ENTRIES) -> float:
    """Relative standard error of the count of a union; the share of the smaller set divides it for intersections."""
    return 1 / (2**lg_entries - 1) ** 0.5


def name_sketches(df: DataFrame, by: Sequence[str] = ("region", "year", "asab"), name_col: str = "name", lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``names``, the sketched set of names of each cell, and its number of ``entries``. NULL names are in no set."""
    return df.groupBy(*by).agg(F.theta_sketch_agg(name_col, lg_entries).alias("names"), F.count("*").alias("entries"))


def roll_up(sketches: DataFrame, by: Sequence[str] = (), where: Column | None = None, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Sketches of coarser cells, of the cells for which ``where`` holds."""
    some = sketches if where is None else sketches.where(where)
    return some.groupBy(*by).agg(F.theta_union_agg("names", lg_entries).alias("names"), F.sum("entries").alias("entries"))


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketch replaced by the estimated number of names, ``n_names``."""
    kept = [F.col(f"`{c}`") for c in sketches.columns if c != "names"]
    return sketches.select(*kept, F.theta_sketch_estimate("names").alias("n_names"))


def unisex_sketch(sketches: DataFrame, by: Sequence[str] = (), lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Estimated numbers of names of each sex, of both and of one only, per coarser cell; both is the intersection of the two unions."""
    cells = sketches.groupBy(*by).agg(*[
        F.theta_union_agg(F.when(F.col("asab") == sex, F.col("names")), lg_entries).alias(out) for sex, out in (("F", "f"), ("M", "m"))])
    both = F.theta_sketch_estimate(F.theta_intersection("f", "m"))
    size = {c: F.theta_sketch_estimate(c) for c in ("f", "m")}
    return cells.select(
        *by, size["f"].alias("fem"), size["m"].alias("msc"), both.alias("both"),
        F.theta_sketch_estimate(F.theta_difference("f", "m")).alias("f_only"), F.theta_sketch_estimate(F.theta_difference("m", "f")).alias("m_only"))
