"""Rating survey: long exports to wide ratings, demographics and their overlay with the registers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.exprs import half_even, join_null_safe, recode
from attestry.functions.vocab import (
    DEMOGRAPHIC_FIELDS, DEMOGRAPHIC_NUMBERS, ETHNICITY_CATEGORIES, PARTICIPANT_AREAS, PARTICIPANT_AREAS_WITH_NI,
    RATING_OBJECTS, REGISTER_AREAS,
)
from attestry.operators.balance import log_scaled_share
from attestry.operators.reshape import pivot_values
from attestry.session import materialize

_PERSON = ["participant", "status", "version"]
_RENAMED = {
    "participant_private_id": "participant",
    "participant_status": "status",
    "spreadsheet_display": "task",
    "spreadsheet_name": "name",
    "spreadsheet_freq_block": "freq_block",
}
_RATING_COLUMNS = [*_PERSON, "task", "name", "freq_block", "masc", "fem", "neut", "comment"]


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def _rate(rows: DataFrame) -> DataFrame:
    wide = pivot_values(rows, [*_PERSON, "task", "name", "freq_block"], "object_name", "response", RATING_OBJECTS, F.max)
    return _numbers(wide, ["masc", "fem", "neut"]).select(*_RATING_COLUMNS)


def clean_practice(export: DataFrame) -> DataFrame:
    """Practice answers, one row per rated name; there is no frequency block in practice."""
    shown = export.where(F.col("display").isNotNull() & (F.col("response_type") == "response"))
    return _rate(shown.withColumnsRenamed(_RENAMED).withColumn("freq_block", F.lit(None).cast("string")))


def clean_ratings(export: DataFrame) -> DataFrame:
    """Ratings, one row per (participant, name)."""
    shown = export.where(F.col("response").isNotNull() & F.col("display").isNotNull())
    return _rate(shown.withColumnsRenamed(_RENAMED))


def clean_demographics(export: DataFrame) -> DataFrame:
    """One row per participant, with birth years of kin as numbers."""
    answers = export.where(F.col("key") == "value").withColumnsRenamed(_RENAMED)
    wide = pivot_values(answers, _PERSON, "object_name", "response", DEMOGRAPHIC_FIELDS, F.max)
    return _numbers(wide, DEMOGRAPHIC_NUMBERS)


def rating_data(practice: DataFrame, ratings: DataFrame, demographics: DataFrame) -> DataFrame:
    return practice.unionByName(ratings).join(demographics, _PERSON, "left")


def ratings_per_name(ratings: DataFrame, names: DataFrame | None = None, more_than: int = 0) -> DataFrame:
    """Ratings per (name, block), optionally of listed names only."""
    if names is not None:
        ratings = ratings.join(names.select("name").distinct(), "name", "left_semi")
    counts = ratings.groupBy("name", "freq_block").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return counts.orderBy(F.col("n").desc(), "name", "freq_block")


def world_area(location: Column, areas: Mapping[str, str] = PARTICIPANT_AREAS, fallback: Column | None = None,
               other: str = "__other") -> Column:
    """World area of a location, taken from ``fallback`` where the answer was "other"; unmapped is NULL."""
    if fallback is not None:
        location = F.when(location == other, fallback).otherwise(location)
    return recode(location, areas)


def participant_area(ratings: DataFrame, areas: Mapping[str, str] = PARTICIPANT_AREAS) -> DataFrame:
    area = world_area(F.col("location_influence"), areas, F.col("location_longest"))
    return ratings.withColumn("area", area)


def influence_decade(ratings: DataFrame, offset: int = 0, since: int | None = None) -> DataFrame:
    """Decade of birth, or of a later age of influence."""
    out = ratings.withColumn("decade", half_even(F.col("birthyear") + offset, -1).cast("int"))
    return out if since is None else out.where(F.col("decade") >= since)


def names_with_min_ratings(ratings: DataFrame, minimum: Mapping[str, int],
                           areas: Mapping[str, str] = PARTICIPANT_AREAS_WITH_NI) -> DataFrame:
    """Names with enough ratings from each listed area; one count column per area."""
    columns = {a: a.lower().replace(" ", "_") for a in sorted(set(areas.values()))}
    counted = participant_area(ratings, areas).groupBy("name", "area").agg(F.count("*").alias("n"))
    wide = pivot_values(counted, ["name"], "area", "n", columns, F.max)
    for area, n in minimum.items():
        wide = wide.where(F.col(columns[area]) >= n)
    return wide


# Answers that may become columns of a table.
MAX_ANSWERS = 200


def ethnicity_recode(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("ethnicity_cat", recode(F.lower("ethnicity"), ETHNICITY_CATEGORIES, "white"))


def demographic_crosstab(ratings: DataFrame, per_person: int = 51) -> DataFrame:
    """Participants (ratings / ratings per person) by ethnicity and area, one column per answer given, 0 if none.

    The answers are taken from the data, MAX_ANSWERS at most; a missing one is counted as ``no_answer``.
    """
    coded = materialize(participant_area(ethnicity_recode(ratings)).select("ethnicity_cat", "area", "gender_cat"), "crosstab")
    found = coded.select("gender_cat").where("gender_cat IS NOT NULL").distinct().limit(MAX_ANSWERS + 1).collect()
    if len(found) > MAX_ANSWERS:
        raise ValueError(f"more than {MAX_ANSWERS} answers; recode them before they become columns")
    answers = sorted(r[0] for r in found)
    cells = [(F.count_if(F.col("gender_cat") == g), g.lower().replace(" ", "_")) for g in answers]
    cells.append((F.count_if(F.col("gender_cat").isNull()), "no_answer"))
    return coded.groupBy("ethnicity_cat", "area").agg(*[(n / F.lit(float(per_person))).alias(out) for n, out in cells])


def population_vs_ratings(cells: DataFrame, ratings: DataFrame, since: int = 1950, offset: int = 0,
                          exclude_regions: Sequence[str] = ("Northern Ireland",),
                          exclude_names: Sequence[str] = ("Godzilla",)) -> DataFrame:
    """Register balance and ratings side by side per (name, area, decade).

    ``cells`` are (name, year, region, afab, amab); shares are scaled to the peak
    of the name in the whole area, then averaged per decade.
    """
    kept = cells.where(~F.col("region").isin(*exclude_regions) & ~F.col("name").isin(*exclude_names))
    kept = kept.withColumn("area", world_area(F.col("region"), REGISTER_AREAS))
    scaled = log_scaled_share(kept, ("name", "area")).withColumn("decade", half_even(F.col("year"), -1).cast("int"))
    population = scaled.where(F.col("decade") >= since).groupBy("name", "area", "decade").agg(
        F.count("*").alias("cells"),
        F.avg("logprop_afab").alias("mean_logprop_afab"), F.avg("logprop_amab").alias("mean_logprop_amab"),
    )
    rated = influence_decade(participant_area(ratings), offset, since).where(~F.col("name").isin(*exclude_names))
    opinions = rated.groupBy("name", "area", "decade").agg(
        F.count("*").alias("ratings"),
        (F.avg("fem") / 100).alias("mean_fem"), (F.avg("masc") / 100).alias("mean_masc"),
    )
    return join_null_safe(population, opinions, ["name", "area", "decade"], "full")
