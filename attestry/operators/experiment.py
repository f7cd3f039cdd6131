"""Forced-choice experiment: node exports to one analysis table, contingencies and percentages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.exprs import join_null_safe, not_in, ratio, recode
from attestry.functions.vocab import (
    END_MARKER, GENDER_COARSE, GENDER_FINE, PRACTICE_KEY, QUESTIONNAIRE_MARKERS, TASK_MARKERS,
)
from attestry.operators.reshape import pivot_values

_ID = "participant"
_UNANSWERED = "PRONOUN..."
_RENAMED = {
    "participant_private_id": "participant",
    "participant_device_type": "device_type",
    "participant_device": "device",
    "participant_os": "os",
    "participant_browser": "browser",
}


def strip_questionnaire(export: DataFrame, quantised: Sequence[str] = ()) -> DataFrame:
    """Answers only: no end-of-file, begin/end or quantised rows."""
    rows = export.withColumnsRenamed(_RENAMED)
    return rows.where((F.col("event_index") != END_MARKER)
                      & not_in(F.col("question_key"), [*QUESTIONNAIRE_MARKERS, *quantised]))


def strip_task(export: DataFrame) -> DataFrame:
    """Trial rows of the two answer zones only."""
    return export.withColumnsRenamed(_RENAMED).where(
        (F.col("event_index") != END_MARKER) & not_in(F.col("trial_number"), TASK_MARKERS)
        & (F.col("display") == "trial") & (F.col("zone_name") != "Zone1")
    )


def clean_consent(export: DataFrame) -> DataFrame:
    answers = strip_questionnaire(export)
    form = F.when(F.col("response") == "1", "yes").otherwise("no")
    return answers.select(_ID, "device_type", "device", "os", "browser", form.alias("consent_form"))


def clean_gender(export: DataFrame, coarse: Mapping[str, str] = GENDER_COARSE, coarse_default: str = "other",
                 fine: Mapping[str, str] = GENDER_FINE, fine_default: str = "nonbinary") -> DataFrame:
    """Free-text gender in a coarse and a fine category, and the three scales as numbers."""
    columns = {"GenderText": "gender_text", "feminine": "feminine", "masculine": "masculine", "agender": "agender"}
    wide = pivot_values(strip_questionnaire(export), [_ID], "question_key", "response", columns, F.max)
    scales = {c: F.col(c).try_cast("double") for c in ("feminine", "masculine", "agender")}
    return wide.withColumns({
        **scales,
        "gender_coarse": recode(F.col("gender_text"), coarse, coarse_default),
        "gender_fine": recode(F.col("gender_text"), fine, fine_default),
    })


def clean_language(first: DataFrame, english: DataFrame, spanish: DataFrame) -> DataFrame:
    """First language joined with acquisition details from whichever branch was answered."""
    l1 = strip_questionnaire(first, ["L1-quantised"]).select(_ID, F.col("response").alias("l1"))
    eng = pivot_values(strip_questionnaire(english, ["LocL1Eng-quantised"]), [_ID], "question_key", "response",
                       {"LocL1Eng": "loc_eng", "DateL1Eng-inmonths": "date_eng_acq"}, F.max)
    spa = pivot_values(strip_questionnaire(spanish, ["LocL2Eng-quantised", "TimeuseEng-quantised"]), [_ID],
                       "question_key", "response",
                       {"LocL2Eng": "loc_eng", "DateL2Eng-inmonths": "date_eng_acq", "TimeuseEng": "timeuse_eng"},
                       F.max)
    details = join_null_safe(spa, eng, [_ID, "date_eng_acq", "loc_eng"], "full")
    details = details.withColumn("timeuse_eng", F.coalesce("timeuse_eng", F.lit("~100%")))
    return join_null_safe(details, l1, [_ID], "full")


def score_practice(export: DataFrame, key: Sequence[tuple[int, str, str]] = PRACTICE_KEY) -> DataFrame:
    """Points per participant: one for each answer on the key."""
    hits = [
        (F.col("spreadsheet_row") == row) & (F.col("zone_name") == zone) & (F.col("response") == response)
        for row, zone, response in key
    ]
    point = F.when(reduce(lambda a, b: a | b, hits), 1).otherwise(0)
    return strip_task(export).groupBy(_ID).agg(F.sum(point).alias("practice_accuracy"))


def clean_trials(export: DataFrame) -> DataFrame:
    """One row per trial; ``buttonB`` holds the subject, the other zone the predicate."""
    rows = strip_task(export).withColumn("part", F.when(F.col("zone_name") == "buttonB", "Subject").otherwise("Predicate"))
    return pivot_values(rows, [_ID, "spreadsheet_row", "trial_number", "image"], "part", "response",
                        {"Subject": "subject", "Predicate": "predicate"}, F.max)


def assemble(consent: DataFrame, trials: DataFrame, practice: DataFrame, language: DataFrame,
             gender: DataFrame) -> DataFrame:
    """Full join of the five nodes on participant.

    The person-level nodes are joined first. Trials then take a left join, whose
    larger side Spark can split when one participant has very many rows, plus the
    people without trials; together that is the full join.
    """
    people = consent
    for node in (practice, language, gender):
        people = people.join(node, _ID, "full")
    seen = trials.select(_ID).distinct()
    with_trials = trials.join(people, _ID, "left")
    without = people.join(seen, _ID, "left_anti")
    return with_trials.unionByName(without, allowMissingColumns=True)


def prepare_analysis(data: DataFrame) -> DataFrame:
    """Drop unanswered trials, merge simultaneous bilinguals, label the picture by its file name."""
    first = F.substring(F.lower("image"), 1, 1)
    return data.where(F.col("subject") != _UNANSWERED).withColumns({
        "l1": F.when(F.col("l1") == "Both simultaneously", "Spanish").otherwise(F.col("l1")),
        "image_gender": first,
        "picture": F.when(first == "f", "feminine").when(first == "m", "masculine").otherwise("nonbinary / other"),
    })


def contingency(data: DataFrame, keys: Sequence[str], unit: int = 1, where: Column | None = None) -> DataFrame:
    """Counts of the factor combinations that occur; ``unit`` trials make one participant."""
    kept = data if where is None else data.where(where)
    n = F.count("*")
    return kept.groupBy(*keys).agg((n if unit == 1 else n / F.lit(float(unit))).alias("n"))


def percent_within(data: DataFrame, keys: Sequence[str], within: Sequence[str],
                   where: Column | None = None) -> DataFrame:
    """Counts and their share of the coarser group.

    The window runs over the contingency table, one row per factor combination.
    """
    counts = contingency(data, keys, where=where).withColumnRenamed("n", "count")
    total = F.sum("count").over(Window.partitionBy(*within))
    return counts.withColumn("total", total).withColumn("percent", ratio(F.col("count"), F.col("total")))


def contrast_code(data: DataFrame) -> DataFrame:
    """Numeric contrasts for the three binary questions, counted."""
    coded = data.select(
        "l1",
        F.when(F.col("gender_coarse") != "nonbinary", -0.75).otherwise(0.25).alias("gender"),
        F.when(F.col("subject") != "They", -0.6667).otherwise(0.3333).alias("subject"),
        F.when(F.col("picture") != "nonbinary / other", -0.6667).otherwise(0.3333).alias("picture"),
    )
    return contingency(coded, ["l1", "gender", "subject", "picture"])


def relevel(levels: Mapping[str, Sequence[str]], **reference: str) -> dict[str, list[str]]:
    """Move the chosen reference level of each factor to the front."""
    out = {factor: list(values) for factor, values in levels.items()}
    for factor, first in reference.items():
        if first not in out[factor]:
            raise ValueError(f"{first!r} is not a level of {factor}")
        out[factor] = [first, *[v for v in out[factor] if v != first]]
    return out
