import pytest
from pyspark.sql import functions as F

from attestry.functions import vocab
from attestry.operators import experiment, survey
from attestry.plans import standins as st
from tests.conftest import rows


def test_ratings_cast_bad_numbers_to_null(spark):
    columns = ("participant_private_id string, participant_status string, version int, spreadsheet_display string, spreadsheet_name string, "
               "spreadsheet_freq_block string, object_name string, response string, display string, response_type string")
    base = ("1", "complete", 3, "Rating", "Ann", "2")
    export = spark.createDataFrame([(*base, "Masc Slider", "40", "trial", "response"), (*base, "Fem Slider", "n/a", "trial", "response"),
                                    (*base, "Neut slider", "9", None, "response"), (*base, "Text Entry", "nice", "trial", "response")], columns)
    assert rows(survey.clean_ratings(export), "freq_block", "masc", "fem", "neut", "comment") == [("2", 40.0, None, None, "nice")]
    assert rows(survey.clean_practice(export), "freq_block", "masc") == [(None, 40.0)]


def test_area_falls_back_and_keeps_unmapped(spark):
    df = spark.createDataFrame([("__other", "Ireland"), ("Canada", "Ireland"), ("__other", "Mars"), (None, "Ireland")],
                               "location_influence string, location_longest string")
    assert rows(survey.participant_area(df), "area") == [("Europe",), ("North America",), (None,), (None,)]
    assert rows(survey.participant_area(df, vocab.PARTICIPANT_TWO_AREAS), "area") == [("Islands",), ("North America",), (None,), (None,)]


def test_area_vocabularies_differ_on_northern_ireland():
    assert "Northern Ireland" not in vocab.REGISTER_AREAS and vocab.REGISTER_AREAS_WITH_NI["Northern Ireland"] == "Europe"


def test_decades_round_half_to_even(spark):
    df = spark.createDataFrame([(1945.0,), (1955.0,), (1961.0,)], "birthyear double")
    assert rows(survey.influence_decade(df), "decade") == [(1940,), (1960,), (1960,)]
    assert rows(survey.influence_decade(df, 15, 1970), "decade") == [(1970,), (1980,)]


def test_crosstab_fills_zero(spark):
    df = spark.createDataFrame([("White", "Female", "Canada", None)] * 51 + [("Mixed", "Male", "Canada", None)] * 51,
                               "ethnicity string, gender_cat string, location_influence string, location_longest string")
    assert rows(survey.demographic_crosstab(df)) == [("other", "North America", 0.0, 1.0, 0.0), ("white", "North America", 1.0, 0.0, 0.0)]


def test_missing_acquisition_date_still_matches(spark):
    columns = "event_index string, participant_private_id int, question_key string, response string"
    first = spark.createDataFrame([("1", 1, "L1", "Spanish"), ("1", 2, "L1", "English"), ("1", 1, "L1-quantised", "2"),
                                   ("END OF FILE", None, None, None)], columns)
    english = spark.createDataFrame([("1", 2, "LocL1Eng", "USA"), ("1", 2, "BEGIN QUESTIONNAIRE", None)], columns)
    spanish = spark.createDataFrame([("1", 1, "LocL2Eng", "Spain"), ("1", 1, "TimeuseEng", "20%")], columns)
    got = experiment.clean_language(first, english, spanish)
    assert rows(got, "participant", "loc_eng", "date_eng_acq", "timeuse_eng", "l1") == [
        (1, "Spain", None, "20%", "Spanish"), (2, "USA", None, "~100%", "English")]
    # the same person, place and unknown date in both branches is one row
    both = experiment.clean_language(first, english.withColumn("participant_private_id", F.lit(1)).withColumn(
        "response", F.lit("Spain")), spanish)
    assert rows(both.where("participant = 1"), "loc_eng", "timeuse_eng") == [("Spain", "20%")]


def test_zones_mean_different_things_in_practice_and_trials(spark):
    columns = ("event_index string, participant_private_id int, trial_number string, display string, zone_name string, spreadsheet_row int, "
               "response string, image string")
    task = spark.createDataFrame([("1", 1, "1", "trial", "buttonA", 1, "Someone", "f.jpg"), ("1", 1, "1", "trial", "buttonB", 1, "blew bubbles.", "f.jpg"),
                                  ("1", 1, "1", "trial", "Zone1", 1, "Someone", "f.jpg"), ("1", 1, "2", "info", "buttonA", 3, "They", "f.jpg"),
                                  ("1", 1, "BEGIN TASK", "trial", "buttonA", 3, "They", "f.jpg")], columns)
    assert rows(experiment.score_practice(task)) == [(1, 2)]
    assert rows(experiment.clean_trials(task), "subject", "predicate") == [("blew bubbles.", "Someone")]


@pytest.mark.parametrize("text, coarse, first_study, fine", [
    ("female ", "woman", "female", "female"), ("Woman", "woman", "female", "woman"), ("Agender", "nonbinary", "other", "agender"),
    ("cis female / questioning nonbinary", "other", "other", "questioning"), ("xyz", "other", "other", "nonbinary"), (None, "other", "other", "nonbinary"),
])
def test_gender_categories(spark, text, coarse, first_study, fine):
    columns = "event_index string, participant_private_id int, question_key string, response string"
    export = spark.createDataFrame([("1", 1, "GenderText", text), ("1", 1, "feminine", "80"), ("1", 1, "masculine", "many")], columns)
    second = experiment.clean_gender(export).first()
    assert (second["gender_coarse"], second["gender_fine"], second["feminine"], second["masculine"]) == (coarse, fine, 80.0, None)
    assert experiment.clean_gender(export, vocab.GENDER_COARSE_FIRST_STUDY).first()["gender_coarse"] == first_study


def test_assemble_is_a_full_join(spark):
    consent = spark.createDataFrame([(1, "yes"), (2, "yes")], "participant int, consent_form string")
    trials = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "participant int, subject string")
    practice = spark.createDataFrame([(2, 4), (3, 1)], "participant int, practice_accuracy int")
    language = spark.createDataFrame([(1, "English")], "participant int, l1 string")
    gender = spark.createDataFrame([(1, "man"), (4, "other")], "participant int, gender_coarse string")
    got = experiment.assemble(consent, trials, practice, language, gender)
    want = consent
    for node in (trials, practice, language, gender):
        want = want.join(node, "participant", "full")
    assert rows(got, *want.columns) == rows(want)
    assert len(rows(got)) == 6


def test_percentages_sum_to_one(spark):
    data = spark.createDataFrame([("e", "She"), ("e", "He"), ("e", "He"), ("s", "They")], "l1 string, subject string")
    got = experiment.percent_within(data, ["l1", "subject"], ["l1"])
    assert rows(got, "l1", "subject", "percent") == [("e", "He", pytest.approx(2 / 3)), ("e", "She", pytest.approx(1 / 3)), ("s", "They", 1.0)]
    sums = got.groupBy("l1").agg(F.sum("percent").alias("p"))
    assert all(p == pytest.approx(1) for _, p in rows(sums))


def test_relevel():
    assert experiment.relevel({"s": ["He", "She", "They"]}, s="They") == {"s": ["They", "He", "She"]}
    with pytest.raises(ValueError):
        experiment.relevel({"s": ["He"]}, s="They")


def test_people_are_dealt_to_bounded_tasks(spark, tmp_path, monkeypatch):
    people = [(i, f"C{i}", i % 25, 1.5 * i, "BUILDING") for i in range(1000)] + [(None, None, None, None, None)] + [(7, "C7", 7, 10.5, "BUILDING")] * 2
    columns = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(people, columns).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    whole = [rows(e(spark, str(tmp_path))) for e in (st.demographics_export, st.consent_export, st.gender_export)]
    monkeypatch.setattr(st, "PEOPLE_PER_TASK", 100)
    for export, before in zip((st.demographics_export, st.consent_export, st.gender_export), whole):
        dealt = export(spark, str(tmp_path))
        assert rows(dealt) == before
        each = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(each) > 5 and max(each) < len(before) / 4
    assert len(rows(survey.clean_demographics(st.demographics_export(spark, str(tmp_path))))) == 1001
