"""Round trips through files: the driver's data are written in a published layout and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attestry.operators import survey
from attestry.plans import standins as st
from attestry.plans.registry import query
from attestry.session import fresh_path
from attestry.sources import readers, sinks


@query("read_yearly_files", "SELECT name, asab, number, year FROM reg", "reg")
def _(spark, sf):
    path = fresh_path(spark, "yearly")
    rows = st.register_rows(spark, sf).withColumn("file", F.concat(F.lit("yob"), F.col("year").cast("string")))
    rows.select("name", "asab", "number", "file").write.partitionBy("file").csv(path)
    return readers.read_yearly_files(spark, path)


@query("read_labelled_files", """
SELECT name AS given_name, number AS amount, asab AS sex, year FROM (
SELECT name, CASE WHEN asab = 'F' THEN 'female' ELSE 'male' END AS asab, year, CAST(sum(number) AS BIGINT) AS number FROM reg GROUP BY ALL) AS r""", "reg")
def _(spark, sf):
    path = fresh_path(spark, "labelled")
    two = st.register_rows(spark, sf).withColumn("sex", F.when(F.col("asab") == "F", "female").otherwise("male"))
    lists = two.groupBy("sex", "year", "name").agg(F.sum("number").alias("number"))
    label = F.concat(F.col("sex"), F.lit("_cy"), F.col("year").cast("string"), F.lit("_top"))
    (lists.select(F.col("name").alias("Given Name"), F.col("number").alias("Amount"), label.alias("file"))
     .write.partitionBy("file").option("header", True).csv(path))
    return readers.read_labelled_files(spark, path, "given_name STRING, amount BIGINT", {
        "sex": (r"(female|male)_cy\d{4}", "string"), "year": (readers.YEAR_IN_FILE, "int")})


@query("read_delimited", "SELECT year, male, female, total FROM births_since", "births_since")
def _(spark, sf):
    path = fresh_path(spark, "delimited")
    (st.births_by_sex_since(st.births(spark, sf)).write.option("sep", "\t").option("header", True)
     .option("nullValue", "..").csv(path))
    return readers.read_delimited(spark, path, "year INT, male BIGINT, female BIGINT, total BIGINT", sep="\t", null_token="..")


@query("read_sheet_grid", """
SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS line FROM events) AS e
WHERE line >= 4""")
def _(spark, sf):
    # a sheet holds 500 events; its first three lines stand for the preamble above the block
    path = fresh_path(spark, "sheets")
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"))
    sheets = st.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 500).alias("sheet")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    text = sheets.select("sheet", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("value"))
    text.write.partitionBy("sheet").text(path)
    return readers.read_sheet_grid(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE", skip=3)


@query("read_json_records", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    # one document per 1000 events, as the interface returns one document per request
    path = fresh_path(spark, "json")
    record = F.struct("event_id", "event_type", "value")
    documents = st.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("request")).agg(
        F.collect_list(record).alias("popular_baby_names"))
    documents.write.json(path)
    return readers.read_json_records(spark, path, "popular_baby_names", "event_id BIGINT, event_type STRING, value DOUBLE",
                                     document_per_line=True)


EXPORT_COLUMNS = ["Participant Private ID", "Participant Status", "Key", "Object Name", "Response"]


@query("read_experiment_export", "SELECT * FROM demographics", "demographics")
def _(spark, sf):
    export = st.demographics_export(spark, sf)
    columns = [F.col(readers.snake_case(c)).alias(c) for c in EXPORT_COLUMNS]
    paths = {}
    for version in (3, 4, 5):
        paths[version] = fresh_path(spark, f"export-v{version}")
        export.where(F.col("version") == version).select(*columns).write.option("header", True).option("escape", '"').csv(paths[version])
    return survey.clean_demographics(readers.read_experiment_export(spark, paths, EXPORT_COLUMNS))


@query("write_dataset", "SELECT year, name, asab, region, number FROM attest", "attest")
def _(spark, sf):
    facts = st.attestations(spark, sf).withColumn("derived", F.col("number") * 2)
    path = sinks.write_dataset(facts, fresh_path(spark, "dataset"), ["derived"], dt.date(2021, 2, 14), partition_by=["region"])
    return spark.read.parquet(path).select("year", "name", "asab", "region", "number")


@query("write_dataset_csv", "SELECT name, asab, region, year, number FROM attest", "attest")
def _(spark, sf):
    facts = st.attestations(spark, sf).select("name", "asab", "region", "year", "number")
    path = sinks.write_dataset(facts, fresh_path(spark, "dataset"), fmt="csv")
    return readers.read_delimited(spark, path, "name STRING, asab STRING, region STRING, year INT, number BIGINT")
