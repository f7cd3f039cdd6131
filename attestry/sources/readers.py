"""Readers for the register and survey file layouts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.session import materialize

# How sex and year are written in the file names of labelled registers.
SEX_IN_FILE = r"(female|male)_cy\d{4}"
YEAR_IN_FILE = r"cy(\d{4})"
YEAR_AT_END = r"(\d{4})\.csv"


def _path_part(pattern: str) -> Column:
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return F.when(found != "", found)


def read_yearly_files(spark: SparkSession, path: str | Sequence[str], year_regex: str = r"yob(\d{4})",
                      schema: str = "name STRING, asab STRING, number BIGINT") -> DataFrame:
    """Header-less CSV, one file (or folder of parts) per year; the year comes from the path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).csv(path)
    return rows.select("*", _path_part(year_regex).cast("int").alias("year"))


def _by_header(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """CSV columns bound by the names in the header, whatever their order, and cast.

    A header name and a column match under ``snake_case``. Columns that are not
    asked for are skipped; a column no header has is an error, and so is a file
    whose header differs from that of the first file. Cells that do not fit their
    type are NULL.
    """
    reader = spark.read.options(header=True, recursiveFileLookup=True, **options)
    heads = reader.csv(path).columns
    found = {snake_case(h): h for h in reversed(heads)}
    missing = [f.name for f in schema if snake_case(f.name) not in found]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(heads)}")
    strings = T.StructType([T.StructField(h, T.StringType()) for h in heads])
    rows = reader.option("enforceSchema", False).schema(strings).csv(path)
    return rows.select("*", "_metadata.file_path").select(
        *[F.col(f"`{found[snake_case(f.name)]}`").try_cast(f.dataType).alias(f.name) for f in schema], "file_path")


def _file_part(pattern: str) -> Column:
    found = F.regexp_extract(F.col("file_path"), pattern, 1)
    return F.when(found != "", found)


def read_labelled_files(spark: SparkSession, path: str | Sequence[str], schema: str,
                        labels: Mapping[str, tuple[str, str]]) -> DataFrame:
    """CSV files with a header whose names carry facts; columns are bound by name.

    ``labels`` maps an output column to (regex with one group, SQL type).
    """
    columns = T.StructType.fromDDL(schema)
    facts = [_file_part(pattern).cast(dtype).alias(out) for out, (pattern, dtype) in labels.items()]
    return _by_header(spark, path, columns).select(*columns.names, *facts)


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",",
                   null_token: str = "", header: bool = True, skip: int = 0) -> DataFrame:
    """Delimited text with its own NULL token and, for small published tables, a preamble.

    With a header, columns are bound by name; without one and after a preamble, by position.
    """
    if skip:
        return read_sheet_grid(spark, path, schema, skip=skip, header=header, sep=sep, null_token=null_token)
    options = {"sep": sep, "nullValue": null_token, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if header:
        return _by_header(spark, path, T.StructType.fromDDL(schema), **options).drop("file_path")
    return spark.read.schema(schema).options(recursiveFileLookup=True, **options).csv(path)


# Stand-ins, from the private use area, for line breaks inside quoted cells.
_BREAKS = {"\n": "\ue000", "\r": "\ue001"}


def _split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, quotes, even, odd) of each stretch of lines: its quotes, and the records that start in it after an even or odd number."""
    for batch in batches:
        files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        quotes = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        names = files.indices.to_numpy()
        edges = np.flatnonzero(np.diff(names) | np.diff(blocks)) + 1
        for at, to in zip([0, *edges], [*edges, len(blocks)]):
            if at < to:
                own = quotes[at:to]
                odd = int(((np.cumsum(own) - own) % 2).sum())
                yield pa.RecordBatch.from_pylist([{
                    "file": files.dictionary[names[at]].as_py(), "block": int(blocks[at]), "quotes": int(own.sum()), "even": to - at - odd, "odd": odd}])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split joined into records: (file, at, block, line, whole); ``whole`` is false for what a border may have cut."""
    names = ["file", "at", "block", "line", "whole"]
    file, block, at, inside, cut, held = None, -1, -1, False, False, []

    def rest() -> list[pa.RecordBatch]:
        if not held:
            return []
        whole = not cut and not inside
        return [pa.RecordBatch.from_arrays([pa.array([v]) for v in (file, at, block, "\n".join(held), whole)], names=names)]

    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        for f, b, line, odd, start in zip(*(c.to_pylist() for c in batch.columns)):
            if (f, b) != (file, block):
                yield from rest()
                # what precedes the first record of this split belongs to the last one before it
                file, block, at, inside, cut, held = f, b, start - 1, odd, odd, []
            if not inside:
                if held:
                    for n, v in zip(names, (file, at, block, "\n".join(held), not cut)):
                        out[n].append(v)
                at, held, cut = at + 1, [], False
            held.append(line)
            inside ^= line.count('"') % 2 == 1
        yield pa.RecordBatch.from_arrays([pa.array(out["file"], pa.string()), pa.array(out["at"], pa.int64()), pa.array(out["block"], pa.int64()),
                                          pa.array(out["line"], pa.string()), pa.array(out["whole"], pa.bool_())], names=names)
    yield from rest()


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, at, line): the numbered records of text files with quoted cells; a line break inside quotes is part of its record.

    Files are read in splits. A first pass counts, for each split, its quotes and
    the records that start in it after an even and after an odd number of quotes;
    running sums over the splits of a file tell with which parity and record number
    each begins. A second pass joins lines into numbered records where they are
    read. Only records that a border cuts are shuffled and put together. The table
    of splits, one row for each, is broadcast: under a million rows for 100 TB.
    """
    text = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    stretches = lines.mapInArrow(_split_counts, "file string, block long, quotes long, even long, odd long")
    # a split whose lines come in several batches has several stretches, in the order of their ids
    stretches = stretches.withColumn("nth", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    begun = stretches.withColumn("inside", parity).withColumn("starts", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    begun = begun.withColumn("start", F.coalesce(F.sum("starts").over(before), F.lit(0)))
    ends = F.col("inside") != (F.col("quotes") % 2 == 1)
    splits = begun.withColumn("ends", ends).groupBy("file", "block").agg(
        F.min_by("inside", "nth").alias("inside"), F.min("start").alias("start"), F.max_by("ends", "nth").alias("ends"))
    splits = materialize(splits, "splits")

    def records(some: DataFrame) -> DataFrame:
        placed = lines.join(F.broadcast(some), ["file", "block"]).select("file", "block", "value", "inside", "start")
        return placed.mapInArrow(_records, "file string, at long, block long, line string, whole boolean")

    whole = records(splits).where("whole").select("file", "at", "line")
    cut = splits.where(F.col("inside") | F.col("ends"))
    if cut.isEmpty():
        return whole
    pieces = F.array_sort(F.collect_list(F.struct("block", "line")))
    mended = records(cut).where(~F.col("whole")).groupBy("file", "at").agg(pieces.alias("pieces"))
    return whole.union(mended.select("file", "at", F.array_join(F.transform("pieces", lambda p: p["line"]), "\n").alias("line")))


def read_sheet_grid(spark: SparkSession, path: str | Sequence[str], schema: str, skip: int = 0,
                    rows: tuple[int, int] | None = None, header: bool = False, sep: str = ",",
                    null_token: str = "") -> DataFrame:
    """A cell block of an exported worksheet.

    Records are numbered by ``read_records``, so large files are split. ``rows`` are
    1-based and inclusive, as in a cell range.
    """
    line = F.regexp_replace("line", r"\r\z", "")
    lines = read_records(spark, path).select("at", F.translate(line, "".join(_BREAKS), "".join(_BREAKS.values())).alias("line"))
    first = (rows[0] - 1 if rows else skip) + (1 if header else 0)
    wanted = (F.col("at") >= first) & (F.length("line") > 0)
    if rows:
        wanted = wanted & (F.col("at") < rows[1])
    options = {"sep": sep, "nullValue": null_token, "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = F.from_csv(F.col("line"), F.lit(schema), options)
    cells = lines.where(wanted).select(parsed.alias("r")).select("r.*")
    return cells.select(*[
        F.translate(f.name, "".join(_BREAKS.values()), "".join(_BREAKS)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in cells.schema])


def read_json_records(spark: SparkSession, path: str | Sequence[str], root: str, record: str,
                      document_per_line: bool = False) -> DataFrame:
    """JSON documents that hold their rows in one array field ``root``.

    A file is one document, as an interface returns it, or has one document per
    line, which lets large files be split.
    """
    schema = T.StructType([T.StructField(root, T.ArrayType(T.StructType.fromDDL(record)))])
    reader = spark.read.schema(schema).option("multiLine", not document_per_line)
    documents = reader.option("recursiveFileLookup", True).json(path)
    return documents.select(F.inline(F.col(root)))


def snake_case(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def read_experiment_export(spark: SparkSession, paths: Mapping[int, str | Sequence[str]],
                           columns: Sequence[str]) -> DataFrame:
    """Exports of several task versions, all columns as strings under snake-case names.

    ``columns`` are the header names that are wanted, in any order; a version's
    file may hold more. The version number is added.
    """
    schema = T.StructType([T.StructField(snake_case(c), T.StringType()) for c in columns])
    parts = [_by_header(spark, path, schema, escape='"').drop("file_path").withColumn("version", F.lit(version)) for version, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)
