import datetime as dt
import random

import pytest

from attestry.sources import readers, sinks
from tests.conftest import rows


def test_year_files_with_carriage_returns(spark, tmp_path):
    (tmp_path / "yob1880.txt").write_bytes(b"Mary,F,7065\r\nJohn,M,9655\r\n")
    (tmp_path / "yob1881.txt").write_bytes(b"Mary,F,6919\r\n")
    assert rows(readers.read_yearly_files(spark, str(tmp_path))) == [("John", "M", 9655, 1880), ("Mary", "F", 6919, 1881), ("Mary", "F", 7065, 1880)]


def test_labelled_files(spark, tmp_path):
    for name in ("female_cy1944_top.csv", "male_cy2014top.csv", "female_cy2018_top100.csv"):
        (tmp_path / name).write_text("Given Name,Amount,Position\nANN,3,1\n")
    got = readers.read_labelled_files(spark, str(tmp_path), "given_name STRING, amount INT, position INT", {
        "sex": (readers.SEX_IN_FILE, "string"), "year": (readers.YEAR_IN_FILE, "int")})
    assert rows(got, "sex", "year", "given_name") == [("female", 1944, "ANN"), ("female", 2018, "ANN"), ("male", 2014, "ANN")]


def test_year_at_the_end_of_the_name(spark, tmp_path):
    (tmp_path / "top-100-names-2006.csv").write_text("Girl,Count\nANN,3\n")
    got = readers.read_labelled_files(spark, str(tmp_path), "girl STRING, count INT", {"year": (readers.YEAR_AT_END, "int")})
    assert rows(got) == [("ANN", 3, 2006)]


@pytest.mark.parametrize("skip", [0, 2])
def test_null_token_and_preamble(spark, tmp_path, skip):
    (tmp_path / "births.txt").write_text("Births by sex\nnote\n" * (skip // 2) + "year\tmale\tfemale\ttotal\n1954\t..\t..\t54055\n1971\t33\t31\t64\n")
    got = readers.read_delimited(spark, str(tmp_path / "births.txt"), "year INT, male INT, female INT, total INT", "\t", "..", skip=skip)
    assert rows(got) == [(1954, None, None, 54055), (1971, 33, 31, 64)]


def test_cell_range(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("Top names\n\nGirls\nAmy,5\n\"Zoë, Ann\",4\nBoys\nBob,9\n")
    assert rows(readers.read_sheet_grid(spark, str(tmp_path), "name STRING, number INT", rows=(4, 5))) == [("Amy", 5), ("Zoë, Ann", 4)]


@pytest.mark.parametrize("per_line", [False, True])
def test_json_records(spark, tmp_path, per_line):
    text = '{"popular_baby_names":[{"name":"ANN","count":3},{"name":"BOB","count":2}]}'
    (tmp_path / "a.json").write_text(text if per_line else text.replace("[", "[\n"))
    got = readers.read_json_records(spark, str(tmp_path), "popular_baby_names", "name STRING, count INT", per_line)
    assert rows(got) == [("ANN", 3), ("BOB", 2)]


def test_export_versions_and_quotes(spark, tmp_path):
    for v in (3, 4):
        (tmp_path / f"v{v}").mkdir()
        (tmp_path / f"v{v}" / "task.csv").write_text('Participant Private ID,Spreadsheet: name,Response\n7,Ann,"said ""hi"", left"\n')
    got = readers.read_experiment_export(spark, {v: str(tmp_path / f"v{v}") for v in (3, 4)},
                                         ["Participant Private ID", "Spreadsheet: name", "Response"])
    assert got.columns == ["participant_private_id", "spreadsheet_name", "response", "version"]
    assert rows(got) == [("7", "Ann", 'said "hi", left', 3), ("7", "Ann", 'said "hi", left', 4)]


def test_dated_csv_without_derived_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2)], "id int, text string, derived int")
    path = sinks.write_dataset(df, str(tmp_path), ["derived"], dt.date(2021, 2, 14), "csv")
    assert path.endswith("2021-02-14_data")
    assert rows(readers.read_delimited(spark, path, "id INT, text STRING")) == [(1, "a")]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_dataset(df, str(tmp_path), ["derived"], dt.date(2021, 2, 14), "csv")


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "female_cy1944_top.csv").write_text("Amount,Note,Given Name\n5,x,ANN\n?,y,BEA\n")
    got = readers.read_labelled_files(spark, str(tmp_path), "given_name STRING, amount INT", {"year": (readers.YEAR_IN_FILE, "int")})
    assert rows(got) == [("ANN", 5, 1944), ("BEA", None, 1944)]
    export = readers.read_experiment_export(spark, {1: str(tmp_path)}, ["Given Name", "Amount"])
    assert rows(export) == [("ANN", "5", 1), ("BEA", "?", 1)]
    with pytest.raises(ValueError, match="no column position"):
        readers.read_labelled_files(spark, str(tmp_path), "given_name STRING, position INT", {})
    (tmp_path / "male_cy1944_top.csv").write_text("Given Name,Note,Amount\nBOB,x,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_labelled_files(spark, str(tmp_path), "given_name STRING, amount INT", {}).collect()


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('note "with\nbreak"\nname,number\n"Zoë\nAnn",4\nBob,9\n')
    assert rows(readers.read_sheet_grid(spark, str(tmp_path / "sheet.csv"), "name STRING, number INT", skip=1, header=True)) == [("Bob", 9), ("Zoë\nAnn", 4)]


def whole_file_records(text):
    """Records of a text read from end to end."""
    out, line, inside = [], "", False
    for piece in text.split("\n"):
        line = f"{line}\n{piece}" if inside else piece
        inside ^= piece.count('"') % 2 == 1
        if not inside:
            out.append(line)
    return [*out, line] if inside else out[:-1] if text.endswith("\n") else out


@pytest.mark.parametrize("split", ["16", "61", "100000"])
def test_records_of_several_splits(spark, tmp_path, split):
    """Quoted breaks at split borders, records longer than a split, an open quote at the end, empty lines and empty files."""
    rng = random.Random(5)
    texts = {"empty.csv": "", "open.csv": 'a,b\n"never\nclosed,\n1', "one.csv": "x" * 300, "wide.csv": 'k,"' + "\n".join("ab" for _ in range(200)) + '"\nlast,1\n'}
    for n in range(3):
        cells = ['"' + "".join(rng.choice('ab\n\r,') for _ in range(rng.randrange(40))) + '"' if rng.random() < 0.4 else "z" * rng.randrange(9) for _ in range(120)]
        texts[f"many{n}.csv"] = "".join(c + rng.choice([",", "\n", "\r\n", ',""""\n']) for c in cells) + "\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = readers.read_records(spark, str(tmp_path))
        got = {}
        for r in frame.collect():
            got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r["at"], r.line))
    finally:
        for key in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(f"spark.sql.{key}")
    want = {name: list(enumerate(whole_file_records(text))) for name, text in texts.items() if text}
    assert {name: sorted(v) for name, v in got.items()} == want
    preamble = readers.read_sheet_grid(spark, str(tmp_path / "wide.csv"), "name STRING, text STRING", skip=0)
    assert rows(preamble) == [("k", "\n".join("ab" for _ in range(200))), ("last", "1")]
