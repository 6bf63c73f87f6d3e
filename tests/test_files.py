import datetime as dt

import pytest

from washline.errors import DataLoadError, InvalidInputError
from washline.plans.config import CleaningConfig, CleaningResult
from washline.plans.jobs import clean_file
from washline.sources.files import default_output, job_output, read_data, write_data

SMALL = """name,age,city,price
Alice,25,New York,100.50
Bob,,Los Angeles,200.75
Charlie,30,San Francisco,300.00
Alice,25,New York,100.50
David,35,Chicago,150.25
"""


@pytest.fixture
def write(tmp_path):
    def to(text, name="in.csv"):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return to


def test_types_are_inferred(spark, write):
    df = read_data(spark, write(SMALL))
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("city", "string"), ("price", "double")]
    assert df.count() == 5 and df.where("age is null").count() == 1


def test_tokens_flags_and_empty_columns(spark, write):
    text = "a,b,c,d\nn/a,True,,x\n#N/A,false,,None\nNULL,TRUE,,NaN\n1e3,False,,null\n"
    df = read_data(spark, write(text))
    assert df.dtypes == [("a", "double"), ("b", "boolean"), ("c", "double"), ("d", "string")]
    assert [r.a for r in df.collect()] == [None, None, None, 1000.0]
    assert [r.d for r in df.collect()] == ["x", None, None, None]


def test_header_names(spark, write):
    df = read_data(spark, write('\ufeffa,a,"b, c",,A\n1,2,3,4,5\n'))
    assert df.columns == ["a", "a.1", "b, c", "Unnamed: 3", "A"]


def test_dates_stay_text_and_quotes_are_doubled(spark, write):
    df = read_data(spark, write('d,t\n2024-01-05,"say ""hi"", you"\n'))
    assert tuple(df.first()) == ("2024-01-05", 'say "hi", you')


def test_short_rows_are_padded_and_long_rows_refused(spark, write):
    df = read_data(spark, write("a,b\n1,2\n3\n"))
    assert [tuple(r) for r in df.collect()] == [(1, 2), (3, None)]
    with pytest.raises(DataLoadError, match="longer than the header"):
        read_data(spark, write("a,b\n1,2\n1,2,3\n"))


def test_multi_line_cells(spark, write):
    df = read_data(spark, write('a,b\n"x\ny",1\n'), multi_line=True)
    assert tuple(df.first()) == ("x\ny", 1)


def test_without_inference(spark, write):
    assert read_data(spark, write(SMALL), infer=False).dtypes[1] == ("age", "string")


def test_refusals(spark, write, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_data(spark, str(tmp_path / "nope.csv"))
    with pytest.raises(DataLoadError, match="old Excel"):
        read_data(spark, write("", "a.xls"))
    with pytest.raises(DataLoadError, match=r"\.txt; known are \.csv, \.parquet"):
        read_data(spark, write("", "a.txt"))
    with pytest.raises(DataLoadError, match="no header"):
        read_data(spark, write(""))
    with pytest.raises(DataLoadError):
        read_data(spark, write("no parquet", "bad.parquet"))
    with pytest.raises(DataLoadError):
        write_data(spark.range(1), str(tmp_path / "a.xls"))


@pytest.mark.parametrize("suffix", ["csv", "parquet", "PARQUET"])
def test_round_trip(spark, tmp_path, suffix):
    rows = [("a, \"b\"", 1, 1.5, True, dt.datetime(2024, 1, 5, 10)), (None, None, None, False, None)]
    df = spark.createDataFrame(rows, "s string, i bigint, x double, f boolean, t timestamp_ntz")
    path = str(tmp_path / f"out.{suffix}")
    write_data(df, path)
    back = read_data(spark, path)
    if suffix == "csv":
        assert back.drop("t").collect() == df.drop("t").collect()
        assert back.first().t == "2024-01-05 10:00:00"
    else:
        assert back.collect() == df.collect()


def test_single_file_and_nested_cells(spark, tmp_path):
    df = spark.sql("select 1 as a, array(1, 2) as l, named_struct('x', 1) as s").repartition(3)
    write_data(df, str(tmp_path / "o.csv"), single_file=True)
    assert len(list((tmp_path / "o.csv").glob("part-*"))) == 1
    assert tuple(read_data(spark, str(tmp_path / "o.csv")).first()) == (1, "[1,2]", '{"x":1}')


def test_paths():
    assert default_output("dir.x/table.csv") == "dir.x/table_cleaned.csv"
    assert default_output("s3a://b/t.parquet") == "s3a://b/t_cleaned.parquet"
    assert default_output("dir/table") == "dir/table_cleaned"
    assert job_output("gs://bucket/", "job1", "/out/") == "gs://bucket/out/job1/cleaned.csv"
    assert job_output("gs://bucket", "out/job1", "out") == "gs://bucket/out/job1/cleaned.csv"
    assert job_output("gs://bucket", "job1") == "gs://bucket/job1/cleaned.csv"


def test_clean_file(spark, write, tmp_path):
    result = clean_file(spark, write(SMALL))
    assert isinstance(result, CleaningResult) and result.success
    assert (result.rows, result.columns, result.duplicates_removed) == (4, 4, 1)
    back = read_data(spark, str(tmp_path / "in_cleaned.csv"))
    assert back.count() == result.rows
    target = str(tmp_path / "out.parquet")
    config = CleaningConfig(outliers="remove", normalize_cols=False, clean_text=False)
    clean_file(spark, write(SMALL), target, config)
    assert {r.name for r in read_data(spark, target).collect()} == {"Alice", "Bob", "Charlie", "David"}


def test_nothing_is_written_for_bad_input(spark, write, tmp_path):
    target = tmp_path / "out.csv"
    with pytest.raises(InvalidInputError):
        clean_file(spark, write("name,age\n"), str(target))
    with pytest.raises(FileNotFoundError):
        clean_file(spark, str(tmp_path / "nope.csv"), str(target))
    with pytest.raises(DataLoadError):
        clean_file(spark, write(SMALL), str(tmp_path / "out.xlsx"))
    assert not target.exists()


def test_bad_records_go_to_quarantine(spark, write, tmp_path):
    lines = ["a,b", "1,x", "2,y,z", "3", '4,"p,q"', '5,"p, q",', '"6', "7,,,,8", '8,"say ""hi"""', '9 " x', ""]
    path, side = write("\n".join(lines)), str(tmp_path / "side")
    df = read_data(spark, path, quarantine=side)
    assert dict(df.dtypes) == {"a": "string", "b": "string"}
    good = [("1", "x"), ("3", None), ("4", "p,q"), ("5", "p, q"), ("8", 'say "hi"'), ('9 " x', None)]
    assert sorted(df.collect()) == good
    assert sorted(r.a for r in df.select("a").collect()) == ["1", "3", "4", "5", "8", '9 " x'] and df.count() == 6
    found = {r.record: (r.reason, r.block_start) for r in spark.read.parquet(side).collect()}
    assert found == {
        "2,y,z": ("longer than the header", 0),
        '"6': ("quote not closed", 0),
        "7,,,,8": ("longer than the header", 0),
    }
    with pytest.raises(DataLoadError):  # never over an earlier quarantine
        read_data(spark, path, quarantine=side)


def test_quarantine_of_a_clean_file_is_empty(spark, write, tmp_path):
    side = str(tmp_path / "side")
    assert read_data(spark, write("a\n1\n2\n"), quarantine=side).count() == 2
    assert spark.read.parquet(side).count() == 0
    with pytest.raises(ValueError, match="multi_line"):
        read_data(spark, write("a\n1\n"), quarantine=str(tmp_path / "other"), multi_line=True)
