"""Report files as a data source: the parser's rows, and only the files of the asked months."""

import csv

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNotNull, IsNull

from dialogscope import constants as K
from dialogscope.sources import report_file
from dialogscope.sources.report_source import ReportReader, month_of, parse_lines, read_reports

from .test_sources import write_report

STAGE2, CONVERSION = ['"' + title.replace('"', '""') + '"' for title in (K.REPORT_STAGE2_TITLE, K.REPORT_CONVERSION_TITLE)]
MONTHS = ["jan", "feb", "mar", "apr"]


@pytest.fixture
def folder(tmp_path):
    for m in MONTHS:
        write_report(tmp_path / f"{m}_stats.csv", m)
    return tmp_path


def files_of(folder, *filters):
    reader = ReportReader([str(folder)])
    left = list(reader.pushFilters(list(filters)))
    return sorted(p.month or "" for p in reader.partitions()), left


def test_rows_are_the_parsers(spark, folder):
    flat = [str(folder / f"{m}_stats.csv") for m in MONTHS]
    expected = sorted(report_file.parse_report(spark, flat).collect())
    assert len(expected) == 4 * 18
    assert sorted(read_reports(spark, flat).collect()) == expected
    assert sorted(read_reports(spark, str(folder)).collect()) == expected
    assert sorted(read_reports(spark, flat + flat[:2]).collect()) == expected  # a path given twice is read once


def test_months_choose_the_files(folder):
    month = ("month",)
    assert files_of(folder) == (sorted(MONTHS), [])
    assert files_of(folder, IsNotNull(month), EqualTo(month, "feb")) == (["feb"], [])
    assert files_of(folder, In(month, ("jan", "apr", "may"))) == (["apr", "jan"], [])
    assert files_of(folder, In(month, ("jan", "apr")), EqualNullSafe(month, "apr")) == (["apr"], [])
    assert files_of(folder, IsNull(month)) == ([""], [])  # no such file: one empty partition
    other = [GreaterThan(month, "feb"), EqualTo(("section",), "stage1")]
    assert files_of(folder, *other) == (sorted(MONTHS), other)


def test_unasked_files_are_not_opened(spark, folder):
    (folder / "may_stats.csv").write_bytes(b"\xff\xfe\xff")  # whoever opens it gets an error
    reports = read_reports(spark, str(folder))
    two = reports.where(F.col("month").isin("jan", "mar") & (F.col("section") == "stage2"))
    assert two.rdd.getNumPartitions() == 2
    assert {(r.month, r.section) for r in two.collect()} == {("jan", "stage2"), ("mar", "stage2")}
    assert reports.where("month > 'jan' and month = 'mar'").count() == 18
    with pytest.raises(PySparkException):
        reports.where("month >= 'jan'").collect()


def test_edge_files(spark, tmp_path):
    assert read_reports(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "empty").mkdir()
    assert read_reports(spark, str(tmp_path / "empty")).count() == 0
    for name in ("month=2024-01", "month=a%3Ab c", "month=__HIVE_DEFAULT_PARTITION__", "_hidden", ".hidden"):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "part-0.csv").write_text(f"{STAGE2}\nx,5,,\n", encoding="utf-8")
    (tmp_path / "r" / "month=2024-01" / "_SUCCESS").write_text("")
    (tmp_path / "r" / "month=2024-01" / "part-1.csv").write_text("")
    rows = read_reports(spark, str(tmp_path / "r")).collect()
    assert sorted((r.month or "", r.tag, r.n_dialogs) for r in rows) == [("", "x", 5), ("2024-01", "x", 5), ("a:b c", "x", 5)]
    assert read_reports(spark, str(tmp_path / "r")).where("month is null").count() == 1


def test_lines():
    long = "w" * 300_000
    lines = ["above,1,,\n", f"{STAGE2},,,\r\n", "\n", "a, 7 ,50.5%,\n", f'"{long}, ""x""",8,100%,1e1%,more\n',
             "no count,,5%,\n", ",9,bad,%\n", "too large,99999999999999999999,,\n", f"{CONVERSION}\n", "last,-1"]
    csv.field_size_limit(2**31 - 1)
    assert list(parse_lines(lines, "m")) == [
        ("m", "stage2", 1, "a", 7, 50.5, None), ("m", "stage2", 2, f'{long}, "x"', 8, 100.0, 10.0),
        ("m", "stage2", 3, None, 9, None, None), ("m", "conversion", 1, "last", -1, None, None)]


def test_month_of():
    assert month_of("/d/month=2024-01/part.csv") == "2024-01" and month_of("/d/feb_stats.csv") == "feb"
    assert month_of("/d/other.csv") is None and month_of("/d/xfeb_stats.csv") is None
