"""Readers, writers and the report-file parser on hand-made files in the
monthly layouts."""

import csv
import os

import pytest

from dialogscope import constants as K
from dialogscope.config import scratch_path
from dialogscope.operators import report
from dialogscope.sources import report_file, sinks, tables

from .golden import CLASSES, CONVERSION, STAGE1, STAGE1_PCT, STAGE2, UNINTERRUPTED


def pct_text(p):
    return "100%" if p == 100.0 else f"{p:.1f}%"


def write_report(path, month):
    """A report file laid out like the published ones (ragged 4 columns,
    quoted title with doubled quotes, quoted tag with commas)."""
    s1 = list(zip(K.STAGE1_REPORT_TAGS, STAGE1[month], STAGE1_PCT[month]))
    lines = [[K.REPORT_BANNER, "", "", ""], ["", "", "", ""], [K.REPORT_RULE, "", "", ""],
             [K.REPORT_STAGE1_TITLE, "", "", ""], K.REPORT_STAGE1_HEADER,
             [s1[0][0], str(s1[0][1]), pct_text(s1[0][2]), ""], [K.REPORT_RULE, "", "", ""]]
    lines += [[t, str(n), pct_text(p), ""] for t, n, p in s1[1:]]
    lines += [[K.REPORT_RULE, str(UNINTERRUPTED[month]), "100%", ""], [K.REPORT_STAGE2_TITLE, "", "", ""],
              K.REPORT_STAGE2_HEADER]
    lines += [[t, str(n), pct_text(a), pct_text(b)] for t, (n, a, b) in zip(K.STAGE2_REPORT_TAGS, STAGE2[month])]
    lines += [[K.REPORT_STAGE2_TOTAL, str(STAGE1[month][0]), "", ""], ["", "", "", ""],
              [K.REPORT_RULE, "", "", ""], [K.REPORT_CONVERSION_TITLE, "", "", ""], K.REPORT_CONVERSION_HEADER]
    lines += [[name, str(n), pct_text(p), ""] for name, (n, p) in zip(K.CONVERSION_STAGES, CONVERSION[month])]
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(lines)
    return lines


def test_report_file_parses_to_tidy_rows(spark, tmp_path):
    lines = write_report(tmp_path / "jan_stats.csv", "jan")
    write_report(tmp_path / "apr_stats.csv", "apr")
    assert '""' in open(tmp_path / "jan_stats.csv", encoding="utf-8").read()  # doubled quotes present
    assert len(lines) == 30
    tidy = report_file.parse_report(spark, [str(tmp_path / "jan_stats.csv"), str(tmp_path / "apr_stats.csv")])
    rows = {(r.month, r.section, r.line_no): r for r in tidy.collect()}
    assert len(rows) == 2 * (9 + 5 + 4)
    assert rows[("jan", "stage1", 6)].tag == K.TAG_COMING_SOON  # the quoted tag with commas
    assert rows[("jan", "stage1", 9)].n_dialogs == 2080 and rows[("jan", "stage1", 9)].pct_1 == 100.0
    assert rows[("jan", "stage2", 5)].tag == K.REPORT_STAGE2_TOTAL
    assert [(rows[("apr", "conversion", i)].n_dialogs, rows[("apr", "conversion", i)].pct_1)
            for i in range(1, 5)] == CONVERSION["apr"]
    assert rows[("apr", "stage2", 3)].pct_2 == 29.6


def test_report_round_trip(spark):
    df = spark.createDataFrame([("m1", K.TAG_SUCCESS, K.POST_SOLVED), ("m1", K.TAG_EMPTY, None),
                                ("m2", K.TAG_COMING_SOON, None), ("m2", None, None)],
                               "month string, status string, status_post string")
    full = report.full_report(df, by="month")
    path = sinks.write_report_files(full, scratch_path(spark, "t-report"))
    back = report_file.parse_report(spark, path).select("month", *report.REPORT_COLUMNS)
    assert sorted(back.collect()) == sorted(full.collect())


def test_read_table_flat_files_with_bom_and_missing_month(spark, tmp_path):
    with open(tmp_path / "jan_class_stats.csv", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow([K.SRC_GRADE, K.SRC_SUBJECT, K.SRC_PUPILS])
        w.writerows(CLASSES["jan"])
    df = tables.read_table(spark, str(tmp_path), "class_stats", ["Январь", "Февраль"])
    rows = tables.canonical_classes(df).collect()
    assert len(rows) == len(CLASSES["jan"])
    assert {r.month for r in rows} == {"jan"}
    assert rows[0].grade == 5 and rows[0].subject == "Математика"  # BOM gone from the first header
    none = tables.read_table(spark, str(tmp_path), "chart_data", ["Март"])
    assert none.count() == 0 and "month" in none.columns
    with pytest.raises(KeyError):
        tables.month_prefix("Май")


def test_monthly_write_and_partitioned_read(spark):
    root = scratch_path(spark, "t-monthly")
    df = spark.createDataFrame([("a", "1995-01", 'say "hi", ok\nnext'), ("b", "1995-02", None),
                                ("c", "1995-02", "x")], "dialog_id string, month string, note string")
    sinks.write_monthly(df, root, "notes")
    schema = "dialog_id string, note string"
    from pyspark.sql.types import _parse_datatype_string
    back = tables.read_table(spark, root, "notes", ["1995-02"], schema=_parse_datatype_string(schema),
                             partitioned=True, multi_line=True)
    assert sorted((r.dialog_id, r.note, r.month) for r in back.collect()) == [("b", None, "1995-02"),
                                                                              ("c", "x", "1995-02")]
    every = tables.read_table(spark, root, "notes", None, schema=_parse_datatype_string(schema), partitioned=True,
                              multi_line=True)
    assert {r.dialog_id: r.note for r in every.collect()}["a"] == 'say "hi", ok\nnext'


def test_export_csv_round_trip(spark):
    path = scratch_path(spark, "t-export")
    df = spark.createDataFrame([("a", K.TAG_COMING_SOON, 1.5), ("b", None, None)],
                               "dialog_id string, status string, v double")
    sinks.export_csv(df, path)
    assert any(p.endswith(".csv") for p in os.listdir(path.replace("file:", "")))
    back = spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(path)
    assert sorted(back.collect()) == sorted(df.collect())


def test_normalise_alias_priority(spark):
    both = spark.createDataFrame([("1", "plan", "x")], f"dialog_id string, status_only string, `{K.SRC_SKELETON_LOWER}` string")
    assert tables.normalise(both).first().skeleton == "plan"
    main = spark.createDataFrame([("1", None, "x")], f"dialog_id string, `{K.SRC_SKELETON}` string, status_only string")
    assert tables.normalise(main).first().skeleton is None  # present column wins even when null
    none = spark.createDataFrame([("1",)], "dialog_id string")
    assert tables.normalise(none).first().skeleton == ""
    assert "status_only" not in tables.normalise(both).columns


def test_canonical_dialogs_types(spark):
    df = spark.createDataFrame([("1", "2026-01-05 10:00:00", 7.0), ("2", "garbage", None), ("3", "2026-01-06", 5.0)],
                               "dialog_id string, activity_dt string, dialog_grade double")
    rows = {r.dialog_id: r for r in tables.canonical_dialogs(df).collect()}
    assert rows["1"].dialog_grade == 7 and rows["2"].activity_dt is None
    assert str(rows["3"].activity_dt) == "2026-01-06 00:00:00"
    assert dict(tables.canonical_dialogs(df).dtypes)["dialog_grade"] == "bigint"


def test_skeleton_table_with_multiline_cells(spark, tmp_path):
    from dialogscope.operators import skeleton
    rows = [["dialog_id", "status_only", K.SRC_DIALOG_TEXT, K.SRC_TAG, "dialog_grade"],
            ["x1", "plan\ninfo 2\naction", "hello\nworld\n\"quoted\", text", "t1", "7.0"],
            ["x2", "", "", "", ""]]
    with open(tmp_path / "jan_skeleton.csv", "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows(rows)
    df = tables.canonical_skeletons(tables.read_table(spark, str(tmp_path), "skeleton", ["Январь"]))
    got = {r.dialog_id: r for r in df.collect()}
    assert got["x1"].skeleton == "plan\ninfo 2\naction" and got["x1"].dialog_grade == 7
    assert got["x1"].dialog_text.endswith('"quoted", text') and got["x1"].tag == "t1"
    state = skeleton.parse_skeletons(df).orderBy("pos").collect()
    assert [(r.block_type, r.depth, r.step) for r in state] == [("plan", 0, 0), ("info", 0, 2), ("action", 1, 2)]
    ex = skeleton.block_excerpts(df).orderBy("pos").collect()
    assert ex[0].excerpt == 'hello\nworld\n"quoted", text'


def test_read_table_matches_columns_by_name_per_month(spark, tmp_path):
    with open(tmp_path / "jan_chart_data.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([["status_only", "dialog_id", "dialog_grade"], [K.TAG_SUCCESS, "a", "7.0"]])
    with open(tmp_path / "feb_chart_data.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([["dialog_id", "product_slug", "dialog_grade"], ["b", "p1", "oops"]])
    df = tables.canonical_dialogs(tables.read_table(spark, str(tmp_path), "chart_data", ["Январь", "Февраль"]))
    rows = {r.dialog_id: r for r in df.collect()}
    assert (rows["a"].status, rows["a"].dialog_grade, rows["a"].month, rows["a"].product_slug) == \
        (K.TAG_SUCCESS, 7, "jan", None)
    assert (rows["b"].status, rows["b"].dialog_grade, rows["b"].product_slug, rows["b"].month) == \
        (None, None, "p1", "feb")
