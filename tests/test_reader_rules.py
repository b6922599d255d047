"""The reader never loses or shifts rows, scratch folders stay shared, means skip NaN."""

import csv
import math

import pytest

from dialogscope import config
from dialogscope import constants as K
from dialogscope.operators import compare, metrics
from dialogscope.operators.quantile import exact_median
from dialogscope.plans.dashboard import Dashboard
from dialogscope.sources import sinks, tables

HEAD = ["dialog_id", "activity_dt", "dialog_grade", "dialog_role", "product_slug", "status_only", K.SRC_SESSION_SECONDS]


def write(path, *rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows(rows)


def test_null_words_and_nan_grades(spark, tmp_path):
    rows = [[f"d{i}", "2026-01-05", word, word, word, K.TAG_SUCCESS, word] for i, word in enumerate(tables.NULL_WORDS)]
    write(tmp_path / "jan_chart_data.csv", HEAD, *rows, ["x", "NA", "7.0", "pupil", "Nan", "", "60"])
    got = {r.dialog_id: r for r in tables.canonical_dialogs(tables.read_table(spark, str(tmp_path), "chart_data", ["jan"])).collect()}
    for i in range(len(rows)):
        r = got[f"d{i}"]
        assert r.dialog_grade is r.dialog_role is r.product_slug is r.session_seconds is None
    assert (got["x"].dialog_grade, got["x"].product_slug, got["x"].activity_dt, got["x"].status, got["x"].session_seconds) == (7, "Nan", None, None, 60)


def test_line_breaks_in_any_table(spark, tmp_path):
    write(tmp_path / "jan_chart_data.csv", HEAD, ["a", "2026-01-05", "7", 'two\nlines "q"', "p", "s", "1"], ["b", "2026-01-06", "8", "r", "p", "s", "2"])
    got = {r.dialog_id: r.dialog_role for r in tables.read_table(spark, str(tmp_path), "chart_data", ["jan"]).collect()}
    assert got == {"a": 'two\nlines "q"', "b": "r"}
    with pytest.raises(Exception, match="MALFORMED"):  # the fast mode refuses what it would have to shift
        tables.read_table(spark, str(tmp_path), "chart_data", ["jan"], multi_line=False).collect()
    write(tmp_path / "feb_chart_data.csv", HEAD, ["b", "2026-01-06", "8", "r", "p", "s", "2"])
    assert tables.read_table(spark, str(tmp_path), "chart_data", ["feb"], multi_line=False).first().dialog_role == "r"


def test_missing_files_on_any_file_system(spark, tmp_path):
    write(tmp_path / "jan_chart_data.csv", HEAD, ["a", "2026-01-05", "7", "r", "p", "s", "1"])
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        assert tables.read_table(spark, root, "chart_data", ["jan", "feb"]).count() == 1
        assert tables.read_table(spark, root, "chart_data", ["feb"]).count() == 0
        assert tables.read_table(spark, root, "chart_data", []).count() == 0
        assert tables.read_table(spark, root, "chart_data").count() == 1
        assert tables.read_table(spark, root, "chart_data", [], partitioned=True).count() == 0


def test_folders_with_different_headers_are_an_error(spark, tmp_path):
    for month, head, row in (("2026-01", ["dialog_id", "note"], ["a", "n"]), ("2026-02", ["note", "dialog_id"], ["n", "b"])):
        (tmp_path / "notes" / f"month={month}").mkdir(parents=True)
        write(tmp_path / "notes" / f"month={month}" / "part-0.csv", head, row)
    assert tables.read_table(spark, str(tmp_path), "notes", ["2026-02"], partitioned=True).first().dialog_id == "b"
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_table(spark, str(tmp_path), "notes", partitioned=True).collect()


def test_months_by_name(spark):
    df = spark.createDataFrame([("jan", 1), ("feb", 2), ("2026-03", 3), ("Апрель", 4)], "month string, n int")
    pick = lambda *m: sorted(r.n for r in compare.select_months(df, m).collect())
    assert pick("Январь", "feb") == [1, 2] and pick("2026-03", "Апрель") == [3, 4] and pick() == []
    with pytest.raises(KeyError):
        compare.select_months(df, ["Май"])


def test_scratch_folder_needs_a_shared_place_off_local_masters():
    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            config.scratch_dir(Session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert config.scratch_dir(Session(master))


def test_written_folders_are_removed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    config.remove_path(spark, f"{tmp_path}/x")
    assert not (tmp_path / "x").exists()


def test_means_skip_nan_and_absent_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(60.0, 2.0), (nan, 4.0), (120.0, None), (None, nan)], "session_seconds double, pupil_msgs double")
    assert metrics.session_stats(df).first().asDict() == {"mean_minutes": 1.5, "median_minutes": 1.5, "mean_pupil_msgs": 3.0}
    assert metrics.session_stats(df.select("pupil_msgs")).columns == ["mean_pupil_msgs"]
    with pytest.raises(KeyError, match="session_seconds"):
        metrics.session_stats(df.select(df.pupil_msgs.alias("other")))
    k = metrics.kpis(df.selectExpr("session_seconds", "'x' as status")).first()
    assert (k.total, k.mean_minutes) == (4, 1.5)
    cards = {r.metric: r["mean"] for r in metrics.metric_cards(sinks.with_source_names(df)).collect()}
    assert cards == {K.SRC_SESSION_SECONDS: 90.0, K.SRC_PUPIL_MSGS: 3.0}
    inf = spark.createDataFrame([(math.inf,), (math.inf,), (1.0,), (math.inf,)], "v double")
    assert exact_median(inf, "v") == math.inf


def test_approximate_median_keeps_its_promise(spark):
    df = spark.range(10_001).selectExpr("cast(id as double) as v")
    for accuracy in (100, 10_000):
        r = metrics.rank_error(df, "v", metrics.approx_median(df, "v", accuracy)).first()
        assert r.n == 10_001 and r.rank_error <= r.n / accuracy + 1
    assert metrics.rank_error(df, "v", 0.0).first().rank_error > 4_000


def test_default_period_and_export_headers(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-05 10:00:00", K.TAG_SUCCESS, 60.0), ("b", None, K.TAG_EMPTY, 30.0)],
                               "dialog_id string, activity_dt string, status string, session_seconds double")
    d = tables.canonical_dialogs(df)
    board = Dashboard(d)
    assert [r.dialog_id for r in board.filtered.collect()] == ["a"]
    assert Dashboard(d.where("dialog_id = 'b'")).filtered.count() == 1  # no date at all: nothing to bound
    path = board.export(str(tmp_path), "jan")
    back = tables.canonical_dialogs(spark.read.option("header", True).csv(path)).first()
    assert (back.dialog_id, back.status, str(back.activity_dt)) == ("a", K.TAG_SUCCESS, "2026-01-05 10:00:00")
