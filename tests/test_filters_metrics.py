"""Edge rows: null tags and dates, ties at the top-k cut, a month without
success, filters that select nothing, search and facet semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dialogscope import constants as K
from dialogscope.operators import browse, compare, filters, funnel, metrics

SCHEMA = ("dialog_id string, activity_dt timestamp_ntz, month string, dialog_grade bigint, dialog_role string, "
          "product_slug string, status string, session_seconds double")


@pytest.fixture(scope="module")
def edge(spark):
    d = dt.datetime
    rows = [
        ("a1", d(2026, 1, 1, 9), "2026-01", 7, "pupil", "p1", K.TAG_SUCCESS, 600.0),
        ("a2", d(2026, 1, 1, 23), "2026-01", 7, "pupil", None, None, 600.0),
        ("a3", None, "2026-01", None, "teacher", "p2", K.TAG_EMPTY, None),
        ("a4", d(2026, 1, 3), "2026-01", 5, None, "p1", K.TAG_MATCH_FAILED, 1200.0),
        ("b1", d(2026, 2, 2), "2026-02", 9, "pupil", "p1", K.TAG_TASK, 30.0),
        ("b2", d(2026, 2, 2), "2026-02", 9, "pupil", "p1", K.TAG_TASK, 1200.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_null_status_lands_in_residual(edge):
    rows = funnel.matching_funnel(edge).orderBy("stage_no").collect()
    assert rows[0].n_dialogs == 6
    # survivors after all steps: 6 - 1 empty - 2 task = 3; success 1 -> residual 2 (null + failed)
    assert (rows[-1].n_dialogs, rows[-1].n_drop) == (1, -2)


def test_month_without_success(edge):
    rows = {r.month: r for r in metrics.monthly_conversion(edge).collect()}
    assert (rows["2026-02"].success, rows["2026-02"].conversion_pct) == (0, 0.0)
    assert rows["2026-01"].conversion_pct == 25.0


def test_daily_counts_drop_null_dates(edge):
    rows = {r.date: (r.total, r.success) for r in metrics.daily_counts(edge).collect()}
    assert rows == {dt.date(2026, 1, 1): (2, 1), dt.date(2026, 1, 3): (1, 0), dt.date(2026, 2, 2): (2, 0)}


def test_top_sessions_ties_and_nulls(edge):
    rows = metrics.top_sessions(edge, k=4).collect()
    assert [r.dialog_id for r in rows] == ["a4", "b2", "a1", "a2"]  # ties broken by id, null last
    assert rows[0].minutes == 20.0
    everything = metrics.top_sessions(edge, k=10).collect()
    assert everything[-1].dialog_id == "a3" and everything[-1].session_seconds is None


def test_filters(edge):
    assert filters.apply_filters(edge, grade="7.0").count() == 2
    assert filters.apply_filters(edge, grade=K.ALL, role=K.ALL).count() == 6
    assert filters.apply_filters(edge, period=("2026-01-01", "2026-01-01")).count() == 2  # whole last day
    assert filters.apply_filters(edge, role="nobody").count() == 0
    assert filters.apply_filters(edge.drop("product_slug"), product="p1").count() == 6  # absent column: skipped
    eff = filters.filter_effect(edge, grade=7, period=("2026-01-01", "2026-01-31")).first()
    assert (eff.kept, eff.total, eff.kept_pct) == (2, 6, 33.3)
    assert eff.filters == "grade=7, period=2026-01-01..2026-01-31"


def test_empty_selection_funnel(edge):
    none = filters.apply_filters(edge, role="nobody")
    rows = funnel.matching_funnel(none).collect()
    assert all(r.n_dialogs == 0 and r.n_drop == 0 for r in rows)


def test_facets_and_search(edge):
    grades = [r.value for r in filters.facet_values(edge, "dialog_grade").collect()]
    assert grades == [5, 7, 9]  # numeric order, nulls dropped
    assert filters.search_dialog(edge, "A").first().dialog_id == "a1"  # case-insensitive, smallest id
    assert filters.search_dialog(edge, "a[34]", regex=True, first=False).count() == 2
    assert filters.search_dialog(edge, "a[34]").count() == 0  # literal by default
    assert filters.search_dialog(edge, "").count() == 0


def test_semi_join(spark, edge):
    sk = spark.createDataFrame([("a1", "plan"), ("zz", "plan")], "dialog_id string, skeleton string")
    kept = filters.apply_filters(edge, grade=7)
    assert [r.dialog_id for r in filters.skeletons_for(sk, kept).collect()] == ["a1"]
    nothing = filters.apply_filters(edge, role="nobody")
    assert filters.skeletons_for(sk, nothing).count() == 0
    assert filters.skeletons_for(sk, nothing, empty_means_all=True).count() == 2


def test_require_and_available(edge):
    with pytest.raises(KeyError):
        filters.require(edge, "dialog_id", "missing")
    assert filters.available(edge, ["missing", "status", "dialog_id"]) == ["status", "dialog_id"]
    assert metrics.metric_columns(edge.withColumnRenamed("session_seconds", K.SRC_SESSION_SECONDS)) == \
        [K.SRC_SESSION_SECONDS]


def test_kpis_and_stats(edge):
    k = metrics.kpis(edge).first()
    assert (k.total, k.success, k.success_pct) == (6, 1, 16.7)
    s = metrics.session_stats(edge.withColumn("pupil_msgs", F.lit(2)).withColumn("tutor_msgs", F.lit(None)
                                                                                 .cast("long"))).first()
    assert s.median_minutes == 10.0 and s.mean_pupil_msgs == 2.0 and s.mean_tutor_msgs is None


def test_union_months(spark):
    a = spark.createDataFrame([("x", 1)], "dialog_id string, v int")
    b = spark.createDataFrame([("y", "p")], "dialog_id string, product_slug string")
    u = compare.union_months({"jan": a, "feb": b})
    rows = {r.dialog_id: r for r in u.collect()}
    assert rows["x"].month == "jan" and rows["x"].product_slug is None and rows["y"].v is None
    assert compare.union_months({}) is None


def test_dialog_options_and_browse(spark):
    sk = spark.createDataFrame([("d2", "plan", "t", 7, None), ("d1", "info", None, None, "pupil")],
                               "dialog_id string, skeleton string, tag string, dialog_grade bigint, "
                               "dialog_role string")
    opts = {r.label: r.dialog_id for r in browse.dialog_options(sk).collect()}
    assert opts == {"d2... | t | 7 кл.": "d2", "d1... | pupil": "d1"}
    assert [r.dialog_id for r in browse.browse_skeletons(sk, 1).collect()] == ["d1"]


def test_month_calendar_order(spark):
    df = spark.createDataFrame([(m, K.TAG_SUCCESS) for m in ["mar", "jan", "apr", "feb", "jan"]],
                               "month string, status string")
    assert [r.month for r in metrics.monthly_conversion(df).collect()] == ["jan", "feb", "mar", "apr"]
