"""The dashboard flow end to end on a small source-shaped table set."""

import datetime as dt

import pytest

from dialogscope import constants as K
from dialogscope.config import scratch_path
from dialogscope.plans.dashboard import Dashboard

DIALOGS = ("dialog_id string, activity_dt timestamp_ntz, month string, dialog_grade bigint, dialog_role string, "
           "product_slug string, status string, status_post string, session_seconds double, pupil_msgs long, "
           "tutor_msgs long")


@pytest.fixture(scope="module")
def board(spark):
    d = dt.datetime
    dialogs = spark.createDataFrame([
        ("a", d(2026, 1, 5), "jan", 7, "pupil", "p1", K.TAG_SUCCESS, K.POST_SOLVED, 600.0, 3, 4),
        ("b", d(2026, 1, 6), "jan", 7, "pupil", "p1", K.TAG_EMPTY, None, 60.0, 1, 1),
        ("c", d(2026, 1, 6), "jan", 8, "pupil", "p2", K.TAG_SUCCESS, K.POST_AFTER_PLAN, 1200.0, 5, 6),
        ("d", d(2026, 2, 1), "feb", 7, "pupil", "p1", K.TAG_SUCCESS, None, 30.0, None, None),
    ], DIALOGS)
    skeletons = spark.createDataFrame([("a", "plan\naction\nbossaction", "x\ny"), ("c", "info 3", "z"),
                                       ("zz", "plan", "q")], "dialog_id string, skeleton string, dialog_text string")
    classes = spark.createDataFrame([(7, "Алгебра", 5), (8, "Алгебра", 3), (7, "Геометрия", 2)],
                                    "grade long, subject string, pupils long")
    return Dashboard(dialogs, skeletons, classes, grade="7", role="pupil", period=("2026-01-01", "2026-01-31"))


def test_filters_and_propagation(board):
    assert sorted(r.dialog_id for r in board.filtered.collect()) == ["a", "b"]
    assert [r.dialog_id for r in board.selected_skeletons().collect()] == ["a"]
    eff = board.filter_effect().first()
    assert (eff.kept, eff.total) == (2, 4)


def test_tabs(board):
    f = board.matching_funnel().orderBy("stage_no").collect()
    assert (f[0].n_dialogs, f[1].n_dialogs, f[-1].n_dialogs) == (2, 1, 1)
    assert board.post_rate().first().solved_pct == 100.0
    blocks = board.skeleton_blocks().orderBy("pos").collect()
    assert [(r.block_type, r.depth, r.point_label) for r in blocks] == [
        ("plan", 0, "1. 📋 План"), ("action", 1, "2. ❓ Вопрос"), ("bossaction", 2, "3. 🔧 Подсказка")]
    assert board.skeleton_search("A").first().dialog_id == "a"
    assert board.time().first().median_minutes == 5.5
    assert [r.dialog_id for r in board.top_sessions(1).collect()] == ["a"]
    assert {r.subject: r.pupils for r in board.subject_shares().collect()} == {"Алгебра": 8, "Геометрия": 2}
    conv, daily = board.comparison()
    # grade 7 and role pupil apply, the January-only period does not
    assert {r.month: (r.total, r.success) for r in conv.collect()} == {"jan": (2, 1), "feb": (1, 1)}
    assert daily.count() == 3


def test_export(spark, board):
    path = board.export(scratch_path(spark, "t-dash"), "Январь")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 2 and "analytics_Январь_" in path
