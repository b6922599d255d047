"""Golden checks: dialog tables rebuilt from the published monthly counts must
reproduce the published funnels, reports and class roll-ups."""

import pytest
from pyspark.sql import functions as F

from dialogscope import constants as K
from dialogscope.operators import classes, funnel, report

from .golden import (CLASSES, CONVERSION, MATCHING_FUNNEL, MONTHS, POST_FUNNEL, STAGE1, STAGE1_PCT, STAGE2,
                     SUBJECT_SUMS, TOTAL, UNINTERRUPTED)

STAGE2_ORDER = [K.POST_SOLVED, K.POST_SAW_FINAL, K.POST_AFTER_STEP1, K.POST_AFTER_PLAN]


def month_dialogs(spark, month):
    """One row per dialog with (status, status_post) expanded from counts."""
    rows = []
    for tag, n in zip(K.STAGE1_REPORT_TAGS, STAGE1[month]):
        if tag != K.TAG_SUCCESS:
            rows.append((tag, None, n))
    success = STAGE1[month][0]
    listed = 0
    for tag, (n, _, _) in zip(STAGE2_ORDER, STAGE2[month]):
        rows.append((K.TAG_SUCCESS, tag, n))
        listed += n
    rows.append((K.TAG_SUCCESS, K.POST_AFTER_STEP2, success - listed))
    counts = spark.createDataFrame(rows, "status string, status_post string, n int")
    return (counts.where("n > 0").select("status", "status_post", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
            .withColumn("month", F.lit(month)))


@pytest.fixture(scope="module")
def dialogs(spark):
    df = None
    for m in MONTHS:
        d = month_dialogs(spark, m)
        df = d if df is None else df.unionByName(d)
    return df.cache()


@pytest.mark.parametrize("month", MONTHS)
def test_totals(dialogs, month):
    d = dialogs.where(F.col("month") == month)
    assert d.count() == TOTAL[month]
    assert d.where(F.col("status") != K.TAG_EMPTY).count() == UNINTERRUPTED[month]


@pytest.mark.parametrize("month", MONTHS)
def test_matching_funnel(dialogs, month):
    rows = funnel.matching_funnel(dialogs.where(F.col("month") == month)).orderBy("stage_no").collect()
    counts, last_drop = MATCHING_FUNNEL[month]
    assert [r.n_dialogs for r in rows] == counts
    assert rows[-1].n_drop == last_drop
    assert [r.n_drop for r in rows[1:-1]] == [-c for c in STAGE1[month][1:5]] + [-STAGE1[month][6]]
    assert rows[0].n_drop == 0


@pytest.mark.parametrize("month", MONTHS)
def test_post_funnel(dialogs, month):
    rows = funnel.post_funnel(dialogs.where(F.col("month") == month)).orderBy("stage_no").collect()
    assert [r.n_dialogs for r in rows] == POST_FUNNEL[month]
    assert rows[-1].n_drop == 0  # nobody is left between "saw final" and "solved"


@pytest.mark.parametrize("month", MONTHS)
def test_report_sections(dialogs, month):
    d = dialogs.where(F.col("month") == month)
    s1 = report.stage1_report(d).orderBy("line_no").collect()
    assert [r.n_dialogs for r in s1] == STAGE1[month] + [UNINTERRUPTED[month]]
    assert [r.pct_1 for r in s1] == STAGE1_PCT[month] + [100.0]
    assert s1[-1].tag == K.REPORT_RULE
    s2 = report.stage2_report(d).orderBy("line_no").collect()
    assert [(r.n_dialogs, r.pct_1, r.pct_2) for r in s2[:-1]] == STAGE2[month]
    assert (s2[-1].tag, s2[-1].n_dialogs) == (K.REPORT_STAGE2_TOTAL, STAGE1[month][0])
    conv = report.conversion_report(d).orderBy("line_no").collect()
    assert [(r.n_dialogs, r.pct_1) for r in conv] == CONVERSION[month]


def test_full_report_by_month_matches_sections(dialogs):
    full = report.full_report(dialogs, by="month")
    assert full.count() == 4 * (9 + 5 + 4)
    jan = full.where("month = 'jan' AND section = 'conversion'").orderBy("line_no").collect()
    assert [(r.n_dialogs, r.pct_1) for r in jan] == CONVERSION["jan"]


def test_funnel_text(dialogs):
    rows = funnel.with_funnel_text(funnel.matching_funnel(dialogs.where("month = 'jan'"))) \
        .orderBy("stage_no").collect()
    assert rows[0].text == "2,084"
    assert rows[1].text == "2,080 -4"
    assert rows[-1].text == "1,623 -166"


def test_post_rate(dialogs):
    r = funnel.post_funnel_rate(dialogs.where("month = 'apr'")).first()
    assert (r.total_success, r.solved, r.solved_pct) == (2158, 281, 13.0)


@pytest.mark.parametrize("month", sorted(CLASSES))
def test_class_rollups(spark, month):
    cs = spark.createDataFrame(CLASSES[month], "grade long, subject string, pupils long")
    sums = {r.subject: r.pupils for r in classes.subject_totals(cs).collect()}
    assert sums == SUBJECT_SUMS[month]
    shares = {r.subject: r.share_pct for r in classes.subject_totals(cs).collect()}
    assert abs(sum(shares.values()) - 100.0) < 0.5
    bars = classes.grade_totals(cs).collect()
    assert [r.grade for r in bars] == sorted(r.grade for r in bars)
    assert sum(r.pupils for r in bars) == sum(SUBJECT_SUMS[month].values())
