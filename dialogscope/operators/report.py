"""The sectioned tag report (A-15 … A-17).

Denominators, as printed in the monthly report files:

* stage 1 — every tag as % of *uninterrupted* dialogs (total − "nothing
  entered"), the "nothing entered" row included; the section total row is
  the uninterrupted count at 100 %;
* stage 2 — every post tag as % of successful matches and as % of *all*
  dialogs; the total row is the success count;
* conversion — total (100 %), uninterrupted (÷ total), success and solved
  (÷ uninterrupted, despite the "% of start" header).

All three sections come from ONE global aggregate of conditional counts (one
row per task crosses the shuffle); the rows are laid out with ``inline``.
Percentages are rounded half-even to 1 dp like the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import pct

REPORT_COLUMNS = ["section", "line_no", "tag", "n_dialogs", "pct_1", "pct_2"]


def report_counts(df: DataFrame, by: str | None = None, status_col: str = "status",
                  post_col: str = "status_post") -> DataFrame:
    """One row (per ``by`` group): total, uninterrupted, success and a count
    per report tag."""
    s1 = [F.count_if(F.col(status_col) == t).alias(f"s1_{i}") for i, t in enumerate(K.STAGE1_REPORT_TAGS)]
    succ = F.col(status_col) == K.TAG_SUCCESS
    s2 = [F.count_if(succ & (F.col(post_col) == t)).alias(f"s2_{i}")
          for i, t in enumerate(K.STAGE2_REPORT_TAGS)]
    keys = [by] if by else []
    return (df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(succ).alias("success"),
                 F.count_if(F.col(status_col) == K.TAG_EMPTY).alias("empty"), *s1, *s2)
            .withColumn("uninterrupted", F.col("total") - F.col("empty")))


def _row(section: str, line_no: int, tag, n, p1=None, p2=None):
    return F.struct(F.lit(section).alias("section"), F.lit(line_no).alias("line_no"),
                    F.lit(tag).cast("string").alias("tag"), n.cast("bigint").alias("n_dialogs"),
                    (p1 if p1 is not None else F.lit(None)).cast("double").alias("pct_1"),
                    (p2 if p2 is not None else F.lit(None)).cast("double").alias("pct_2"))


def stage1_rows(c=F.col):
    rows = []
    for i, t in enumerate(K.STAGE1_REPORT_TAGS):
        rows.append(_row("stage1", i + 1, t, c(f"s1_{i}"), pct(c(f"s1_{i}"), c("uninterrupted"))))
    rows.append(_row("stage1", len(rows) + 1, K.REPORT_RULE, c("uninterrupted"), F.lit(100.0)))
    return rows


def stage2_rows(c=F.col):
    rows = []
    for i, t in enumerate(K.STAGE2_REPORT_TAGS):
        rows.append(_row("stage2", i + 1, t, c(f"s2_{i}"), pct(c(f"s2_{i}"), c("success")),
                         pct(c(f"s2_{i}"), c("total"))))
    rows.append(_row("stage2", len(rows) + 1, K.REPORT_STAGE2_TOTAL, c("success")))
    return rows


def conversion_rows(c=F.col):
    total, unint = c("total"), c("uninterrupted")
    solved = c(f"s2_{K.STAGE2_REPORT_TAGS.index(K.POST_SOLVED)}")
    vals = [(total, F.lit(100.0)), (unint, pct(unint, total)), (c("success"), pct(c("success"), unint)),
            (solved, pct(solved, unint))]
    return [_row("conversion", i + 1, name, n, p) for i, (name, (n, p)) in
            enumerate(zip(K.CONVERSION_STAGES, vals))]


def _layout(df: DataFrame, rows_fn, **kw) -> DataFrame:
    return report_counts(df, **kw).select(F.inline(F.array(*rows_fn())))


def stage1_report(df: DataFrame, **kw) -> DataFrame:
    """A-15: tag, count, % of uninterrupted dialogs (+ the total row)."""
    return _layout(df, stage1_rows, **kw)


def stage2_report(df: DataFrame, **kw) -> DataFrame:
    """A-16: post tag, count, % of successes, % of all dialogs (+ ИТОГО)."""
    return _layout(df, stage2_rows, **kw)


def conversion_report(df: DataFrame, **kw) -> DataFrame:
    """A-17: total → uninterrupted → success → solved."""
    return _layout(df, conversion_rows, **kw)


def full_report(df: DataFrame, by: str | None = None, **kw) -> DataFrame:
    """All three sections from one aggregate; per ``by`` group (e.g. month)."""
    rows = stage1_rows() + stage2_rows() + conversion_rows()
    keys = [by] if by else []
    return report_counts(df, by=by, **kw).select(*keys, F.inline(F.array(*rows)))
