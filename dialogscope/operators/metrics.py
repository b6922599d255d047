"""Counts over time, headline KPIs, session statistics and top-k
(A-6 … A-8, A-12 … A-14, T-2, J-2, J-3).

Every function is one grouped or global aggregate: partial aggregation on the
map side means a hot day or month costs one row per task in the shuffle, never
a skewed partition.  Where the dashboard joined two grouped series (daily
totals ⟕ daily successes, monthly successes ÷ monthly totals) the join is
replaced by conditional counts in the same aggregate.

Deliberate deviations:

* A-12: a month without any success yields 0 and 0.0 % (the dashboard fails
  on the mismatched series lengths).
* T-2: ties in session time are broken by ``dialog_id`` (a Spark table has no
  file order); null times sort last.
* T-5: months sort by calendar (prefixes by their month number, ``yyyy-MM``
  as text), not by their names.  The grouped results are small, so the
  final sort costs one exchange of a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import as_date, minutes, pct, prefix
from .filters import require
from .quantile import exact_median


def _success(status_col: str = "status"):
    return F.col(status_col) == K.TAG_SUCCESS


def mean(col: str) -> Column:
    """The mean of the values that are numbers (null and NaN are skipped, as the median skips them)."""
    return F.avg(F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")))


def month_order(month_col: str = "month"):
    """T-5: calendar order for month prefixes (``jan`` < ``feb`` …); other
    values (``yyyy-MM``) sort as text, which is calendar order too."""
    expr = None
    for no, prefix in enumerate(K.MONTH_PREFIX.values(), start=1):
        cond = F.col(month_col) == prefix
        expr = F.when(cond, F.lit(no)) if expr is None else expr.when(cond, F.lit(no))
    return [expr, F.col(month_col)]


def daily_counts(df: DataFrame, dt_col: str = "activity_dt", status_col: str = "status") -> DataFrame:
    """A-6/J-2: per day, all dialogs and successful ones (0 when none).

    Rows whose date is null are dropped (a pandas group key never is null).
    """
    return (df.where(F.col(dt_col).isNotNull())
            .groupBy(as_date(dt_col).alias("date"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(_success(status_col)).alias("success"))
            .orderBy("date"))


def kpis(df: DataFrame, status_col: str = "status", seconds_col: str = "session_seconds") -> DataFrame:
    """A-7: total, successes, success share (%), mean session minutes."""
    require(df, status_col, seconds_col)
    agg = df.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(_success(status_col)).alias("success"),
                 mean(seconds_col).alias("_mean_s"))
    return agg.select("total", "success", pct("success", "total").alias("success_pct"),
                      minutes("_mean_s").alias("mean_minutes"))


def session_stats(df: DataFrame, seconds_col: str = "session_seconds", pupil_col: str = "pupil_msgs",
                  tutor_col: str = "tutor_msgs", approx: bool = False, accuracy: int = 10000,
                  seconds: DataFrame | None = None) -> DataFrame:
    """A-8: mean and median session minutes, mean pupil / tutor messages - each for a column that is there.

    The means are one lazy aggregate.  The median is computed when this is called: exactly, by the
    distributed passes of ``quantile.exact_median`` over the one column it needs, or with
    ``percentile_approx`` (rank error at most n/accuracy).  ``seconds`` is a frame of that column alone, for
    callers whose ``df`` joins other tables for the messages; by default the column is taken from ``df``.
    """
    out = []
    if seconds_col in df.columns:
        values = (df if seconds is None else seconds).select(seconds_col)
        median = approx_median(values, seconds_col, accuracy) if approx else exact_median(values, seconds_col)
        out += [minutes(mean(seconds_col)).alias("mean_minutes"), minutes(F.lit(median).cast("double")).alias("median_minutes")]
    out += [F.bround(mean(c), 1).alias(name) for c, name in ((pupil_col, "mean_pupil_msgs"), (tutor_col, "mean_tutor_msgs"))
            if c in df.columns]
    if not out:
        require(df, seconds_col)
    return df.agg(*out)


def approx_median(df: DataFrame, col: str, accuracy: int = 10000) -> float | None:
    """A value whose rank is at most n/accuracy from the middle."""
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    return df.agg(F.percentile_approx(value, 0.5, accuracy)).first()[0]


def rank_error(df: DataFrame, col: str, value: float | None) -> DataFrame:
    """One row: n values, and how far the ranks of ``value`` lie from the middle rank (0 where they include it)."""
    v = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    below, upto = F.count_if(v < F.lit(value)), F.count_if(v <= F.lit(value))
    middle = F.count(v) / 2
    return df.agg(F.count(v).alias("n"), F.greatest(F.lit(0.0), below - middle, middle - upto).alias("rank_error"))


def top_sessions(df: DataFrame, k: int = 20, seconds_col: str = "session_seconds") -> DataFrame:
    """T-2: the ``k`` longest sessions with display prefixes.

    Planned as ``TakeOrderedAndProject``: every task keeps its own top ``k``,
    only k rows per task reach the final merge.
    """
    return (df.orderBy(F.col(seconds_col).desc_nulls_last(), F.col("dialog_id").asc())
            .limit(k)
            .select("dialog_id", F.col(seconds_col).alias("session_seconds"),
                    minutes(seconds_col).alias("minutes"), "dialog_grade",
                    prefix("dialog_role", 10).alias("role_10"),
                    prefix("product_slug", 10).alias("product_10")))


def period_bounds(df: DataFrame, dt_col: str = "activity_dt") -> DataFrame:
    """A-14: first and last day with activity (the default period)."""
    return df.agg(F.min(as_date(dt_col)).alias("min_date"), F.max(as_date(dt_col)).alias("max_date"))


def monthly_conversion(df: DataFrame, month_col: str = "month", status_col: str = "status") -> DataFrame:
    """A-12/J-3/T-5: per month total, successes and conversion % (1 dp)."""
    return (df.where(F.col(month_col).isNotNull())
            .groupBy(month_col)
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(_success(status_col)).alias("success"))
            .select(F.col(month_col).alias("month"), "total", "success",
                    pct("success", "total").alias("conversion_pct"))
            .orderBy(*month_order("month")))


def monthly_daily_counts(df: DataFrame, month_col: str = "month", dt_col: str = "activity_dt") -> DataFrame:
    """A-13: dialogs per (month, day)."""
    return (df.where(F.col(month_col).isNotNull() & F.col(dt_col).isNotNull())
            .groupBy(F.col(month_col).alias("month"), as_date(dt_col).alias("date"))
            .agg(F.count(F.lit(1)).alias("n_dialogs"))
            .orderBy(*month_order("month"), "date"))


def metric_columns(df: DataFrame, parts=tuple(K.METRIC_NAME_PARTS)) -> list[str]:
    """P-10: metric columns discovered by name substring (schema-time only)."""
    return [c for c in df.columns if any(p in c for p in parts)]


def metric_cards(df: DataFrame) -> DataFrame:
    """A-8/P-10: (metric, mean) of every metric column the table has, in one pass."""
    cols = metric_columns(df)
    require(df, *(cols or ["a metric column"]))
    means = df.agg(*[F.bround(mean(f"`{c}`"), 1).alias(f"m{i}") for i, c in enumerate(cols)])
    return means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(cols)])))
