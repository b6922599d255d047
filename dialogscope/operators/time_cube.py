"""Session-time statistics under any filter, without a rescan (A-8).

``build`` keeps, for every combination of the dimensions, counts and sums of the measures and a mergeable KLL sketch of the session seconds.
``stats`` merges the cells that pass a filter: counts and means are those of the rows themselves, the median
comes from the merged sketch.  Merging sketches keeps the rank error of one sketch over all rows: at most ``rank_bound(k)`` of
the rows, with 99 % confidence.

Cells are partial aggregates, so a month that holds a third of all rows is reduced where its rows are.  A cell takes some 25 KB
at k = 1600 however many rows it stands for.  Null and NaN values count for no measure; null dimension values are cells of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import minutes
from .filters import require

SKETCH_K = 1600
SECONDS = "session_seconds"
MESSAGES = {"pupil_msgs": "mean_pupil_msgs", "tutor_msgs": "mean_tutor_msgs"}


def rank_bound(k: int) -> float:
    """The sketch's promise: the share of rows by which a rank is off at most, with 99 % confidence.

    The two numbers are fixed values, fitted by the sketch's authors.
    """
    return 2.296 / k ** 0.9021


def _number(col: str) -> Column:
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def build(df: DataFrame, dims: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """The cube: ``dims``, n_rows, and per measure its count and sum, with the sketch of the seconds."""
    require(df, *dims, SECONDS)
    measures = [SECONDS, *[c for c in MESSAGES if c in df.columns]]
    parts = [part for c in measures for part in (F.count(_number(c)).alias(f"n_{c}"), F.sum(_number(c)).alias(f"sum_{c}"))]
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"), *parts, F.kll_sketch_agg_double(_number(SECONDS), F.lit(k)).alias("sketch"))


def merged(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cube's cells put together by fewer dimensions: a cube again."""
    sums = [F.sum(c).alias(c) for c in cube.columns if c.startswith(("n_", "sum_"))]
    return cube.groupBy(*by).agg(*sums, F.kll_merge_agg_double("sketch").alias("sketch"))


def stats(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, n, mean_minutes, median_seconds, median_minutes and the mean numbers of messages, of the cells of ``cube`` (filter it first)."""
    cells = merged(cube, by)
    mean = lambda c: F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}"))
    median = F.when(F.col(f"n_{SECONDS}") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))
    cells = cells.withColumn("median_seconds", median)
    messages = [F.bround(mean(c), 1).alias(name) for c, name in MESSAGES.items() if f"sum_{c}" in cube.columns]
    return cells.select(*by, F.col("n_rows").alias("n"), minutes(mean(SECONDS)).alias("mean_minutes"), "median_seconds",
                        minutes("median_seconds").alias("median_minutes"), *messages)


def rank_errors(df: DataFrame, answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, rank_error: the share of rows by which ``median_seconds`` of ``answers`` is off the middle rank of the rows of ``df``.

    The few answers are joined to the rows (equal keys, null-safe), whose counts are partial aggregates again.
    """
    v = _number(SECONDS)
    known = answers.select(*[F.col(c).alias(f"_{c}") for c in by], "median_seconds")
    same = [df[c].eqNullSafe(known[f"_{c}"]) for c in by]
    met = df.select(*by, SECONDS).join(known, same)
    counts = met.groupBy(*by, "median_seconds").agg(F.count(v).alias("n"), F.count_if(v < F.col("median_seconds")).alias("below"),
                                                    F.count_if(v <= F.col("median_seconds")).alias("upto"))
    off = F.greatest(F.lit(0.0), F.try_divide("below", "n") - 0.5, 0.5 - F.try_divide("upto", "n"))
    return counts.select(*by, off.alias("rank_error"))
