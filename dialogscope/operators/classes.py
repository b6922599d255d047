"""Class / subject roll-ups over the pre-aggregated class table (A-9 … A-11, T-1).

The share of total uses a grouped sum followed by a whole-result window: the
window runs over the (small, one row per subject) aggregate, never over the
input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subject_totals(class_stats: DataFrame, subject_col: str = "subject",
                   pupils_col: str = "pupils") -> DataFrame:
    """A-9/A-10: pupils per subject and their share of all pupils (%, 1 dp)."""
    sums = (class_stats.where(F.col(subject_col).isNotNull())
            .groupBy(F.col(subject_col).alias("subject"))
            .agg(F.sum(pupils_col).cast("bigint").alias("pupils")))
    total = F.sum("pupils").over(Window.partitionBy())
    return sums.select("subject", "pupils",
                       F.bround(F.try_divide(F.col("pupils") * 100.0, total), 1).alias("share_pct"))


def grade_totals(class_stats: DataFrame, grade_col: str = "grade", pupils_col: str = "pupils") -> DataFrame:
    """A-11/T-1: pupils per grade (the stacked bars), sorted by grade."""
    return (class_stats.where(F.col(grade_col).isNotNull())
            .groupBy(F.col(grade_col).alias("grade"))
            .agg(F.sum(pupils_col).cast("bigint").alias("pupils"),
                 F.count(F.lit(1)).alias("n_subject_rows"))
            .orderBy("grade"))
