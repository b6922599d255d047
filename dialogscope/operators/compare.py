"""Month comparison (U-1, P-12, with A-12 / A-13 in ``metrics``).

The dashboard loads each selected month separately and concatenates them.
In Spark the months are one table with a ``month`` column (a partition
column when written by ``sinks.write_monthly``), so a comparison is a
partition-pruned scan plus one grouped aggregate.  ``union_months`` is kept
for frames that really are separate (different sources per month).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import month_prefix
from .filters import apply_filters


def union_months(frames: Mapping[str, DataFrame], month_col: str = "month") -> DataFrame | None:
    """U-1/P-12: union by column name, missing columns null, each frame tagged
    with its month; empty input → None.

    Empty months need no special case: they add no rows.
    """
    tagged = [df.withColumn(month_col, F.lit(m)) for m, df in frames.items()]
    if not tagged:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def comparison_filter(df: DataFrame, grade=None, role=None, product=None) -> DataFrame:
    """The comparison view filters by grade, role and product — never by the
    period (the dashboard ignores the date range there)."""
    return apply_filters(df, grade=grade, role=role, product=product)


def select_months(df: DataFrame, months, month_col: str = "month") -> DataFrame:
    """Restrict to the selected months (pruned partitions when partitioned).

    Months are given by name, file prefix or ``yyyy-MM``; the column may hold names or
    prefixes.  An unknown month is an error (S-3).
    """
    names = [x for m in months for x in {m, month_prefix(m)}]
    return df.where(F.col(month_col).isin(names))
