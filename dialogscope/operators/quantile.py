"""Exact median without gathering the column into one task.

Spark's exact ``median``/``percentile`` keeps a map of every distinct value
per group and merges all of them in ONE task for a global aggregate, so on a
large table the whole column ends up in a single task.  ``exact_kth`` instead
narrows the rank down between approximate quantiles:

1. ``percentile_approx`` gives two values just below and above the wanted rank.  Its error is
   a share of the rows (1 / ``accuracy``), whatever the values are: evenly spread, log-normal or a few
   outliers, a pass leaves about 6 / ``accuracy`` of the candidates;
2. one aggregate counts the candidates below, at, between and above the two, which says where the rank
   lies - exactly, whether the approximation kept its promise or not;
3. once at most ``small`` candidates are left (a fixed bound), they are ranked in one task.

The two values themselves are never candidates again, so each pass removes something and heavy ties end the
search at once.  At the default accuracy 10^12 values take three passes of two aggregates.  Results equal Spark's
``median`` (linear interpolation between the two middle values for an even count).  Infinities are ordinary values; null and NaN are left out.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
DEFAULT_SMALL = 1 << 16  # rows in the one ranking task


def _values(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_kth(df: DataFrame, col: str, k: int, *, accuracy: int = ACCURACY, small: int = DEFAULT_SMALL) -> float | None:
    """The value of 0-based rank ``k`` among the non-null, non-NaN values."""
    base = _values(df, col)
    return _kth_pair(base, k, base.count(), accuracy, small)[0]


def _around(values: DataFrame, rank: int, n: int, accuracy: int) -> tuple[float, float]:
    """Two values near the rank, below and above it if the approximation keeps its promise."""
    slack = 2 / accuracy
    at = [max(0.0, rank / n - slack), min(1.0, (rank + 1) / n + slack)]
    low, high = values.agg(F.percentile_approx("v", at, accuracy)).first()[0]
    return low, high


def _kth_pair(base: DataFrame, k: int, n: int, accuracy: int, small: int) -> tuple[float | None, float | None]:
    """Values of ranks ``k`` and ``k + 1`` of the column ``v``; the second is None where it is the smallest value above the first (or there is none)."""
    if k < 0 or k >= n:
        return None, None
    v, cond, rank, m = F.col("v"), F.lit(True), k, n
    while m > small:
        some = base.where(cond)
        low, high = _around(some, rank, m, accuracy)
        inside: Column = (v > low) & (v < high)
        count = some.agg(F.count_if(v < low).alias("below"), F.count_if(v == low).alias("low"), F.count_if(inside).alias("inside"),
                         F.count_if((v == high) & (v > low)).alias("high")).first()
        ends = [count.below, count.below + count.low, count.below + count.low + count.inside, count.below + count.low + count.inside + count.high]
        if rank < ends[0]:
            cond, m = cond & (v < low), count.below
        elif rank < ends[1]:
            return float(low), (float(low) if rank + 1 < ends[1] else None)
        elif rank < ends[2]:
            cond, rank, m = cond & inside, rank - ends[1], count.inside
        elif rank < ends[3]:
            return float(high), (float(high) if rank + 1 < ends[3] else None)
        else:
            cond, rank, m = cond & (v > high), rank - ends[3], m - ends[3]
    # At most ``small`` values remain: rank them in one task and return the (at most two) rows at the wanted ranks.
    hits = (base.where(cond).withColumn("_rn", F.row_number().over(Window.orderBy("v")))
            .where(F.col("_rn").between(rank + 1, rank + 2)).orderBy("_rn").collect())
    return float(hits[0]["v"]), (float(hits[1]["v"]) if len(hits) > 1 else None)


def exact_median(df: DataFrame, col: str, *, accuracy: int = ACCURACY, small: int = DEFAULT_SMALL) -> float | None:
    """Median with interpolation for an even count (as ``median``).

    The one projected column is persisted (memory, spilling to disk) for the few passes, so the source plan - scans
    and joins - runs once; a lost block is recomputed from its lineage.
    """
    base = _values(df, col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = base.count()
        if n == 0:
            return None
        v1, v2 = _kth_pair(base, (n - 1) // 2, n, accuracy, small)
        if n % 2 == 1:
            return v1
        if v2 is None:
            v2 = base.agg(F.min(F.when(F.col("v") > F.lit(v1), F.col("v"))).alias("above")).first()["above"]
        return v1 if v1 == v2 else v1 + (v2 - v1) * 0.5  # equal infinities have no difference
    finally:
        base.unpersist()
