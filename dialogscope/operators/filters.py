"""Filters, facets, search and column guards (F-1 … F-8, P-9, J-1).

Filters are plain ``Column`` predicates ANDed together, so Catalyst pushes
them into the parquet scan (``PushedFilters``) and prunes columns.

Deliberate deviations:

* F-1: grade is compared as a number when the parameter is numeric text
  (``'7'`` and ``'7.0'`` both select grade 7), not as text.
* F-4: the search is a literal, case-insensitive substring match by default;
  ``regex=True`` opts into a case-insensitive regex.  Null ids never match.
  "First match" is the smallest ``dialog_id`` (no file order in Spark).
* F-6: grades sort numerically, not as text.
* J-1: an empty selection keeps no skeletons (``empty_means_all=True``
  restores the dashboard's "empty = no filter" behaviour).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import as_text


def require(df: DataFrame, *names: str) -> None:
    """F-8: raise a clear error when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}; available: {df.columns}")


def available(df: DataFrame, names: Iterable[str]) -> list[str]:
    """P-9: the wanted columns that exist, in the wanted order."""
    return [n for n in names if n in df.columns]


def _is_set(v) -> bool:
    return v is not None and v != K.ALL


def _grade_predicate(col: str, grade) -> Column:
    try:
        as_num = float(grade)
    except (TypeError, ValueError):
        return as_text(col) == F.lit(str(grade))
    return F.col(col).cast("double") == F.lit(as_num)


def filter_predicate(df: DataFrame, grade=None, role=None, product=None,
                     period: tuple | None = None, grade_col: str = "dialog_grade",
                     role_col: str = "dialog_role", product_col: str = "product_slug",
                     dt_col: str = "activity_dt") -> tuple[Column, list[str]]:
    """F-1/F-2/F-3: AND of the given filters, plus a description of each.

    ``None`` or ``'Все'`` means "no filter"; a filter on a missing column is
    skipped (as the dashboard does).  ``period`` is an inclusive pair of dates;
    rows with a null date fail it.
    """
    pred: Column = F.lit(True)
    applied: list[str] = []
    if _is_set(grade) and grade_col in df.columns:
        pred = pred & _grade_predicate(grade_col, grade)
        applied.append(f"grade={grade}")
    if _is_set(role) and role_col in df.columns:
        pred = pred & (F.col(role_col) == F.lit(role))
        applied.append(f"role={role}")
    if _is_set(product) and product_col in df.columns:
        pred = pred & (F.col(product_col) == F.lit(product))
        applied.append(f"product={product}")
    if period and dt_col in df.columns:
        lo, hi = (_to_date(p) for p in period)
        # Day-inclusive range on the raw timestamp: keeps the predicate
        # pushable to the scan (no function around the column).
        day_after = hi + _dt.timedelta(days=1)
        pred = pred & (F.col(dt_col) >= F.lit(lo)) & (F.col(dt_col) < F.lit(day_after))
        applied.append(f"period={lo}..{hi}")
    return pred, applied


def _to_date(v) -> _dt.date:
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v))


def apply_filters(df: DataFrame, **filters) -> DataFrame:
    """F-3: the rows passing every given filter."""
    pred, _ = filter_predicate(df, **filters)
    return df.where(pred)


def filter_effect(df: DataFrame, **filters) -> DataFrame:
    """F-7: rows kept of rows total (one pass), share %, and the filter list."""
    pred, applied = filter_predicate(df, **filters)
    agg = df.agg(F.count_if(pred).alias("kept"), F.count(F.lit(1)).alias("total"))
    return agg.select("kept", "total",
                      F.bround(F.try_divide(F.col("kept") * 100.0, F.col("total")), 1).alias("kept_pct"),
                      F.lit(", ".join(applied)).alias("filters"))


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """F-6: distinct non-null values of one column, sorted.

    A grouped distinct: partial aggregation keeps one row per value per task.
    """
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().orderBy("value")


def facets(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """F-6 for several columns at once: (facet, value) rows as text.

    One scan: each row is expanded into one (facet, value) pair per column and
    a single grouped distinct removes duplicates.
    """
    cols = available(df, cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), as_text(c).alias("value")) for c in cols])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n_dialogs")))


def search_dialog(df: DataFrame, text: str, regex: bool = False, first: bool = True,
                  id_col: str = "dialog_id") -> DataFrame:
    """F-4: dialogs whose id contains ``text`` (case-insensitive).

    An empty search returns no rows.  ``first=True`` returns only the match with
    the smallest id (a ``TakeOrderedAndProject`` of one row).
    """
    if not text:
        return df.limit(0)
    ident = as_text(id_col)
    if regex:
        pred = ident.rlike("(?i)" + text)
    else:
        pred = F.contains(F.lower(ident), F.lower(F.lit(text)))
    hits = df.where(ident.isNotNull() & pred)
    return hits.orderBy(id_col).limit(1) if first else hits


def skeletons_for(skeletons: DataFrame, dialogs: DataFrame, empty_means_all: bool = False,
                  id_col: str = "dialog_id") -> DataFrame:
    """J-1: skeletons of the (filtered) dialogs, as a left-semi join.

    No id list is ever collected: the semi join runs as a broadcast hash join
    when AQE sees a small side, else sort-merge.  With ``empty_means_all`` the
    dashboard's quirk is reproduced (no selected dialog → keep everything); it
    costs one ``isEmpty`` probe (a LIMIT 1 job).
    """
    ids = dialogs.select(id_col)
    if empty_means_all and ids.isEmpty():
        return skeletons
    return skeletons.join(ids, on=id_col, how="left_semi")
