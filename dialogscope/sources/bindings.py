"""Bind the driver's test tables to the dialog data model.

The test tables hold no tutoring dialogs, so the dialog tables are derived
deterministically from them, with the same expressions in Spark (here) and in
the DuckDB oracle (``plans/oracle.py``):

``dialogs`` (one row per dialog) ← ``orders`` ⟕ ``customer`` ⟕ per-order
``lineitem`` counts:

=============== ==========================================================
dialog_id        ``o_orderkey`` as zero-padded text (``%08d``, never cut)
activity_dt      ``o_orderdate`` (timestamp without zone)
month            ``yyyy-MM`` of ``activity_dt``
dialog_grade     ``5 + o_orderkey % 7``; null when ``o_orderkey % 29 = 0``
dialog_role      ``c_mktsegment`` (null without a customer)
product_slug     ``o_orderpriority``; null when ``o_orderkey % 31 = 0``
status           stage-1 tag by ``o_orderkey % 16`` (see ``STATUS_BY_RESIDUE``)
status_post      stage-2 tag by ``(o_orderkey div 16) % 6`` for successes
session_seconds  ``o_totalprice``
pupil_msgs       lineitems with ``l_linestatus = 'O'`` (null without items)
tutor_msgs       lineitems with ``l_linestatus = 'F'`` (null without items)
=============== ==========================================================

``class_stats`` ← all ``orders`` grouped to (``5 + o_orderkey % 7``,
``o_orderstatus``) counts.

Skeleton bindings live in ``skeleton_sources.py``.

Scale notes: ``lineitem`` is aggregated per order *before* the join (map-side
partial aggregation, one row per order leaves the scan), so the join is
orders ⟕ one-row-per-order.  Both joins are equi-joins on keys that Catalyst
plans as sort-merge (or broadcast when AQE sees a small side); a customer that
owns a third of all orders is split by AQE's skew-join handling.  Only the
joins the caller's columns need are built.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

# Binding choice (not a reference value): stage-1 tag by o_orderkey % 16.
STATUS_BY_RESIDUE = {
    0: K.TAG_EMPTY,
    1: K.TAG_TASK,
    2: K.TAG_NOT_MATH,
    3: K.TAG_OUT_OF_GRADES,
    4: K.TAG_COMING_SOON,
    5: K.TAG_LEFT_AFTER_MATCH,
    6: K.TAG_MATCH_FAILED,
    7: None,  # a dialog without a tag
}  # residues 8..15 → success
STATUS_MODULUS = 16
# Binding choice: stage-2 tag by (o_orderkey div 16) % 6 among successes.
POST_BY_RESIDUE = {
    0: K.POST_AFTER_PLAN,
    1: K.POST_AFTER_STEP1,
    2: K.POST_AFTER_STEP2,
    3: K.POST_SAW_FINAL,
    4: K.POST_SOLVED,
    5: None,
}
POST_MODULUS = 6

ALL_DIALOG_COLUMNS = [
    "dialog_id", "activity_dt", "month", "dialog_grade", "dialog_role", "product_slug",
    "status", "status_post", "session_seconds", "pupil_msgs", "tutor_msgs",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(key: Column, mapping: dict, default) -> Column:
    expr = None
    for residue, value in mapping.items():
        lit = F.lit(value).cast("string")
        expr = F.when(key == residue, lit) if expr is None else expr.when(key == residue, lit)
    return expr.otherwise(F.lit(default))


def status_expr(orderkey: Column) -> Column:
    return _case(orderkey % STATUS_MODULUS, STATUS_BY_RESIDUE, K.TAG_SUCCESS)


def status_post_expr(orderkey: Column) -> Column:
    post = _case(F.floor(orderkey / STATUS_MODULUS) % POST_MODULUS, POST_BY_RESIDUE, None)
    return F.when(status_expr(orderkey) == K.TAG_SUCCESS, post)


def dialogs(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The ``dialogs`` table (see module docstring), with only the joins the
    requested ``columns`` need."""
    want = list(columns) if columns is not None else list(ALL_DIALOG_COLUMNS)
    unknown = set(want) - set(ALL_DIALOG_COLUMNS)
    if unknown:
        raise ValueError(f"unknown dialog columns: {sorted(unknown)}")
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    exprs = {
        "dialog_id": F.format_string("%08d", key),
        "activity_dt": F.col("o_orderdate"),
        "month": F.date_format("o_orderdate", "yyyy-MM"),
        "dialog_grade": F.when(key % 29 == 0, F.lit(None).cast("bigint")).otherwise(F.lit(5) + key % 7),
        "product_slug": F.when(key % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")),
        "status": status_expr(key),
        "status_post": status_post_expr(key),
        "session_seconds": F.col("o_totalprice"),
    }
    df = o
    if "dialog_role" in want:
        cust = table(spark, sf_dir, "customer").select(
            F.col("c_custkey"), F.col("c_mktsegment").alias("dialog_role"))
        df = df.join(cust, df["o_custkey"] == cust["c_custkey"], "left")
        exprs["dialog_role"] = F.col("dialog_role")
    if "pupil_msgs" in want or "tutor_msgs" in want:
        msgs = (table(spark, sf_dir, "lineitem")
                .groupBy("l_orderkey")
                .agg(F.count_if(F.col("l_linestatus") == "O").alias("pupil_msgs"),
                     F.count_if(F.col("l_linestatus") == "F").alias("tutor_msgs")))
        df = df.join(msgs, df["o_orderkey"] == msgs["l_orderkey"], "left")
        exprs["pupil_msgs"] = F.col("pupil_msgs")
        exprs["tutor_msgs"] = F.col("tutor_msgs")
    return df.select(*[exprs[c].alias(c) for c in want])


def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-aggregated class/subject table: (grade, subject, pupils).

    Built with a grouped count (partial aggregation per task, so only one row
    per (grade, status) per task is shuffled).
    """
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return (o.groupBy((F.lit(5) + key % 7).alias("grade"), F.col("o_orderstatus").alias("subject"))
            .agg(F.count(F.lit(1)).alias("pupils")))
