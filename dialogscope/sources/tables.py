"""Monthly table reader, column-alias repair and class table (S-1 … S-4, S-6).

Layout: one folder per table, one sub-folder per month
(``{root}/{table}/month={prefix}/part-*.csv`` as written by
``sinks.write_monthly``) or the flat source files ``{root}/{prefix}_{table}.csv``.
Both are read with ONE multi-path ``spark.read`` with an explicit schema, so
the month becomes a column (partition pruning for partitioned folders) and no
per-month frames are unioned on the driver.

Deliberate deviations:

* S-3: an unknown month name raises instead of silently reading January.
* S-1: Spark drops a UTF-8 BOM by itself; quoted fields may span lines.  The words that
  the source's reader takes for a missing value (``NULL_WORDS``) become null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

# Source schemas, with the source column names (FIXED VALUES) and types.
DIALOG_SCHEMA = T.StructType([
    T.StructField("dialog_id", T.StringType()),
    T.StructField("activity_dt", T.StringType()),
    T.StructField("dialog_grade", T.DoubleType()),
    T.StructField("dialog_role", T.StringType()),
    T.StructField("product_slug", T.StringType()),
    T.StructField("status_only", T.StringType()),
    T.StructField("status_only_post", T.StringType()),
    T.StructField(K.SRC_SESSION_SECONDS, T.DoubleType()),
    T.StructField(K.SRC_PUPIL_MSGS, T.DoubleType()),
    T.StructField(K.SRC_TUTOR_MSGS, T.DoubleType()),
])
CLASS_SCHEMA = T.StructType([
    T.StructField(K.SRC_GRADE, T.LongType()),
    T.StructField(K.SRC_SUBJECT, T.StringType()),
    T.StructField(K.SRC_PUPILS, T.LongType()),
])
# FIXED VALUES: cell texts that mean "missing" (besides the empty cell).
NULL_WORDS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
              "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SCHEMAS = {"chart_data": DIALOG_SCHEMA, "class_stats": CLASS_SCHEMA}


def month_prefix(month: str) -> str:
    """S-3: month name → file prefix; unknown months are an error.

    Prefixes themselves and ``yyyy-MM`` partition values pass through.
    """
    if month in K.MONTH_PREFIX:
        return K.MONTH_PREFIX[month]
    if month in K.MONTH_PREFIX.values() or re.fullmatch(r"\d{4}-\d{2}", month):
        return month
    raise KeyError(f"unknown month {month!r}; known: {list(K.MONTH_PREFIX)}")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path's own file system has it (resolving a text read looks it up, and reads nothing)."""
    try:
        spark.read.text(path).schema  # noqa: B018
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_table(spark: SparkSession, root: str, table: str, months: Sequence[str] | None = None,
               schema: T.StructType | None = None, partitioned: bool = False,
               month_dir: str = "month", multi_line: bool = True) -> DataFrame:
    """S-1/S-2/S-6: the rows of ``table`` for ``months`` (None = every month
    present) with a ``month`` column holding the month prefix.

    Columns are matched to ``schema`` BY NAME from each file's header (the
    files' column order does not matter; values that do not parse become
    null; columns the schema does not know are kept as text).  Missing month
    files are skipped (S-2: a missing file is an empty table and does not
    affect other tables); with no file at all an empty frame of the schema is
    returned.

    Flat source files (``{prefix}_{table}.csv``) may differ in their columns
    from month to month, so each month is its own scan and the months are
    unioned by column name, missing columns null (U-1) — a handful of lazy
    scans.  ``partitioned=True`` reads the uniform ``{month_dir}=…`` folder
    layout written by ``sinks.write_monthly`` with ONE multi-path scan (pruned
    to the asked months); files whose header differs from the first one's are an error.

    Quoted cells may hold line breaks, which makes every file a single task.  Where no cell
    does, ``multi_line=False`` reads large files in many tasks; a row that does not
    fit the header (a cell did hold a line break) is then an error, never shifted.
    """
    schema = schema or SCHEMAS.get(table)
    reader = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
              .option("encoding", "UTF-8").option("enforceSchema", False).option("mode", "PERMISSIVE" if multi_line else "FAILFAST"))
    if partitioned:
        base = f"{root.rstrip('/')}/{table}"
        if months is None:
            paths = [base] if _exists(spark, base) else []
        else:
            paths = [f"{base}/{month_dir}={month_prefix(m)}" for m in months]
            paths = [p for p in paths if _exists(spark, p)]
        if not paths:
            return _empty(spark, schema)
        df = reader.option("basePath", base).csv(paths)
        month = F.col(f"`{month_dir}`").cast("string")
        return _typed(df.withColumn("month", month).drop(*([month_dir] if month_dir != "month" else [])), schema, keep=("month",))
    frames = {}
    for m in (list(K.MONTH_PREFIX) if months is None else months):
        prefix = month_prefix(m)
        path = f"{root.rstrip('/')}/{prefix}_{table}.csv"
        if _exists(spark, path):
            frames[prefix] = _typed(reader.csv(path), schema)
    if not frames:
        return _empty(spark, schema)
    out = None
    for prefix, df in frames.items():
        df = df.withColumn("month", F.lit(prefix))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _typed(df: DataFrame, schema: T.StructType | None, keep: Sequence[str] = ()) -> DataFrame:
    """Null words to null, then the schema's columns cast by name (unparseable → null); the rest stays text."""
    known = {f.name: f.dataType for f in schema.fields} if schema else {}

    def cell(name):
        value = F.col(f"`{name}`")
        if name in keep:
            return value
        value = F.when(~value.isin(NULL_WORDS), value)
        return (value.try_cast(known[name]) if name in known else value).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def _empty(spark: SparkSession, schema: T.StructType | None) -> DataFrame:
    fields = list((schema or T.StructType()).fields) + [T.StructField("month", T.StringType())]
    return spark.createDataFrame([], T.StructType(fields))


def normalise(df: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None,
              rename: Mapping[str, str] | None = None) -> DataFrame:
    """S-4: alias repair, all at schema level (no data pass).

    ``aliases`` maps a canonical column to its candidate source names in
    priority order; the first PRESENT column is used as is (a null in it does
    not fall back to the next candidate, as with ``row.get``), and with no
    candidate present the column is ``''``.  ``rename`` maps source names to
    canonical ones where present.
    """
    aliases = aliases if aliases is not None else SKELETON_ALIASES
    out = df
    for canon, candidates in aliases.items():
        present = [c for c in candidates if c in out.columns]
        value = F.col(f"`{present[0]}`") if present else F.lit("")
        drop = [c for c in present if c != canon]
        out = out.withColumn(canon, value).drop(*drop)
    for src, canon in (rename or {}).items():
        if src in out.columns and canon not in out.columns:
            out = out.withColumnRenamed(src, canon)
    return out


# FIXED VALUES: where the skeleton text may live, in priority order (the
# renamed ``status_only`` column only counts when ``Скелет`` is absent).
SKELETON_ALIASES = {"skeleton": [K.SRC_SKELETON, "status_only", K.SRC_SKELETON_LOWER]}


def canonical_dialogs(df: DataFrame) -> DataFrame:
    """Source dialog table → canonical names and types (grade as an integer,
    the text timestamp parsed leniently)."""
    out = df
    for src, canon in K.DIALOG_COLUMNS.items():
        if src in out.columns and src != canon:
            out = out.withColumnRenamed(src, canon)
    if "dialog_grade" in out.columns:
        out = out.withColumn("dialog_grade", F.col("dialog_grade").try_cast("bigint"))
    if "activity_dt" in out.columns:
        out = out.withColumn("activity_dt", F.col("activity_dt").try_cast("timestamp_ntz"))
    return out


def canonical_skeletons(df: DataFrame) -> DataFrame:
    """Source skeleton table → dialog_id, skeleton, dialog_text, tag,
    dialog_grade, dialog_role (absent optional columns stay absent; an absent
    skeleton column becomes ``''``)."""
    out = normalise(df, SKELETON_ALIASES, rename={K.SRC_DIALOG_TEXT: "dialog_text", K.SRC_TAG: "tag"})
    if "dialog_grade" in out.columns:
        out = out.withColumn("dialog_grade", F.col("dialog_grade").try_cast("double").try_cast("bigint"))
    return out


def canonical_classes(df: DataFrame) -> DataFrame:
    out = df
    for src, canon in K.CLASS_COLUMNS.items():
        if src in out.columns:
            out = out.withColumnRenamed(src, canon)
    return out
