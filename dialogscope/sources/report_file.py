"""Parse the sectioned report CSV into tidy rows (S-5).

The report file is ragged: a banner, rule rows of box glyphs, three section
titles each followed by a header row, tag rows with a count and percent text,
rule rows that may carry the section total, quoted cells with commas and
doubled quotes.  The dashboard only loads it raw; here it becomes
(month, section, line_no, tag, n_dialogs, pct_1, pct_2) — the same shape as
``operators.report.full_report`` — so a report file can be checked against a
recomputation.

Each file is read whole (``wholetext``; report files are a few dozen lines)
and split into numbered lines; each line is parsed with ``from_csv`` (quote
and escape ``"``).  The section of a line is the last section title above it
(a window per file, bounded by the file's size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K

LINE_SCHEMA = "c1 STRING, c2 STRING, c3 STRING, c4 STRING"


def _pct(c):
    return F.regexp_replace(F.trim(c), "%$", "").try_cast("double")


def parse_report(spark: SparkSession, paths: str | Sequence[str], month_pattern: str | None = None
                 ) -> DataFrame:
    """Tidy rows of one or more report files.

    ``month_pattern``: regex with one group taking the month from the file
    path (default: a ``month=…`` folder, else a ``xxx_stats.csv`` prefix).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("wholetext", True).text(paths).withColumn("_file", F.input_file_name())
    pattern = month_pattern or r"(?:month=([^/]+)/|/([a-z]{3})_stats\.csv$)"
    month = (F.coalesce(F.nullif(F.regexp_extract("_file", pattern, 1), F.lit("")),
                        F.nullif(F.regexp_extract("_file", pattern, 2), F.lit("")))
             if month_pattern is None else F.regexp_extract("_file", pattern, 1))
    if "month" in raw.columns:  # partition discovery already gave it
        month = F.coalesce(F.col("month").cast("string"), month)
    lines = (raw.select(month.alias("month"), "_file",
                        F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n", -1))
                        .alias("file_line", "line"))
             .where(F.col("line") != "")
             .withColumn("cells", F.from_csv("line", LINE_SCHEMA, {"escape": '"', "quote": '"'}))
             .select("month", "_file", "file_line", "cells.*"))
    title = F.col("c1")
    section = (F.when(title == K.REPORT_STAGE1_TITLE, F.lit("stage1"))
               .when(title == K.REPORT_STAGE2_TITLE, F.lit("stage2"))
               .when(title == K.REPORT_CONVERSION_TITLE, F.lit("conversion")))
    per_file = Window.partitionBy("_file").orderBy("file_line")
    tagged = lines.withColumn(
        "section", F.last(section, ignorenulls=True).over(per_file.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.trim(F.col("c2")).try_cast("bigint")
    data = tagged.where(F.col("section").isNotNull() & n.isNotNull())
    in_section = Window.partitionBy("_file", "section").orderBy("file_line")
    return data.select("month", "section", F.row_number().over(in_section).alias("line_no"),
                       F.col("c1").alias("tag"), n.alias("n_dialogs"),
                       _pct(F.col("c3")).alias("pct_1"), _pct(F.col("c4")).alias("pct_2"))
