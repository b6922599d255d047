"""Writers (K-1) and the sectioned report file (the format S-5 parses).

Deliberate deviations from the dashboard's CSV download: no BOM, one folder
of part files per write (Spark writes in parallel; no driver-side single
file), and only the frame's own columns are written.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def export_name(month: str, day: _dt.date | None = None) -> str:
    """K-1: the download name ``analytics_{month}_{YYYYMMDD}`` (a folder of
    part files here, named like the dashboard's single file)."""
    day = day or _dt.date.today()
    return f"analytics_{month}_{day.strftime('%Y%m%d')}"


def with_source_names(df: DataFrame) -> DataFrame:
    """The canonical dialog columns under the source files' names, timestamps as text."""
    back = {canon: src for src, canon in K.DIALOG_COLUMNS.items()}
    return df.select(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else F.col(f"`{c}`"))
                       .alias(back.get(c, c)) for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-1: CSV with a header row, UTF-8, quotes escaped by doubling."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8")
     .csv(path))


def write_monthly(df: DataFrame, root: str, table: str, month_col: str = "month",
                  fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write one table partitioned by month (``{root}/{table}/month=…``).

    Rows are rebalanced by month before the write (``rebalance`` hint): a
    hash shuffle on the month, so each task writes one or a few month
    folders, and AQE splits a month that holds a third of all rows into
    advisory-sized tasks instead of leaving it to one (and merges small
    ones).  Unlike a range repartition it needs no sampling pass over the
    input.  Partition folders let readers prune months.
    """
    path = f"{root.rstrip('/')}/{table}"
    writer = df.hint("rebalance", f"`{month_col}`").write.mode(mode).partitionBy(month_col)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def report_lines(report: DataFrame, by: str = "month") -> DataFrame:
    """Lay out a ``full_report`` frame as the report file's lines.

    Returns (``by``, line_no, c1, c2, c3, c4) with the banner, rules, section
    titles and headers in place and percentages as text (``79.5%``, ``100%``).
    Everything is a projection plus a union with the fixed header lines
    crossed with the (few) distinct groups — bounded by #groups × 30 rows.
    """
    def fmt_pct(c):
        return (F.when(c.isNull(), F.lit(""))
                .when(c == 100.0, F.lit("100%"))
                .otherwise(F.concat(F.format_number(c, 1), F.lit("%"))))

    def row(line_no, c1, c2=F.lit(""), c3=F.lit(""), c4=F.lit("")):
        return F.struct(F.lit(line_no).alias("line_no"), c1.alias("c1"), c2.alias("c2"),
                        c3.alias("c3"), c4.alias("c4"))

    lit = F.lit
    fixed = [
        row(1, lit(K.REPORT_BANNER)), row(2, lit("")), row(3, lit(K.REPORT_RULE)),
        row(4, lit(K.REPORT_STAGE1_TITLE)), row(5, *[lit(h) for h in K.REPORT_STAGE1_HEADER]),
        row(7, lit(K.REPORT_RULE)),
        row(16, lit(K.REPORT_STAGE2_TITLE)), row(17, *[lit(h) for h in K.REPORT_STAGE2_HEADER]),
        row(23, lit("")), row(24, lit(K.REPORT_RULE)),
        row(25, lit(K.REPORT_CONVERSION_TITLE)), row(26, *[lit(h) for h in K.REPORT_CONVERSION_HEADER]),
    ]
    groups = report.select(by).distinct()
    header = groups.select(by, F.inline(F.array(*fixed)))
    # Section line numbers of the file: stage 1 success at 6, the other tags
    # at 8-14 and the total at 15; stage 2 at 18-22; conversion at 27-30.
    line = (F.when(F.col("section") == "stage1",
                   F.when(F.col("line_no") == 1, F.lit(6)).otherwise(F.col("line_no") + 6))
            .when(F.col("section") == "stage2", F.col("line_no") + 17)
            .otherwise(F.col("line_no") + 26))
    body = report.select(by, line.alias("line_no"), F.col("tag").alias("c1"),
                         F.col("n_dialogs").cast("string").alias("c2"),
                         fmt_pct(F.col("pct_1")).alias("c3"), fmt_pct(F.col("pct_2")).alias("c4"))
    return header.unionByName(body)


def write_report_files(report: DataFrame, root: str, by: str = "month") -> str:
    """Write one sectioned report CSV per group (``{root}/report/{by}=…``),
    lines in file order, no header row (the file's first line is its banner)."""
    path = f"{root.rstrip('/')}/report"
    lines = report_lines(report, by)
    # Hash partitioned, not rebalanced: a file must hold its group's lines whole and in order.
    (lines.repartition(by).sortWithinPartitions(by, "line_no")
     .drop("line_no").write.mode("overwrite").partitionBy(by)
     .option("header", False).option("escape", '"').option("quoteAll", False).csv(path))
    return path
