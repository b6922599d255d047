"""Per-day states of every month, replaced month by month (U-1/S-1 reload, A-12/A-13 kept up to date).

A state row holds the counts and sums of one day of one source file; states of a day are added up when read, so
a late file is one more source.  The table is partitioned by (month, source) and written with dynamic partition overwrite:

* the same file loaded again replaces its own partition, so a load that is run twice, or again after a failure, changes nothing;
* ``reload`` replaces a month: its new file is written, then the month's other sources are removed, also
  where the new file has no row of the month at all.

Only the months of the loaded file are touched.  Rows without a month belong to none and are not kept; rows without a day are one state row of their month.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..config import remove_path
from ..functions.columns import as_date, pct

FULL = "full"
COUNTS = ["total", "success", "n_seconds"]
SCHEMA = "day date, total bigint, success bigint, n_seconds bigint, sum_seconds decimal(38,6), month string, source string"


def day_states(df: DataFrame, month_col: str = "month", dt_col: str = "activity_dt", status_col: str = "status",
               seconds_col: str = "session_seconds") -> DataFrame:
    """(month, day, total, success, n_seconds, sum_seconds): one partial aggregate; sums are decimal, so their order does not matter."""
    seconds = F.nanvl(F.col(seconds_col).cast("double"), F.lit(None).cast("double")).cast("decimal(28,6)")
    return (df.where(F.col(month_col).isNotNull()).groupBy(F.col(month_col).alias("month"), as_date(dt_col).alias("day"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status_col) == K.TAG_SUCCESS).alias("success"),
                 F.count(seconds).alias("n_seconds"), F.sum(seconds).cast("decimal(38,6)").alias("sum_seconds")))


class MonthStates:
    """The table of states under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, df: DataFrame, source: str = FULL) -> None:
        """Add the rows of one source file, or replace them if this source was loaded before."""
        (day_states(df).withColumn("source", F.lit(source)).repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month", "source").parquet(self.root))

    def reload(self, df: DataFrame, months: Sequence[str]) -> None:
        """Replace the months by the rows of ``df``; a month without rows becomes empty."""
        chosen = df.where(F.col("month").isin(*months))
        held = {(r.month, r.source) for r in self.partitions().where(F.col("month").isin(*months)).collect()}  # a row per file of these months
        new = {r.month for r in chosen.select("month").distinct().collect()}  # at most the months asked for
        self.load(chosen, FULL)
        for month, source in held:
            if source != FULL or month not in new:
                remove_path(self.spark, f"{self.root}/month={month}/source={source}")

    def read(self) -> DataFrame:
        """The states of all sources."""
        try:
            return self.spark.read.schema(SCHEMA).option("basePath", self.root).parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def partitions(self) -> DataFrame:
        return self.read().select("month", "source").distinct()

    def days(self, months: Iterable[str] | None = None) -> DataFrame:
        """(month, day, total, success, n_seconds, sum_seconds), the sources of a day added up; only the asked months' folders are read."""
        states = self.read()
        if months is not None:
            states = states.where(F.col("month").isin(*months))
        sums = states.groupBy("month", "day").agg(*[F.sum(c).alias(c) for c in COUNTS], F.sum("sum_seconds").alias("s"))
        return sums.select("month", "day", *COUNTS, F.col("s").cast("double").alias("sum_seconds"))

    def conversion(self) -> DataFrame:
        """A-12 from the states: month, total, success, conversion_pct."""
        sums = self.read().groupBy("month").agg(F.sum("total").alias("total"), F.sum("success").alias("success"))
        return sums.select("month", "total", "success", pct("success", "total").alias("conversion_pct"))
