"""Dialogs and skeletons stored so that they join without a shuffle (J-1, J-4).

Both tables are bucketed and sorted by ``dialog_id`` into the same number of buckets; dialogs also have a folder per month.  A join of the two
on ``dialog_id`` reads bucket against bucket (no exchange), a grouping by ``dialog_id`` after it needs none either, and a join with a table of chosen
months prunes the month folders at run time (dynamic partition pruning).

Rows are hashed to their bucket once, at the write, by the hash that buckets use, so each task writes one file per bucket (and month).
A dialog with very many blocks makes its bucket large; such tables are better joined unbucketed, where adaptive execution splits the hot key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import remove_path, scratch_path


class BucketedTable:
    """A table bucketed by one column; its files lie under ``path`` until ``drop``."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    @classmethod
    def write(cls, df: DataFrame, name: str, buckets: int, key: str = "dialog_id", month_col: str | None = None, path: str | None = None) -> BucketedTable:
        spark = df.sparkSession
        name = f"{name}_{uuid.uuid4().hex[:12]}"
        path = path or scratch_path(spark, name)
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet")
        (writer.partitionBy(month_col) if month_col else writer).saveAsTable(name)
        return cls(spark, name, path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.path)


def of_months(dialogs: DataFrame, months: DataFrame, month_col: str = "month") -> DataFrame:
    """The dialogs of the chosen months (a small table with a ``month`` column); only their folders are read."""
    chosen = months.select(F.col(month_col).alias("_chosen")).distinct()
    return dialogs.join(chosen, dialogs[month_col] == chosen["_chosen"]).drop("_chosen")
