"""What a read could not understand (P-1/P-2 null count, F-5 rejects).

``quarantine`` writes the rows of a source table in one pass: good rows and bad rows into two folders, and the number of rows
per reason counted by the same pass (``DataFrame.observe``), so the source is scanned once.  A row may have several reasons.

Reasons: ``no_id`` (missing dialog id), ``date``, ``grade``, ``seconds`` (a cell that says something which is no timestamp, whole grade or number).
An empty cell is not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from . import tables

TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in tables.DIALOG_SCHEMA.fields])
FLAG = "quarantined"


def reasons() -> dict[str, Column]:
    """Per reason whether a row of text cells has it."""
    grade = F.col("dialog_grade").try_cast("double")
    return {"no_id": F.col("dialog_id").isNull(),
            "date": F.col("activity_dt").isNotNull() & F.col("activity_dt").try_cast("timestamp_ntz").isNull(),
            "grade": F.col("dialog_grade").isNotNull() & F.coalesce(grade != F.floor(grade), F.lit(True)),
            "seconds": F.col(K.SRC_SESSION_SECONDS).isNotNull() & F.col(K.SRC_SESSION_SECONDS).try_cast("double").isNull()}


def with_reasons(raw: DataFrame) -> DataFrame:
    """Text cells with ``reasons``: the names of what is wrong with the row."""
    return raw.withColumn("reasons", F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in reasons().items()]), lambda x: x.isNotNull()))


def quarantine(raw: DataFrame, path: str) -> dict[str, int]:
    """Write the rows under ``path`` by ``quarantined`` (true, false); returns the number of rows in all, of bad rows and per reason."""
    seen = Observation("read quality")
    marked = with_reasons(raw)
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") > 0).alias("bad"),
                             *[F.count_if(F.array_contains("reasons", r)).alias(r) for r in reasons()])
    counted.withColumn(FLAG, F.size("reasons") > 0).write.partitionBy(FLAG).parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``quarantine`` wrote, with their reasons; a filter on ``quarantined`` reads one of the two folders."""
    return spark.read.parquet(path).withColumn(FLAG, F.col(FLAG).cast("boolean"))


def good_dialogs(rows: DataFrame) -> DataFrame:
    """The stored rows without a fault as canonical dialogs."""
    return tables.canonical_dialogs(tables._typed(rows.where(~F.col(FLAG)).drop(FLAG, "reasons"), tables.DIALOG_SCHEMA, keep=("month",)))
