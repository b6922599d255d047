"""Incremental refresh of the dashboard counters with Structured Streaming.

The dashboard's "refresh" button drops its cache and re-reads every monthly
file.  Here new monthly files landing in a folder update the per-month tag
counts incrementally: a file stream → the same conditional-count aggregate as
``funnel.tag_counts`` grouped by month → a table, written anew after each batch.  The state is
one row of counters per month (bounded by the number of months), kept in the
state store under the checkpoint folder, so a restarted or failed query
resumes where it stopped.

``run_available`` processes everything present once (``availableNow``) and
returns the result table — the batch-equivalent used by the query catalog
and tests; ``start`` leaves a continuously running query for production.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..config import scratch_path


def month_counts(stream: DataFrame, status_col: str = "status", month_col: str = "month",
                 tags: Sequence[str] = tuple(K.STAGE1_REPORT_TAGS),
                 names: Sequence[str] | None = None) -> DataFrame:
    """Per month: total and one count per tag (streaming or batch input)."""
    names = list(names) if names is not None else [f"n_{i}" for i in range(len(tags))]
    counts: list[Column] = [F.count(F.lit(1)).alias("total")]
    counts += [F.count_if(F.col(status_col) == t).alias(n) for t, n in zip(tags, names)]
    return stream.groupBy(F.col(month_col).alias("month")).agg(*counts)


def read_dialog_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(path)


def start(agg: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the counts in ``folder``: each micro-batch writes the whole table to ``{folder}/batch={id}``.

    A batch that is run again after a failure overwrites its own folder.
    """
    def write(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The counts as of the last batch that was written."""
    counts = spark.read.parquet(folder)
    last = counts.agg(F.max("batch")).first()[0]
    return counts.where(F.col("batch") == F.lit(last)).drop("batch")


def run_available(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  names: Sequence[str] | None = None, max_files_per_trigger: int | None = None,
                  folder: str | None = None) -> DataFrame:
    """Process every file present under ``path`` and return the counts, kept under ``folder`` (default: scratch)."""
    stream = read_dialog_stream(spark, path, schema, fmt, max_files_per_trigger)
    folder = folder or scratch_path(spark, "stream")
    q = start(month_counts(stream, names=names), f"{folder}/counts", f"{folder}/state", trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise q.exception()
    return latest(spark, f"{folder}/counts")
