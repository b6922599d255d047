"""Sessions of raw events (A-8 for an event table): ``session_window`` with a gap, in batch and in a stream.

A user's events belong to one session as long as each comes at most ``gap`` after the one before.  ``_sessions`` is the one piece of
code for both: in a stream its groups are the users, under a watermark; in a batch they are (user, range chunk), so a user
with a third of all events is spread over as many tasks as the rows need.  Only a chunk's first and last session of a user can go on in
another chunk, so only these meet once more, in a ``session_window`` whose gap is the session's own length and the gap.

A stream gives a session once, when the watermark (latest time seen, less ``delay``) has passed its end, which is its last event's time and
the gap.  Events that come later than the watermark are dropped; those within it are not.

Times without a zone are taken as UTC, whatever the session's zone.  Rows without user or time are left out (by filters that reach the scan).
An empty table has no session.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import default_parallelism, scratch_path

SCHEMA = "user bigint, first_at timestamp, last_at timestamp, n_events bigint"
DAY = 86_400_000_000


def _micros(within: _dt.timedelta) -> int:
    whole = within // _dt.timedelta(microseconds=1)
    if whole <= 0:
        raise ValueError("the gap must be positive")
    return whole


def _instant(events: DataFrame, time_col: str) -> Column:
    at = F.col(time_col)
    if dict(events.dtypes)[time_col] == "timestamp":
        return at
    return F.timestamp_micros(F.unix_date(at.cast("date")).cast("bigint") * DAY + F.hour(at).cast("bigint") * 3_600_000_000
                              + F.minute(at).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint"))


def _rows(events: DataFrame, user_col: str, time_col: str) -> DataFrame:
    return events.where(F.col(user_col).isNotNull() & F.col(time_col).isNotNull()).select(
        F.col(user_col).alias("user"), _instant(events, time_col).alias("_at"))


def _sessions(rows: DataFrame, gap: _dt.timedelta, *keys: str) -> DataFrame:
    window = F.session_window("_at", f"{_micros(gap)} microseconds")
    return rows.groupBy(*keys, window).agg(F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count(F.lit(1)).alias("n_events"))


def sessions(events: DataFrame, gap: _dt.timedelta, user_col: str = "user_id", time_col: str = "ts", range_partitions: int | None = None) -> DataFrame:
    """(user, first_at, last_at, n_events): every session of the table."""
    n = range_partitions or default_parallelism(events.sparkSession)
    chunked = _rows(events, user_col, time_col).repartitionByRange(n, "user", "_at").withColumn("_chunk", F.spark_partition_id())
    local = _sessions(chunked, gap, "user", "_chunk")
    w = Window.partitionBy("user", "_chunk").orderBy("first_at")
    at_edge = F.lag("first_at").over(w).isNull() | F.lead("first_at").over(w).isNull()
    # A session inside its chunk is a group of its own, so a user's inner sessions are spread too.
    marked = local.withColumn("_own", F.when(~at_edge, F.col("first_at")))
    length = F.unix_micros("last_at") - F.unix_micros("first_at") + _micros(gap)
    window = F.session_window("first_at", F.concat(length.cast("string"), F.lit(" microseconds")))
    return (marked.groupBy("user", "_own", window).agg(F.min("first_at").alias("first"), F.max("last_at").alias("last"), F.sum("n_events").alias("n"))
            .select("user", F.col("first").alias("first_at"), F.col("last").alias("last_at"), F.col("n").alias("n_events")))


def start_stream(stream: DataFrame, gap: _dt.timedelta, delay: _dt.timedelta, folder: str, user_col: str = "user_id", time_col: str = "ts",
                 trigger: dict | None = None) -> StreamingQuery:
    """Append every closed session of a stream of events to ``folder``/sessions; the state lies in ``folder``/state."""
    rows = _rows(stream, user_col, time_col).withWatermark("_at", f"{delay // _dt.timedelta(microseconds=1)} microseconds")
    closed = _sessions(rows, gap, "user").select("user", "first_at", "last_at", "n_events")
    writer = closed.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/sessions").option("checkpointLocation", f"{folder}/state")
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def run_available(spark: SparkSession, path: str, gap: _dt.timedelta, delay: _dt.timedelta, folder: str | None = None,
                  max_files_per_trigger: int | None = None, **columns: str) -> DataFrame:
    """Take in the Parquet files under ``path`` that are new since the last call on ``folder``; all sessions closed so far."""
    folder = folder or scratch_path(spark, "sessions")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    running = start_stream(reader.parquet(path), gap, delay, folder, trigger={"availableNow": True}, **columns)
    running.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{folder}/sessions")


def daily(found: DataFrame) -> DataFrame:
    """Per day (UTC) on which sessions began: their number, events, time in microseconds, mean and longest minutes."""
    length = F.unix_micros("last_at") - F.unix_micros("first_at")
    day = F.date_from_unix_date(F.floor(F.unix_micros("first_at") / DAY).cast("int"))
    sums = found.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"),
                                               F.sum(length).alias("micros"), (F.max(length) / F.lit(60e6)).alias("longest_minutes"))
    return sums.withColumn("mean_minutes", F.col("micros") / (F.col("n_sessions") * F.lit(60e6)))
