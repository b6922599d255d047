"""Incremental refresh: new monthly files update the counters of a restarted
query that resumes from its checkpoint."""

import datetime as dt

from pyspark.sql import types as T

from dialogscope import constants as K
from dialogscope.config import scratch_path
from dialogscope.functions.columns import zero_if_null
from dialogscope.sources import sinks
from dialogscope.streaming import refresh

SCHEMA = T.StructType([T.StructField("status", T.StringType()), T.StructField("month", T.StringType())])


def test_refresh_resumes_and_updates(spark):
    src = scratch_path(spark, "t-stream-src")
    folder = scratch_path(spark, "t-stream-out")
    first = spark.createDataFrame([(K.TAG_SUCCESS, "jan"), (K.TAG_EMPTY, "jan"), (None, "feb")], "status string, month string")
    first.write.mode("append").partitionBy("month").parquet(src)

    def run():
        stream = refresh.read_dialog_stream(spark, src, SCHEMA)
        q = refresh.start(refresh.month_counts(stream), f"{folder}/counts", f"{folder}/state", trigger={"availableNow": True})
        q.awaitTermination()
        return {r.month: r for r in refresh.latest(spark, f"{folder}/counts").collect()}

    got = run()
    assert (got["jan"].total, got["jan"].n_0, got["jan"].n_1) == (2, 1, 1)
    assert got["feb"].total == 1
    more = spark.createDataFrame([(K.TAG_SUCCESS, "jan"), (K.TAG_TASK, "mar")], "status string, month string")
    more.write.mode("append").partitionBy("month").parquet(src)
    got = run()  # restarted query: only the new files are read, state carries the rest
    assert (got["jan"].total, got["jan"].n_0) == (3, 2)
    assert got["mar"].n_2 == 1 and got["feb"].total == 1


def test_run_available(spark):
    src = scratch_path(spark, "t-stream-once")
    spark.createDataFrame([(K.TAG_SUCCESS, "x")] * 3, "status string, month string") \
        .write.partitionBy("month").parquet(src)
    row = refresh.run_available(spark, src, SCHEMA, names=["a", "b", "c", "d", "e", "f", "g", "h"]).first()
    assert (row.month, row.total, row.a) == ("x", 3, 3)


def test_export_name_and_zero_if_null(spark):
    assert sinks.export_name("Январь", dt.date(2026, 4, 5)) == "analytics_Январь_20260405"
    df = spark.createDataFrame([(None,), (3,)], "x int").select(zero_if_null("x").alias("x"))
    assert [r.x for r in df.collect()] == [0, 3] and dict(df.dtypes)["x"] == "bigint"
