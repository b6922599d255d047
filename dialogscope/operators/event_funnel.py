"""Ordered funnels over raw events (A-3/A-4 for an event table).

A user reaches step k if events of the steps 1 ... k follow one another in time
order, the last at most ``within`` after the first.

Rows are range-partitioned by (user, time), so a user with a third of all events is spread over as many chunks as the rows need.
Inside a chunk one sort serves all windows, which give

* for each level k the latest start of a chain 1 ... k that lies in the chunk (a later start is never worse), and
* for each pair j < k the earliest time by which a chain that enters the chunk at level j reaches level k.

That is all a chunk's rows can do to a chain, in a row of fixed size; a user's chunks, in order, are then folded over the level's latest
starts.  The fold is associative, so where the chunks' borders lie does not change the result.

Rows without user or time, and events of other types, are left out (by filters that reach the scan).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import default_parallelism


def _interval(within: _dt.timedelta) -> Column:
    return F.make_dt_interval(F.lit(within.days), F.lit(0), F.lit(0), F.lit(within.seconds + within.microseconds / 1e6))


def _chunk_summaries(events: DataFrame, m: int, span: Column, n_chunks: int) -> DataFrame:
    """One row per (user, chunk): ``starts`` (m latest starts) and ``gains`` (m x m earliest arrivals, row j column k)."""
    order = ["_user", "_at", "_tie", "_step"]
    chunked = events.repartitionByRange(n_chunks, *order).withColumn("_chunk", F.spark_partition_id())
    w = Window.partitionBy("_user", "_chunk").orderBy("_at", "_tie", "_step")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunked.withColumn("s1", F.when(F.col("_step") == 1, F.col("_at")))
    for k in range(2, m + 1):
        rows = rows.withColumn("_prev", F.max(f"s{k - 1}").over(before))
        rows = rows.withColumn(f"s{k}", F.when((F.col("_step") == k) & (F.col("_at") <= F.col("_prev") + span), F.col("_prev")))
    for j in range(1, m):
        for k in range(j + 1, m + 1):
            arrived = F.lit(True) if k == j + 1 else F.min(f"g{j}_{k - 1}").over(before).isNotNull()
            rows = rows.withColumn(f"g{j}_{k}", F.when((F.col("_step") == k) & arrived, F.col("_at")))
    none = F.lit(None)
    found = rows.groupBy("_user", "_chunk").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(1, m + 1)],
                                                *[F.min(f"g{j}_{k}").alias(f"g{j}_{k}") for j in range(1, m) for k in range(j + 1, m + 1)])
    gains = F.array(*[F.array(*[F.col(f"g{j}_{k}") if j < k else none for k in range(1, m + 1)]) for j in range(1, m + 1)])
    return found.select("_user", "_chunk", F.array(*[f"s{k}" for k in range(1, m + 1)]).alias("starts"), gains.alias("gains"))


def steps_reached(events: DataFrame, steps: Sequence[str], within: _dt.timedelta, user_col: str = "user_id", time_col: str = "ts",
                  tie_col: str = "event_id", type_col: str = "event_type", range_partitions: int | None = None) -> DataFrame:
    """(user, reached): for every user with an event of some step, how many steps were taken in order."""
    m, span = len(steps), _interval(within)
    step = F.array_position(F.array(*map(F.lit, steps)), F.col(type_col)).cast("int")
    rows = (events.where(F.col(type_col).isin(*steps) & F.col(user_col).isNotNull() & F.col(time_col).isNotNull())
            .select(F.col(user_col).alias("_user"), F.col(time_col).alias("_at"), F.col(tie_col).alias("_tie"), step.alias("_step")))
    at = dict(rows.dtypes)["_at"]
    summaries = _chunk_summaries(rows, m, span, range_partitions or default_parallelism(events.sparkSession))

    def merged(state: Column, chunk: Column) -> Column:
        def level(k: int) -> Column:
            carried = [F.when(chunk["gains"][j][k] <= state[j] + span, state[j]) for j in range(k)]
            best = [chunk["starts"][k], state[k], *carried]
            return F.greatest(*best)
        return F.array(*[level(k) for k in range(m)])

    start = F.array(*[F.lit(None).cast(at) for _ in steps])
    chunks = F.sort_array(F.collect_list(F.struct("_chunk", "starts", "gains")))  # one row per chunk, not per event
    folded = summaries.groupBy("_user").agg(chunks.alias("c")).select("_user", F.aggregate("c", start, merged).alias("levels"))
    return folded.select(F.col("_user").alias(user_col), F.size(F.filter("levels", lambda x: x.isNotNull())).alias("reached"))


def ordered_funnel(events: DataFrame, steps: Sequence[str], within: _dt.timedelta, **columns) -> DataFrame:
    """stage_no, stage, n_users, n_drop (against the stage before), first_pct (share of the first stage)."""
    if len(set(steps)) != len(steps) or not steps:
        raise ValueError("steps must be different and not empty")
    reached = steps_reached(events, steps, within, **columns)
    counts = reached.agg(*[F.count_if(F.col("reached") >= k).alias(f"n{k}") for k in range(1, len(steps) + 1)])
    stages = [F.struct(F.lit(k).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"n{k}").alias("n_users"),
                       (F.col(f"n{k}") - F.col(f"n{max(1, k - 1)}")).alias("n_drop"),
                       F.bround(F.try_divide(F.col(f"n{k}") * 100.0, F.col("n1")), 1).alias("first_pct")) for k, s in enumerate(steps, 1)]
    return counts.select(F.inline(F.array(*stages)))
