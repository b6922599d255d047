"""Sessions of raw events against plain Python, and the stream against the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dialogscope.config import scratch_path
from dialogscope.operators import event_sessions

T0 = dt.datetime(2024, 3, 31)
GAP = dt.timedelta(minutes=30)
TYPE = "user_id long, ts timestamp_ntz, ts_text string"


def plain(rows, gap=GAP):
    by, out = {}, []
    for user, at, *_ in rows:
        if user is not None and at is not None:
            by.setdefault(user, []).append(at)
    for user, times in by.items():
        times.sort()
        start, n = times[0], 0
        for k, at in enumerate(times):
            n += 1
            if k + 1 == len(times) or times[k + 1] - at > gap:
                out.append((user, start, at, n))
                start, n = (times[k + 1] if k + 1 < len(times) else None), 0
    return sorted(out)


def collected(df):
    us = [F.unix_micros(c).alias(c) for c in ("first_at", "last_at")]
    back = lambda x: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=x)
    return sorted((r.user, back(r.first_at), back(r.last_at), r.n_events) for r in df.select("user", *us, "n_events").collect())


def events(seed, n=900, users=40, hot=7):
    chance = random.Random(seed)
    rows = [(hot if k % 3 == 0 else chance.randrange(users), T0 + dt.timedelta(seconds=chance.randrange(86400 * 9), microseconds=chance.randrange(10 ** 6)), "") for k in range(n)]
    rows += [(hot + 50, T0 + k * (GAP + dt.timedelta(microseconds=1)), "") for k in range(4)]  # just too far apart: sessions of their own
    rows += [(hot + 100, T0 + k * GAP, "") for k in range(50)]  # one session over many chunks
    return rows + rows[:20] + [(None, T0, ""), (3, None, ""), (99, T0, "")]


@pytest.mark.parametrize("chunks", [1, 5, 60])
def test_sessions_with_a_hot_user(spark, chunks):
    rows = events(chunks)
    got = event_sessions.sessions(spark.createDataFrame(rows, TYPE), GAP, range_partitions=chunks)
    assert collected(got) == plain(rows)


def test_zone_and_type_of_time_do_not_matter(spark):
    rows = events(9)
    df = spark.createDataFrame(rows, TYPE)
    as_instants = df.withColumn("ts", event_sessions._instant(df, "ts"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # the clocks change on the first day
        assert collected(event_sessions.sessions(df, GAP)) == plain(rows)
        assert collected(event_sessions.sessions(as_instants, GAP)) == plain(rows)
        days = {r.day for r in event_sessions.daily(event_sessions.sessions(df, GAP)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert days == {s[1].date() for s in plain(rows)}


def test_empty_table_and_gap(spark):
    empty = spark.createDataFrame([], TYPE)
    assert event_sessions.sessions(empty, GAP).count() == 0 and event_sessions.daily(event_sessions.sessions(empty, GAP)).count() == 0
    with pytest.raises(ValueError):
        event_sessions.sessions(empty, dt.timedelta(0))


def test_hot_user_is_spread(spark):
    plan = event_sessions.sessions(spark.createDataFrame(events(3), TYPE), GAP, range_partitions=6)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and plan.count("hashpartitioning(user") == 2 and "hashpartitioning(user#" in plan and "_own" in plan


def test_stream_equals_batch_and_drops_late_events(spark):
    source, folder = scratch_path(spark, "t-events"), scratch_path(spark, "t-sessions")
    delay = dt.timedelta(hours=1)
    rows = [r for r in events(4) if r[0] is not None and r[1] is not None]
    end = max(r[1] for r in rows)
    run = lambda: collected(event_sessions.run_available(spark, source, GAP, delay, folder))
    spark.createDataFrame(rows, TYPE).write.parquet(source)
    first = run()
    assert first == [s for s in plain(rows) if s[2] + GAP <= end - delay]
    # An event within the delay still counts, one behind the watermark is dropped; a far event closes everything.
    more = [(3, end - delay / 2, ""), (4, end - 3 * delay, ""), (1000, end + dt.timedelta(days=30), "")]
    spark.createDataFrame(more, TYPE).write.mode("append").parquet(source)
    assert run() == plain(rows + more[:1])
    assert run() == plain(rows + more[:1])  # nothing new: nothing given twice
