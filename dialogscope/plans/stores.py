"""Named queries over structures that are built once and answer many questions - ordered event funnels, bitmap and posting indexes, sketch cubes, month
states - with their DuckDB SQL.  Each builds its structure from the driver's whole tables and answers from it."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..config import default_parallelism, remove_path, scratch_path
from ..operators import bitmap_facets, dropoff_chain, event_funnel, event_sessions, filters, report, skeleton, text_index, time_cube
from ..sources import bindings as B
from ..sources import quality, report_source, sinks, tables
from ..sources import skeleton_sources as SK
from ..sources.bucketed import BucketedTable
from ..sources.month_states import MonthStates
from . import catalog
from .catalog import EVENT_ORDER, GRADE, ROLE
from .oracle import ORACLE as CATALOG_ORACLE
from .oracle import lit, minutes, pct, with_dialogs
from .oracle_skeleton import EVENT_SKEL_CTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


# --- ordered event funnel (A-3/A-4 on raw events) ------------------------------

EVENT_STEPS = ["signup", "view", "click", "purchase"]
EVENT_DAYS = 2


def _event_funnel_sql() -> str:
    def chain(k: int, step: str) -> str:
        return (f"s{k} AS (SELECT p.u, p.first, p.t0, min(e.n) AS n FROM s{k - 1} p JOIN e ON e.u = p.u AND e.s = {lit(step)} AND e.n > p.n "
                f"AND e.ts <= p.t0 + INTERVAL {EVENT_DAYS} DAY GROUP BY p.u, p.first, p.t0)")

    steps = [f"s1 AS (SELECT u, n AS first, ts AS t0, n FROM e WHERE s = {lit(EVENT_STEPS[0])})", *[chain(k, s) for k, s in enumerate(EVENT_STEPS[1:], 2)]]
    stages = " UNION ALL ".join(f"SELECT {k} AS stage_no, {lit(s)} AS stage, (SELECT count(DISTINCT u) FROM s{k}) AS n_users, "
                                f"(SELECT count(DISTINCT u) FROM s{k}) - (SELECT count(DISTINCT u) FROM s{max(1, k - 1)}) AS n_drop, "
                                f"(SELECT count(DISTINCT u) FROM s1) AS n_first" for k, s in enumerate(EVENT_STEPS, 1))
    return ("WITH e AS (SELECT user_id AS u, ts, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events "
            f"WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IN ({', '.join(map(lit, EVENT_STEPS))})), {', '.join(steps)} "
            f"SELECT stage_no, stage, n_users, n_drop, {pct('n_users', 'n_first')} AS first_pct FROM ({stages})")


@query("funnel_events", _event_funnel_sql())
def q_funnel_events(spark, sf):
    """A-3/A-4 on raw events: users who took the steps in order within two days."""
    return event_funnel.ordered_funnel(B.table(spark, sf, "events"), EVENT_STEPS, _dt.timedelta(days=EVENT_DAYS))


# --- facet counts under the other filters (F-6/F-7) ----------------------------

FACETS = ["dialog_grade", "dialog_role", "product_slug", "status", "month"]
ACTIVE = {"dialog_grade": ["7", "9"], "dialog_role": ["BUILDING"], "month": ["1996-03", "1996-04", "1996-05"]}


def _facet_sql() -> str:
    chosen = {f: f"CAST({f} AS VARCHAR) IN ({', '.join(map(lit, v))})" for f, v in ACTIVE.items()}

    def others(f: str | None) -> str:
        return " AND ".join(c for g, c in chosen.items() if g != f)

    parts = [f"SELECT {lit(f)} AS facet, CAST({f} AS VARCHAR) AS value, count(*) FILTER (WHERE {others(f)}) AS n_dialogs FROM dialogs WHERE {f} IS NOT NULL GROUP BY 2" for f in FACETS]
    parts.append(f"SELECT '' AS facet, '' AS value, count(*) FILTER (WHERE {others(None)}) AS n_dialogs FROM dialogs")
    return with_dialogs(" UNION ALL ".join(parts))


@query("facet_counts_filtered", _facet_sql())
def q_facet_counts_filtered(spark, sf):
    """F-6/F-7: every facet value's count under the other active filters, from the bitmap index."""
    path = scratch_path(spark, "bitmap-index")
    bitmap_facets.write_index(B.dialogs(spark, sf, FACETS), FACETS, path)
    return _kept(bitmap_facets.facet_counts(bitmap_facets.read_index(spark, path), ACTIVE), path)


def _kept(result: DataFrame, *folders: str) -> DataFrame:
    """The result, checkpointed, with the structures it was read from removed."""
    out = result.checkpoint()
    for folder in folders:
        remove_path(result.sparkSession, folder)
    return out


# --- session times under any filter (A-8) --------------------------------------

CUBE_DIMS = ["month", "dialog_grade", "dialog_role"]
CUBE_ROLE = "MACHINERY"
CUBE_SQL = with_dialogs(
    f"SELECT dialog_grade, count(*) AS n, {minutes('avg(session_seconds)')} AS mean_minutes, round_even(avg(pupil_msgs), 1) AS mean_pupil_msgs, "
    f"round_even(avg(tutor_msgs), 1) AS mean_tutor_msgs, true AS within_bound FROM dialogs WHERE dialog_role = {lit(CUBE_ROLE)} AND month >= '1996-01' GROUP BY 1")


@query("time_cube", CUBE_SQL)
def q_time_cube(spark, sf):
    """A-8: means and medians per grade under a role and a period, from the stored cube; the median's rank is held against the bound of a sketch of half the size."""
    path = scratch_path(spark, "time-cube")
    rows = B.dialogs(spark, sf, [*CUBE_DIMS, "session_seconds", "pupil_msgs", "tutor_msgs"])
    time_cube.build(rows, CUBE_DIMS).write.parquet(path)
    chosen = (F.col("dialog_role") == CUBE_ROLE) & (F.col("month") >= "1996-01")
    answers = time_cube.stats(spark.read.parquet(path).where(chosen), ["dialog_grade"]).checkpoint()
    errors = time_cube.rank_errors(B.dialogs(spark, sf, [*CUBE_DIMS, "session_seconds"]).where(chosen), answers, ["dialog_grade"])
    errors = errors.select(F.col("dialog_grade").alias("_grade"), (F.col("rank_error") <= time_cube.rank_bound(time_cube.SKETCH_K // 2)).alias("within_bound"))
    met = answers.join(errors, F.col("dialog_grade").eqNullSafe(F.col("_grade")))
    return _kept(met.select("dialog_grade", "n", "mean_minutes", "mean_pupil_msgs", "mean_tutor_msgs", "within_bound"), path)


# --- months that come again or late (U-1/S-1, A-12/A-13) -------------------------

RELOADED, LATE = "1996-03", "1996-04"


@query("month_reload", with_dialogs(
    f"SELECT month, CAST(activity_dt AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success, "
    "count(session_seconds) AS n_seconds, CAST(sum(CAST(session_seconds AS DECIMAL(28,6))) AS DOUBLE) AS sum_seconds FROM dialogs GROUP BY 1, 2"))
def q_month_reload(spark, sf):
    """U-1/S-1, A-13: all months loaded, one of them wrong and then replaced, another in two files of which the late one comes twice; equals a full recompute."""
    states = MonthStates(spark, scratch_path(spark, "month-states"))
    d = B.dialogs(spark, sf, ["dialog_id", "month", "activity_dt", "status", "session_seconds"])
    odd = F.col("dialog_id").cast("bigint") % 2 == 1
    wrong = d.withColumn("session_seconds", F.when(F.col("month") == RELOADED, F.lit(1.0)).otherwise(F.col("session_seconds")))
    states.load(wrong.where((F.col("month") != LATE) | ~odd).unionByName(wrong.where(F.col("month") == RELOADED)))
    late = d.where((F.col("month") == LATE) & odd)
    states.load(late, "late")
    states.reload(d, [RELOADED])
    states.load(late, "late")
    return _kept(states.days(), states.root)


# --- text search by a trigram index (F-4) ----------------------------------------

SEARCHES = {"frequent": ("en", False), "letter": ("Q", False), "literal": ("Keiten", False), "accents": ("ÉLLE", False), "absent": ("zqxjw", False),
            "long": ("ution des", False), "regex": (r"chen.{1,3}keit\w+", True), "regex optional": (r"verein(en)? *und", True), "regex class": (r"[aeiou]{4}", True)}


def _search_sql() -> str:
    def match(q: str, regex: bool) -> str:
        return f"regexp_matches(text, {lit('(?i)' + q)})" if regex else f"contains(lower(text), lower({lit(q)}))"
    return " UNION ALL ".join(f"SELECT {lit(n)} AS search, conv_id, turn FROM conversations WHERE {match(*q)}" for n, q in SEARCHES.items())


@query("text_search_indexed", _search_sql())
def q_text_search_indexed(spark, sf):
    """F-4: literal and regex searches in all texts, from the trigram index."""
    path = scratch_path(spark, "text-index")
    text_index.write_index(B.table(spark, sf, "conversations"), ["conv_id", "turn"], "text", path)
    found = [text_index.search(spark, path, q, regex).select(F.lit(n).alias("search"), "conv_id", "turn") for n, (q, regex) in SEARCHES.items()]
    return _kept(reduce(DataFrame.unionByName, found), path)


# --- joins without a shuffle (J-1) ------------------------------------------------

@query("skeleton_semi_bucketed", CATALOG_ORACLE["skeleton_semi"])
def q_skeleton_semi_bucketed(spark, sf):
    """J-1 over bucketed tables: equals ``skeleton_semi``, without an exchange."""
    n = default_parallelism(spark)
    dialogs = BucketedTable.write(B.dialogs(spark, sf, ["dialog_id", "month", "dialog_grade", "dialog_role"]), "dialogs", n, month_col="month")
    blocks = BucketedTable.write(SK.event_blocks(spark, sf), "blocks", n)
    out = semi_bucketed(dialogs, blocks).checkpoint()
    dialogs.drop()
    blocks.drop()
    return out


def semi_bucketed(dialogs: BucketedTable, blocks: BucketedTable) -> DataFrame:
    kept = filters.apply_filters(dialogs.read(), grade=GRADE, role=ROLE)
    return skeleton.dropoff(filters.skeletons_for(blocks.read(), kept), EVENT_ORDER).select("dialog_id", "n_blocks", "last_type")


# --- what a read could not understand (P-2, F-5) ------------------------------------

@query("read_quality", with_dialogs(
    "SELECT reason, n_rows FROM (SELECT count(*) AS r0, count(*) FILTER (WHERE k % 10 = 0 OR k % 14 = 0 OR k % 27 = 0 OR k % 23 = 0) AS r1, "
    "count(*) FILTER (WHERE k % 23 = 0) AS r2, count(*) FILTER (WHERE k % 10 = 0) AS r3, count(*) FILTER (WHERE k % 14 = 0) AS r4, "
    "count(*) FILTER (WHERE k % 27 = 0) AS r5 FROM (SELECT CAST(dialog_id AS BIGINT) AS k FROM dialogs)), "
    "LATERAL (VALUES ('rows', r0), ('bad', r1), ('no_id', r2), ('date', r3), ('grade', r4), ('seconds', r5)) v(reason, n_rows)"))
def q_read_quality(spark, sf):
    """P-2/F-5: all dialogs as source files with bad cells, read once: rows per reason, bad rows set apart."""
    root, n = scratch_path(spark, "quality"), F.col("dialog_id").cast("bigint")
    bad = lambda m, word, c: F.when(n % m == 0, F.lit(word)).otherwise(F.col(c).cast("string"))
    catalog._month_files(spark, sf, root, lambda d: d.withColumns({
        "activity_dt": F.when(n % 10 == 0, F.lit("31.02.1996")).otherwise(F.date_format("activity_dt", "yyyy-MM-dd HH:mm:ss")),
        "dialog_grade": bad(14, "seven", "dialog_grade"), "session_seconds": bad(27, "1:02:03", "session_seconds"),
        "dialog_id": F.when(n % 23 != 0, F.col("dialog_id"))}))
    raw = tables.read_table(spark, root, "chart_data", schema=quality.TEXT_SCHEMA)
    counts = quality.quarantine(raw, f"{root}/checked")
    stored = quality.stored(spark, f"{root}/checked").groupBy(quality.FLAG).agg(F.count(F.lit(1)).alias("n")).collect()
    if {r[0]: r.n for r in stored} != {k: v for k, v in ((True, counts["bad"]), (False, counts["rows"] - counts["bad"])) if v}:
        raise AssertionError("the stored rows are not those that were counted")
    remove_path(spark, root)
    return spark.createDataFrame(list(counts.items()), "reason string, n_rows bigint")


# --- sessions of raw events (A-8) -----------------------------------------------------

GAP, DELAY = _dt.timedelta(hours=6), _dt.timedelta(hours=1)


def _sessions_sql(closed: str = "") -> str:
    hours = GAP // _dt.timedelta(hours=1)
    return (f"WITH e AS (SELECT user_id AS u, ts, coalesce(ts > lag(ts) OVER w + INTERVAL {hours} HOUR, true) AS starts FROM events "
            "WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
            "g AS (SELECT u, ts, sum(starts::INT) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM e), "
            f"s AS (SELECT min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY u, island {closed}), "
            "d AS (SELECT CAST(first_at AS DATE) AS day, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, "
            "CAST(sum(epoch_us(last_at) - epoch_us(first_at)) AS BIGINT) AS micros, max(epoch_us(last_at) - epoch_us(first_at)) / 60e6::DOUBLE AS longest_minutes FROM s GROUP BY 1) "
            "SELECT *, micros / (n_sessions * 60e6::DOUBLE) AS mean_minutes FROM d")


@query("session_stats_events", _sessions_sql())
def q_session_stats_events(spark, sf):
    """A-8 on raw events: sessions of every user, per day."""
    return event_sessions.daily(event_sessions.sessions(B.table(spark, sf, "events"), GAP))


@query("session_stream_events", _sessions_sql(
    f"HAVING max(ts) + INTERVAL {GAP // _dt.timedelta(hours=1)} HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE user_id IS NOT NULL) "
    f"- INTERVAL {DELAY // _dt.timedelta(hours=1)} HOUR"))
def q_session_stream_events(spark, sf):
    """A-8 as a stream over all events: the sessions that the watermark has closed, per day."""
    root = scratch_path(spark, "event-stream")
    B.table(spark, sf, "events").select("user_id", "ts").write.parquet(f"{root}/source")
    return _kept(event_sessions.daily(event_sessions.run_available(spark, f"{root}/source", GAP, DELAY, f"{root}/out")), root)


# --- where dialogs are lost in the long run (B-8, B-11) ----------------------------------

def _chain_sql(doublings: int = 13) -> str:
    """The same system by doubling: x <- x + M x, M <- M M."""
    lost = " OR ".join(f"starts_with(block, {lit(t)})" for t in K.DEEPER_TYPES)
    parts = [f"WITH {EVENT_SKEL_CTE}", "mv AS MATERIALIZED (SELECT block, lead(block) OVER (PARTITION BY dialog_id ORDER BY pos) AS next FROM blocks)",
             "st AS MATERIALIZED (SELECT block, count(*) AS n, count(*) FILTER (WHERE next IS NULL) AS ends FROM mv GROUP BY 1)",
             "m0 AS MATERIALIZED (SELECT mv.block AS a, mv.next AS b, count(*) / any_value(st.n)::DOUBLE AS w FROM mv JOIN st USING (block) WHERE mv.next IS NOT NULL GROUP BY 1, 2)",
             f"x0 AS MATERIALIZED (SELECT block AS a, CASE WHEN {lost} THEN ends / n::DOUBLE ELSE 0 END AS p, 1::DOUBLE AS t FROM st)"]
    for k in range(doublings):
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT x.a, x.p + coalesce(y.p, 0) AS p, x.t + coalesce(y.t, 0) AS t FROM x{k} x LEFT JOIN "
                     f"(SELECT m.a, sum(m.w * z.p) AS p, sum(m.w * z.t) AS t FROM m{k} m JOIN x{k} z ON z.a = m.b GROUP BY 1) y USING (a))")
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT l.a, r.b, sum(l.w * r.w) AS w FROM m{k} l JOIN m{k} r ON r.a = l.b GROUP BY 1, 2)")
    return ", ".join(parts) + f" SELECT block, n, round(p, 6) AS p_drop, round(t - 1, 6) AS mean_left FROM x{doublings} x JOIN st ON st.block = x.a"


@query("skel_dropoff_chain", _chain_sql())
def q_skel_dropoff_chain(spark, sf):
    """B-8/B-11: per block text the probability that a dialog standing there ends as a drop-off, and the mean number of blocks to come."""
    solved = dropoff_chain.solve(dropoff_chain.transitions(SK.event_blocks(spark, sf), EVENT_ORDER))
    return solved.select("block", "n", F.round("p_drop", 6).alias("p_drop"), F.round("mean_left", 6).alias("mean_left"))


# --- report files as a data source (S-1, S-5) ----------------------------------

def _report_files(spark, sf) -> str:
    root = scratch_path(spark, "report-source")
    full = report.full_report(B.dialogs(spark, sf).select("month", "status", "status_post"), by="month")
    sinks.write_report_files(full, root)
    return root


@query("report_source", CATALOG_ORACLE["report_tidy"])
def q_report_source(spark, sf):
    """S-5: every month's report file through the data source, one task per file."""
    root = _report_files(spark, sf)
    return _kept(report_source.read_reports(spark, f"{root}/report"), root)


REPORT_MONTHS = ["1995-03", "1996-03", "1997-03"]


@query("report_source_months", f"SELECT * FROM ({CATALOG_ORACLE['report_tidy']}) WHERE month IN ({', '.join(map(lit, REPORT_MONTHS))})")
def q_report_source_months(spark, sf):
    """S-1/S-5: three months side by side out of all report files; the others are not opened."""
    root = _report_files(spark, sf)
    return _kept(report_source.read_reports(spark, f"{root}/report").where(F.col("month").isin(REPORT_MONTHS)), root)
