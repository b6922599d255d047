"""Named queries: one per operator of the inventory, each ``(spark, sf_dir) ->
DataFrame`` over the driver's tables (whole tables, no row caps).

Parameters of filter-style queries are fixed here and mirrored in
``oracle.py``; they are what a dashboard user would pick.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..config import remove_path, scratch_dir, scratch_path
from ..functions.columns import as_date, parse_ts, zero_if_null
from ..operators import browse, classes, compare, filters, funnel, metrics, report, skeleton
from ..sources import bindings as B
from ..sources import report_file, sinks, tables
from ..sources import skeleton_sources as SK
from ..streaming import refresh
from .dashboard import Dashboard

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed parameters of the filter queries (mirrored in oracle.py).
GRADE = "7"
ROLE = "BUILDING"
PRODUCT = "1-URGENT"
PERIOD = ("1996-03-01", "1996-05-31")
SEARCH = "123"
TOP_K = 20

# Column names of the one-row tag count (A-2), in STAGE1_REPORT_TAGS order.
TAG_COUNT_NAMES = ["n_success", "n_empty", "n_task", "n_not_math", "n_out_of_grades",
                   "n_coming_soon", "n_left_after_match", "n_match_failed"]


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def _dialogs(spark, sf, *cols):
    return B.dialogs(spark, sf, cols)


# --- funnels ----------------------------------------------------------------

@query("tag_counts")
def q_tag_counts(spark, sf):
    return funnel.tag_counts(_dialogs(spark, sf, "status"), "status", K.STAGE1_REPORT_TAGS, TAG_COUNT_NAMES)


@query("funnel_matching")
def q_funnel_matching(spark, sf):
    return funnel.matching_funnel(_dialogs(spark, sf, "status"))


@query("funnel_post")
def q_funnel_post(spark, sf):
    return funnel.post_funnel(_dialogs(spark, sf, "status", "status_post"))


@query("funnel_post_rate")
def q_funnel_post_rate(spark, sf):
    return funnel.post_funnel_rate(_dialogs(spark, sf, "status", "status_post"))


@query("funnel_text")
def q_funnel_text(spark, sf):
    return funnel.with_funnel_text(funnel.matching_funnel(_dialogs(spark, sf, "status")))


# --- dynamics, KPIs, time ----------------------------------------------------

@query("dyn_daily")
def q_dyn_daily(spark, sf):
    return metrics.daily_counts(_dialogs(spark, sf, "activity_dt", "status"))


@query("kpi_headline")
def q_kpi_headline(spark, sf):
    return metrics.kpis(_dialogs(spark, sf, "status", "session_seconds"))


@query("time_summary")
def q_time_summary(spark, sf):
    return metrics.session_stats(_dialogs(spark, sf, "session_seconds", "pupil_msgs", "tutor_msgs"),
                                 seconds=_dialogs(spark, sf, "session_seconds"))


APPROX_ACCURACY = 10000


@query("time_summary_approx")
def q_time_summary_approx(spark, sf):
    """A-8 with the approximate median, given by its promise: its rank is at most n/accuracy from the middle."""
    d = _dialogs(spark, sf, "session_seconds")
    error = metrics.rank_error(d, "session_seconds", metrics.approx_median(d, "session_seconds", APPROX_ACCURACY))
    return error.select("n", (F.col("rank_error") <= F.col("n") / APPROX_ACCURACY + 1).alias("within_bound"))


@query("kpi_nan_default_period")
def q_kpi_nan_default_period(spark, sf):
    """A-7/F-2: some times are NaN, some dates are missing: means skip NaN, the default period drops undated rows."""
    seconds, id_no = F.col("session_seconds"), F.col("dialog_id").cast("bigint")
    d = _dialogs(spark, sf, "dialog_id", "activity_dt", "status", "session_seconds")
    d = d.withColumns({"session_seconds": F.when(id_no % 37 == 0, F.lit(float("nan"))).otherwise(seconds.cast("double")),
                       "activity_dt": F.when(id_no % 41 != 0, F.col("activity_dt"))})
    return Dashboard(d).kpis()


@query("metric_cards")
def q_metric_cards(spark, sf):
    """P-10: the metric columns found by the parts of their (source) names, each with its mean."""
    return metrics.metric_cards(sinks.with_source_names(_dialogs(spark, sf, "session_seconds", "pupil_msgs", "tutor_msgs", "status")))


@query("zero_filled")
def q_zero_filled(spark, sf):
    """P-13: per product the sum of the grades, a missing grade counted as 0."""
    d = _dialogs(spark, sf, "product_slug", "dialog_grade")
    return d.groupBy("product_slug").agg(F.sum(zero_if_null("dialog_grade")).alias("grades"))


@query("required_columns")
def q_required_columns(spark, sf):
    """F-8: for each wanted column whether the guard lets the table pass, with the rows it then has."""
    d = _dialogs(spark, sf, "dialog_id", "status")

    def passes(name):
        try:
            filters.require(d, name)
            return True
        except KeyError:
            return False

    checks = F.array(*[F.struct(F.lit(n).alias("wanted"), F.lit(passes(n)).alias("present")) for n in ("status", "dialog_id", "no_such_column")])
    return d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(checks), "n_rows")


@query("top_sessions")
def q_top_sessions(spark, sf):
    d = _dialogs(spark, sf, "dialog_id", "session_seconds", "dialog_grade", "dialog_role", "product_slug")
    return metrics.top_sessions(d, TOP_K)


@query("period_bounds")
def q_period_bounds(spark, sf):
    return metrics.period_bounds(_dialogs(spark, sf, "activity_dt"))


@query("proj_parse_dt")
def q_proj_parse_dt(spark, sf):
    """P-1/P-2/P-3 on text timestamps derived from ``events.ts``: every tenth
    row is junk, every tenth+1 a bare date, every tenth+2 empty."""
    ev = B.table(spark, sf, "events")
    raw = (F.when(F.col("event_id") % 10 == 0, F.lit("not a date"))
           .when(F.col("event_id") % 10 == 1, F.date_format("ts", "yyyy-MM-dd"))
           .when(F.col("event_id") % 10 == 2, F.lit(""))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    parsed = ev.select("event_id", parse_ts(raw).alias("parsed"))
    return parsed.select("event_id", as_date("parsed").alias("activity_date"),
                         F.col("parsed").isNotNull().alias("is_valid"))


# --- filters -------------------------------------------------------------------

FILTER_COLS = ("dialog_id", "activity_dt", "dialog_grade", "dialog_role", "product_slug", "status")


def _filtered_rows(df: DataFrame) -> DataFrame:
    return df.select("dialog_id", as_date("activity_dt").alias("date"), "dialog_grade", "dialog_role",
                     "product_slug", "status")


@query("filter_dims")
def q_filter_dims(spark, sf):
    d = _dialogs(spark, sf, *FILTER_COLS)
    return _filtered_rows(filters.apply_filters(d, grade=GRADE, role=ROLE, product=PRODUCT))


@query("filter_period")
def q_filter_period(spark, sf):
    d = _dialogs(spark, sf, *FILTER_COLS)
    return _filtered_rows(filters.apply_filters(d, period=PERIOD))


@query("filter_all")
def q_filter_all(spark, sf):
    d = _dialogs(spark, sf, *FILTER_COLS)
    kept = filters.apply_filters(d, grade=GRADE, role=ROLE, product=K.ALL, period=PERIOD)
    return funnel.matching_funnel(kept)


@query("filter_effect")
def q_filter_effect(spark, sf):
    d = _dialogs(spark, sf, *FILTER_COLS)
    return filters.filter_effect(d, grade=GRADE, role=ROLE, product=PRODUCT, period=PERIOD)


@query("facet_values")
def q_facet_values(spark, sf):
    return filters.facets(_dialogs(spark, sf, "dialog_grade", "dialog_role", "product_slug"),
                          ["dialog_grade", "dialog_role", "product_slug"])


@query("facet_grades")
def q_facet_grades(spark, sf):
    """F-6: the grades on offer, as numbers in order."""
    return filters.facet_values(_dialogs(spark, sf, "dialog_grade"), "dialog_grade")


@query("dialog_search")
def q_dialog_search(spark, sf):
    d = _dialogs(spark, sf, "dialog_id", "status")
    return filters.search_dialog(d, SEARCH, first=False)


@query("dialog_search_first")
def q_dialog_search_first(spark, sf):
    d = _dialogs(spark, sf, "dialog_id", "status")
    return filters.search_dialog(d, SEARCH, first=True)


# --- comparison ------------------------------------------------------------------

@query("cmp_conversion")
def q_cmp_conversion(spark, sf):
    return metrics.monthly_conversion(_dialogs(spark, sf, "month", "status"))


@query("cmp_months_named")
def q_cmp_months_named(spark, sf):
    """U-1/S-3: two months chosen by their names, from a table that holds file prefixes."""
    d = _with_prefix(_dialogs(spark, sf, "activity_dt", "status"))
    return metrics.monthly_conversion(compare.select_months(d, list(K.MONTH_PREFIX)[1:3]))


@query("month_routing")
def q_month_routing(spark, sf):
    """S-3: month name → file prefix, and the dialogs under each."""
    routes = F.array(*[F.struct(F.lit(m).alias("month_name"), F.lit(tables.month_prefix(m)).alias("prefix")) for m in K.MONTH_PREFIX])
    counts = _with_prefix(_dialogs(spark, sf, "activity_dt")).groupBy("month").agg(F.count(F.lit(1)).alias("n_dialogs"))
    return counts.select("month", "n_dialogs", F.explode(F.filter(routes, lambda r: r["prefix"] == F.col("month"))).alias("r")).select(
        "r.month_name", "r.prefix", "n_dialogs")


@query("cmp_conversion_filtered")
def q_cmp_conversion_filtered(spark, sf):
    """The comparison view with the sidebar's grade and role applied — and,
    as in the dashboard, never its period."""
    d = _dialogs(spark, sf, "month", "status", "dialog_grade", "dialog_role", "activity_dt")
    return metrics.monthly_conversion(compare.comparison_filter(d, grade=GRADE, role=ROLE))


@query("cmp_daily")
def q_cmp_daily(spark, sf):
    return metrics.monthly_daily_counts(_dialogs(spark, sf, "month", "activity_dt"))


# --- classes / subjects ------------------------------------------------------------

@query("subject_sum")
def q_subject_sum(spark, sf):
    return classes.subject_totals(B.class_stats(spark, sf)).select("subject", "pupils")


@query("subject_share")
def q_subject_share(spark, sf):
    return classes.subject_totals(B.class_stats(spark, sf))


@query("class_bars")
def q_class_bars(spark, sf):
    return classes.grade_totals(B.class_stats(spark, sf))


# --- report ---------------------------------------------------------------------

@query("report_stage1")
def q_report_stage1(spark, sf):
    return report.stage1_report(_dialogs(spark, sf, "status", "status_post"))


@query("report_stage2")
def q_report_stage2(spark, sf):
    return report.stage2_report(_dialogs(spark, sf, "status", "status_post"))


@query("report_conversion")
def q_report_conversion(spark, sf):
    return report.conversion_report(_dialogs(spark, sf, "status", "status_post"))


@query("conv_overall")
def q_conv_overall(spark, sf):
    """P-11 ratios per month: the full three-section report for every month."""
    return report.full_report(_dialogs(spark, sf, "month", "status", "status_post"), by="month")


# --- skeletons ----------------------------------------------------------------------

EVENT_ORDER = ("ts", "event_id")


def _text_state(spark, sf):
    return skeleton.parse_skeletons(SK.text_skeletons(spark, sf))


def _event_state(spark, sf):
    return skeleton.parse_block_stream(SK.event_blocks(spark, sf), EVENT_ORDER)


@query("skel_blocks")
def q_skel_blocks(spark, sf):
    """B-1 … B-6 over the text skeleton cells."""
    return _text_state(spark, sf).select(*skeleton.BLOCK_COLUMNS)


@query("skel_blocks_events")
def q_skel_blocks_events(spark, sf):
    """B-2 … B-6 over event-ordered blocks (all seven block types)."""
    return _event_state(spark, sf).select(*skeleton.BLOCK_COLUMNS)


@query("skel_blocks_hot")
def q_skel_blocks_hot(spark, sf):
    """Skew case of B-2 … B-6: a third of all events in ONE dialog, parsed
    with range chunks (the hot dialog is spread over many tasks)."""
    state = skeleton.parse_block_stream(SK.event_blocks(spark, sf, hot=True), EVENT_ORDER)
    return state.select(*skeleton.BLOCK_COLUMNS)


@query("skel_blocks_dup")
def q_skel_blocks_dup(spark, sf):
    """B-1 … B-6 where ids repeat and some are null: every cell is its own walk."""
    return skeleton.parse_skeletons(SK.repeated_skeletons(spark, sf)).select(*skeleton.BLOCK_COLUMNS)


@query("skel_blocks_long")
def q_skel_blocks_long(spark, sf):
    """B-1 … B-6 over long cells: each cell's lines 25 times in a row."""
    return skeleton.parse_skeletons(SK.long_skeletons(spark, sf)).select(*skeleton.BLOCK_COLUMNS)


@query("skel_labels")
def q_skel_labels(spark, sf):
    return skeleton.with_labels(_text_state(spark, sf))


@query("skel_jumps")
def q_skel_jumps(spark, sf):
    return skeleton.jumps(_event_state(spark, sf))


@query("skel_dropoff")
def q_skel_dropoff(spark, sf):
    return skeleton.dropoff(SK.event_blocks(spark, sf), EVENT_ORDER)


@query("skel_excerpt")
def q_skel_excerpt(spark, sf):
    return skeleton.block_excerpts(SK.text_skeletons(spark, sf))


@query("skel_rollup")
def q_skel_rollup(spark, sf):
    return skeleton.dropoff_rollup(_event_state(spark, sf))


@query("skeleton_quality")
def q_skeleton_quality(spark, sf):
    return skeleton.skeleton_quality(SK.text_skeletons(spark, sf))


# --- skeleton joins and browsing ---------------------------------------------------

@query("skeleton_semi")
def q_skeleton_semi(spark, sf):
    """J-1: skeletons of the dialogs passing the sidebar filters."""
    kept = filters.apply_filters(_dialogs(spark, sf, "dialog_id", "dialog_grade", "dialog_role"),
                                 grade=GRADE, role=ROLE)
    blocks = filters.skeletons_for(SK.event_blocks(spark, sf), kept)  # filter first, then aggregate
    return skeleton.dropoff(blocks, EVENT_ORDER).select("dialog_id", "n_blocks", "last_type")


@query("top_sessions_skeleton")
def q_top_sessions_skeleton(spark, sf):
    """J-4: the 20 users with the longest total event time and their blocks."""
    sessions = (B.table(spark, sf, "events")
                .groupBy(F.format_string("%08d", F.col("user_id")).alias("dialog_id"))
                .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("session_seconds")))
    return browse.top_sessions_with_skeleton(sessions, SK.event_blocks(spark, sf),
                                             lambda b: skeleton.parse_block_stream(b, EVENT_ORDER), TOP_K)


@query("dialog_options")
def q_dialog_options(spark, sf):
    return browse.dialog_options(SK.text_skeletons(spark, sf), 100)


@query("skeleton_browse")
def q_skeleton_browse(spark, sf):
    return browse.browse_skeletons(SK.text_skeletons(spark, sf), 50)


# --- sources and sinks (round trips through files Spark writes) -------------------------

def _with_prefix(d: DataFrame, n: int = len(K.MONTH_PREFIX)) -> DataFrame:
    """All dialogs, each with one of the first n file prefixes: the calendar months take them in turn."""
    months = F.array(*[F.lit(p) for p in list(K.MONTH_PREFIX.values())[:n]])
    return d.withColumn("month", F.get(months, (F.month("activity_dt") - 1) % n))


def _kept(result: DataFrame, *folders: str) -> DataFrame:
    """The result of reading files back, checkpointed, with the files removed."""
    spark = result.sparkSession
    scratch_dir(spark)
    out = result.checkpoint()
    for folder in folders:
        remove_path(spark, folder)
    return out


def _dialog_rows(df: DataFrame) -> DataFrame:
    """Every row of a dialog table that was read back, in comparable types."""
    return df.select("month", "dialog_id", as_date("activity_dt").alias("day"), "dialog_grade", "dialog_role", "product_slug",
                     "status", "status_post", F.col("session_seconds").cast("double").alias("session_seconds"))


ROW_COLS = ("dialog_id", "activity_dt", "month", "dialog_grade", "dialog_role", "product_slug", "status", "status_post", "session_seconds")


@query("src_monthly_read")
def q_src_monthly_read(spark, sf):
    """S-1/S-2/P-12: the dialogs written as monthly CSV folders and read back with one multi-path read, row by row."""
    root = scratch_path(spark, "monthly")
    d = sinks.with_source_names(_dialogs(spark, sf, *ROW_COLS))
    sinks.write_monthly(d, root, "chart_data", month_col=K.SRC_MONTH)
    back = tables.read_table(spark, root, "chart_data", None, partitioned=True, month_dir=K.SRC_MONTH)
    return _kept(_dialog_rows(tables.canonical_dialogs(back)), root)


@query("export_csv")
def q_export_csv(spark, sf):
    """K-1: the dashboard's export, with the source's headers, read back as a source file, row by row."""
    root = scratch_path(spark, "export")
    path = Dashboard(_dialogs(spark, sf, *[c for c in ROW_COLS if c != "month"]), role=ROLE).export(root, "jan")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/jan_chart_data.csv")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(path), target)
    back = tables.read_table(spark, root, "chart_data", ["jan"])
    return _kept(_dialog_rows(tables.canonical_dialogs(back)), root)


def _month_files(spark, sf, root: str, change, n: int = len(K.MONTH_PREFIX)) -> None:
    """All dialogs as source files ``{prefix}_chart_data.csv`` of the first n prefixes, changed by ``change``."""
    d = change(_with_prefix(_dialogs(spark, sf, *[c for c in ROW_COLS if c != "month"]), n))
    for prefix in list(K.MONTH_PREFIX.values())[:n]:
        part = sinks.with_source_names(d.where(F.col("month") == prefix).drop("month"))
        sinks.export_csv(part, f"{root}/{prefix}_chart_data.csv")


@query("src_null_words")
def q_src_null_words(spark, sf):
    """S-1: cells that say "missing" in one of the known words are null, in text and number columns."""
    root, n = scratch_path(spark, "words"), F.col("dialog_id").cast("bigint")
    word = F.element_at(F.array(*map(F.lit, tables.NULL_WORDS)), (n % len(tables.NULL_WORDS) + 1).cast("int"))
    _month_files(spark, sf, root, lambda d: d.withColumns({
        "product_slug": F.when(n % 3 == 0, word).otherwise(F.col("product_slug")),
        "dialog_grade": F.when(n % 5 == 0, word).otherwise(F.col("dialog_grade").cast("string")),
        "session_seconds": F.when(n % 7 == 0, word).otherwise(F.col("session_seconds").cast("string"))}))
    return _kept(_dialog_rows(tables.canonical_dialogs(tables.read_table(spark, root, "chart_data"))), root)


@query("src_multiline")
def q_src_multiline(spark, sf):
    """S-1: quoted cells with line breaks and quotes stay one cell."""
    root, n = scratch_path(spark, "lines"), F.col("dialog_id").cast("bigint")
    _month_files(spark, sf, root, lambda d: d.withColumn("dialog_role", F.when(
        n % 4 == 0, F.concat(F.lit("a \"quoted\"\nsecond line,"), F.col("dialog_role"))).otherwise(F.col("dialog_role"))))
    return _kept(_dialog_rows(tables.canonical_dialogs(tables.read_table(spark, root, "chart_data"))), root)


@query("src_missing_month")
def q_src_missing_month(spark, sf):
    """S-2: all months are asked for, the last has no file: it is empty, the others are read; no months asked for, no rows."""
    root = scratch_path(spark, "missing")
    _month_files(spark, sf, root, lambda d: d, len(K.MONTH_PREFIX) - 1)
    back = tables.read_table(spark, root, "chart_data", list(K.MONTH_PREFIX))
    none = tables.read_table(spark, root, "chart_data", [])
    return _kept(_dialog_rows(tables.canonical_dialogs(back.unionByName(none, allowMissingColumns=True))), root)


@query("class_read")
def q_class_read(spark, sf):
    """S-6: the class/subject table written per month with its source column
    names and read back with the explicit schema."""
    o = B.table(spark, sf, "orders")
    monthly = (o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias(K.SRC_MONTH),
                         (F.lit(5) + F.col("o_orderkey") % 7).alias(K.SRC_GRADE),
                         F.col("o_orderstatus").alias(K.SRC_SUBJECT))
               .agg(F.count(F.lit(1)).alias(K.SRC_PUPILS)))
    root = scratch_path(spark, "classes")
    sinks.write_monthly(monthly, root, "class_stats", month_col=K.SRC_MONTH)
    back = tables.read_table(spark, root, "class_stats", None, partitioned=True, month_dir=K.SRC_MONTH)
    return _kept(tables.canonical_classes(back).select("month", "grade", "subject", "pupils"), root)


@query("norm_alias")
def q_norm_alias(spark, sf):
    """S-4: two sources keep the skeleton under different names; after alias
    repair both parse the same way."""
    sk = SK.text_skeletons(spark, sf)
    even = sk.where(F.substring("dialog_id", 1, 6).cast("bigint") % 2 == 0).select(
        "dialog_id", F.col("skeleton").alias(K.SRC_SKELETON))
    odd = sk.where(F.substring("dialog_id", 1, 6).cast("bigint") % 2 == 1).select(
        "dialog_id", F.col("skeleton").alias("status_only"), F.lit("plan").alias(K.SRC_SKELETON_LOWER))
    fixed = tables.normalise(even).unionByName(tables.normalise(odd))
    return fixed.select("dialog_id", F.size(skeleton.tokens(F.col("skeleton"))).cast("bigint")
                        .alias("n_blocks"))


@query("cmp_union")
def q_cmp_union(spark, sf):
    """U-1/P-12: two differently shaped sources unioned by name, each tagged
    with its label; the second one lacks product and grade columns."""
    orders = _dialogs(spark, sf, "dialog_id", "activity_dt", "dialog_grade", "product_slug", "status")
    ev = B.table(spark, sf, "events")
    events = ev.select(F.format_string("E%08d", F.col("event_id")).alias("dialog_id"),
                       F.col("ts").alias("activity_dt"),
                       F.when(F.col("event_type") == "purchase", F.lit(K.TAG_SUCCESS))
                       .otherwise(F.lit(K.TAG_MATCH_FAILED)).alias("status"))
    both = compare.union_months({"orders": orders, "events": events})
    return (both.groupBy("month")
            .agg(F.count(F.lit(1)).alias("n_dialogs"),
                 F.count_if(F.col("status") == K.TAG_SUCCESS).alias("n_success"),
                 F.count_if(F.col("product_slug").isNull()).alias("n_no_product"),
                 F.count_if(F.col("dialog_grade").isNull()).alias("n_no_grade")))


@query("report_tidy")
def q_report_tidy(spark, sf):
    """S-5: the monthly sectioned report files written from the dialogs and
    parsed back into tidy rows (equals ``conv_overall``)."""
    root = scratch_path(spark, "reports")
    full = report.full_report(_dialogs(spark, sf, "month", "status", "status_post"), by="month")
    path = sinks.write_report_files(full, root, by="month")
    return _kept(report_file.parse_report(spark, path).select(*(["month"] + report.REPORT_COLUMNS)), root)


@query("stream_tag_counts")
def q_stream_tag_counts(spark, sf):
    """Streaming refresh: monthly dialog files processed by a file-stream
    query into per-month tag counts."""
    root = scratch_path(spark, "stream")
    d = _dialogs(spark, sf, "month", "status")
    d.write.partitionBy("month").parquet(f"{root}/source")
    schema = T.StructType([T.StructField("status", T.StringType()), T.StructField("month", T.StringType())])
    return _kept(refresh.run_available(spark, f"{root}/source", schema, names=TAG_COUNT_NAMES, folder=root), root)
