"""DuckDB oracle SQL for the named queries.

Each string runs on DuckDB against the driver's tables registered as views.
The dialog binding is written once as a CTE generated from the same constants
as the Spark binding.  Conventions for a value-exact comparison: counts as
BIGINT (``count(*) FILTER`` rather than ``count_if``, which yields NULL on
all-null groups), ratios rounded half-even with ``round_even``, dates as DATE.
"""

from __future__ import annotations

from .. import constants as K
from ..sources import bindings as B
from . import catalog as C


def lit(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def _case(key: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {r} THEN {lit(v)}" for r, v in mapping.items())
    return f"CASE {key} {whens} ELSE {lit(default)} END"


def pct(num: str, den: str) -> str:
    return f"round_even(CAST({num} AS DOUBLE) * 100.0 / NULLIF(CAST({den} AS DOUBLE), 0), 1)"


def minutes(x: str) -> str:
    return f"round_even(({x}) / 60.0, 1)"


STATUS_SQL = _case(f"o.o_orderkey % {B.STATUS_MODULUS}", B.STATUS_BY_RESIDUE, K.TAG_SUCCESS)
POST_SQL = (f"CASE WHEN ({STATUS_SQL}) = {lit(K.TAG_SUCCESS)} THEN "
            f"{_case(f'(o.o_orderkey // {B.STATUS_MODULUS}) % {B.POST_MODULUS}', B.POST_BY_RESIDUE, None)} END")

DIALOGS_CTE = f"""
li_counts AS (
  SELECT l_orderkey,
         count(*) FILTER (WHERE l_linestatus = 'O') AS pupil_msgs,
         count(*) FILTER (WHERE l_linestatus = 'F') AS tutor_msgs
  FROM lineitem GROUP BY l_orderkey),
dialogs AS (
  SELECT printf('%08d', o.o_orderkey) AS dialog_id,
         o.o_orderdate AS activity_dt,
         strftime(o.o_orderdate, '%Y-%m') AS month,
         CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE 5 + o.o_orderkey % 7 END AS dialog_grade,
         c.c_mktsegment AS dialog_role,
         CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE o.o_orderpriority END AS product_slug,
         {STATUS_SQL} AS status,
         {POST_SQL} AS status_post,
         o.o_totalprice AS session_seconds,
         li.pupil_msgs, li.tutor_msgs
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li_counts li ON o.o_orderkey = li.l_orderkey)"""

CLASS_CTE = """
class_stats AS (
  SELECT 5 + o_orderkey % 7 AS grade, o_orderstatus AS subject, count(*) AS pupils
  FROM orders GROUP BY 1, 2)"""


def with_dialogs(body: str, *extra: str) -> str:
    ctes = ",".join([DIALOGS_CTE, *extra])
    return f"WITH {ctes}\n{body}"


def funnel_sql(source: str, col: str, steps, success, total_stage: str, where: str = "TRUE") -> str:
    tags = [t for _, t in steps] + [success[1]]
    counts = ", ".join(f"count(*) FILTER (WHERE ({where}) AND {col} = {lit(t)}) AS c{i}"
                       for i, t in enumerate(tags))
    rows = [f"SELECT 0 AS stage_no, {lit(total_stage)} AS stage, CAST(total AS BIGINT) AS n_dialogs, "
            f"CAST(0 AS BIGINT) AS n_drop FROM fc"]
    surv = "total"
    for i, (stage, _) in enumerate(steps, start=1):
        surv = f"({surv} - c{i - 1})"
        rows.append(f"SELECT {i}, {lit(stage)}, CAST({surv} AS BIGINT), CAST(-c{i - 1} AS BIGINT) FROM fc")
    last = len(steps)
    resid = f"({surv} - c{last})"
    rows.append(f"SELECT {last + 1}, {lit(success[0])}, CAST(c{last} AS BIGINT), "
                f"CAST(CASE WHEN {resid} > 0 THEN -{resid} ELSE 0 END AS BIGINT) FROM fc")
    union = "\nUNION ALL ".join(rows)
    return (f"fc AS (SELECT count(*) FILTER (WHERE {where}) AS total, {counts} FROM {source})\n"
            f"{union}")


def matching_funnel_sql(source: str = "dialogs") -> str:
    return funnel_sql(source, "status", K.MATCHING_STEPS, K.MATCHING_SUCCESS, K.MATCHING_TOTAL_STAGE)


def funnel_query(funnel_body: str, outer: str = "SELECT * FROM ({union})") -> str:
    head, union = funnel_body.split("\n", 1)
    return with_dialogs(outer.format(union=union), head)


def report_counts_cte(by: str | None = None) -> str:
    s1 = ", ".join(f"count(*) FILTER (WHERE status = {lit(t)}) AS s1_{i}"
                   for i, t in enumerate(K.STAGE1_REPORT_TAGS))
    succ = f"status = {lit(K.TAG_SUCCESS)}"
    s2 = ", ".join(f"count(*) FILTER (WHERE {succ} AND status_post = {lit(t)}) AS s2_{i}"
                   for i, t in enumerate(K.STAGE2_REPORT_TAGS))
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"rc AS (SELECT {keys}count(*) AS total, count(*) FILTER (WHERE {succ}) AS success, "
            f"count(*) - count(*) FILTER (WHERE status = {lit(K.TAG_EMPTY)}) AS uninterrupted, "
            f"{s1}, {s2} FROM dialogs{group})")


def _report_row(keys: str, section: str, line_no: int, tag: str, n: str, p1: str = "NULL",
                p2: str = "NULL") -> str:
    return (f"SELECT {keys}{lit(section)} AS section, {line_no} AS line_no, {lit(tag)} AS tag, "
            f"CAST({n} AS BIGINT) AS n_dialogs, CAST({p1} AS DOUBLE) AS pct_1, "
            f"CAST({p2} AS DOUBLE) AS pct_2 FROM rc")


def report_rows(section: str, keys: str = "") -> list[str]:
    rows = []
    if section == "stage1":
        for i, t in enumerate(K.STAGE1_REPORT_TAGS):
            rows.append(_report_row(keys, "stage1", i + 1, t, f"s1_{i}", pct(f"s1_{i}", "uninterrupted")))
        rows.append(_report_row(keys, "stage1", len(rows) + 1, K.REPORT_RULE, "uninterrupted", "100.0"))
    elif section == "stage2":
        for i, t in enumerate(K.STAGE2_REPORT_TAGS):
            rows.append(_report_row(keys, "stage2", i + 1, t, f"s2_{i}", pct(f"s2_{i}", "success"),
                                    pct(f"s2_{i}", "total")))
        rows.append(_report_row(keys, "stage2", len(rows) + 1, K.REPORT_STAGE2_TOTAL, "success"))
    else:
        solved = f"s2_{K.STAGE2_REPORT_TAGS.index(K.POST_SOLVED)}"
        vals = [("total", "100.0"), ("uninterrupted", pct("uninterrupted", "total")),
                ("success", pct("success", "uninterrupted")), (solved, pct(solved, "uninterrupted"))]
        for i, (name, (n, p)) in enumerate(zip(K.CONVERSION_STAGES, vals)):
            rows.append(_report_row(keys, "conversion", i + 1, name, n, p))
    return rows


def report_sql(sections, by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    rows = [r for s in sections for r in report_rows(s, keys)]
    return with_dialogs("\nUNION ALL ".join(rows), report_counts_cte(by))


FILTER_ROWS = ("SELECT dialog_id, CAST(activity_dt AS DATE) AS date, dialog_grade, dialog_role, "
               "product_slug, status FROM dialogs")
DIM_PRED = (f"CAST(dialog_grade AS DOUBLE) = {float(C.GRADE)} AND dialog_role = {lit(C.ROLE)} "
            f"AND product_slug = {lit(C.PRODUCT)}")
PERIOD_PRED = (f"activity_dt >= DATE '{C.PERIOD[0]}' AND "
               f"activity_dt < DATE '{C.PERIOD[1]}' + INTERVAL 1 DAY")


def _filter_effect_sql() -> str:
    pred = f"{DIM_PRED} AND {PERIOD_PRED}"
    applied = (f"grade={C.GRADE}, role={C.ROLE}, product={C.PRODUCT}, "
               f"period={C.PERIOD[0]}..{C.PERIOD[1]}")
    return with_dialogs(
        f"SELECT kept, total, {pct('kept', 'total')} AS kept_pct, "
        f"{lit(applied)} AS filters FROM (SELECT count(*) FILTER (WHERE {pred}) AS kept, "
        f"count(*) AS total FROM dialogs)")


def _tag_counts_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE status = {lit(t)}) AS {n}"
                     for t, n in zip(K.STAGE1_REPORT_TAGS, C.TAG_COUNT_NAMES))
    return with_dialogs(f"SELECT count(*) AS total, {cols} FROM dialogs")


def _post_funnel_sql() -> str:
    body = funnel_sql("dialogs", "status_post", K.POST_STEPS, K.POST_SUCCESS, K.POST_TOTAL_STAGE,
                      where=f"status = {lit(K.TAG_SUCCESS)}")
    return funnel_query(body)


def _funnel_text_sql() -> str:
    text = ("CASE WHEN n_drop <> 0 THEN printf('%,d', n_dialogs) || ' ' || printf('%+,d', n_drop) "
            "ELSE printf('%,d', n_dialogs) END")
    return funnel_query(matching_funnel_sql(), "SELECT *, " + text + " AS text FROM ({union})")


def _filter_all_sql() -> str:
    source = (f"(SELECT * FROM dialogs WHERE CAST(dialog_grade AS DOUBLE) = {float(C.GRADE)} "
              f"AND dialog_role = {lit(C.ROLE)} AND {PERIOD_PRED})")
    return funnel_query(matching_funnel_sql(source))


def _proj_parse_dt_sql() -> str:
    raw = ("CASE WHEN event_id % 10 = 0 THEN 'not a date' "
           "WHEN event_id % 10 = 1 THEN strftime(ts, '%Y-%m-%d') "
           "WHEN event_id % 10 = 2 THEN '' "
           "ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END")
    return (f"SELECT event_id, CAST(TRY_CAST(raw AS TIMESTAMP) AS DATE) AS activity_date, "
            f"TRY_CAST(raw AS TIMESTAMP) IS NOT NULL AS is_valid FROM (SELECT event_id, {raw} AS raw FROM events)")


ORACLE: dict[str, str] = {
    "tag_counts": _tag_counts_sql(),
    "funnel_matching": funnel_query(matching_funnel_sql()),
    "funnel_post": _post_funnel_sql(),
    "funnel_post_rate": with_dialogs(
        f"SELECT total_success, solved, {pct('solved', 'total_success')} AS solved_pct FROM ("
        f"SELECT count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS total_success, "
        f"count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)} AND status_post = {lit(K.POST_SOLVED)}) "
        f"AS solved FROM dialogs)"),
    "funnel_text": _funnel_text_sql(),
    "dyn_daily": with_dialogs(
        f"SELECT CAST(activity_dt AS DATE) AS date, count(*) AS total, "
        f"count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success "
        f"FROM dialogs WHERE activity_dt IS NOT NULL GROUP BY 1"),
    "kpi_headline": with_dialogs(
        f"SELECT total, success, {pct('success', 'total')} AS success_pct, "
        f"{minutes('mean_s')} AS mean_minutes FROM (SELECT count(*) AS total, "
        f"count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success, "
        f"avg(session_seconds) AS mean_s FROM dialogs)"),
    "time_summary": with_dialogs(
        f"SELECT {minutes('avg(session_seconds)')} AS mean_minutes, "
        f"{minutes('median(session_seconds)')} AS median_minutes, "
        f"round_even(avg(pupil_msgs), 1) AS mean_pupil_msgs, "
        f"round_even(avg(tutor_msgs), 1) AS mean_tutor_msgs FROM dialogs"),
    "top_sessions": with_dialogs(
        f"SELECT dialog_id, session_seconds, {minutes('session_seconds')} AS minutes, dialog_grade, "
        f"substring(dialog_role, 1, 10) AS role_10, substring(product_slug, 1, 10) AS product_10 "
        f"FROM dialogs ORDER BY session_seconds DESC NULLS LAST, dialog_id LIMIT {C.TOP_K}"),
    "period_bounds": with_dialogs(
        "SELECT min(CAST(activity_dt AS DATE)) AS min_date, max(CAST(activity_dt AS DATE)) AS max_date "
        "FROM dialogs"),
    "proj_parse_dt": _proj_parse_dt_sql(),
    "filter_dims": with_dialogs(f"{FILTER_ROWS} WHERE {DIM_PRED}"),
    "filter_period": with_dialogs(f"{FILTER_ROWS} WHERE {PERIOD_PRED}"),
    "filter_all": _filter_all_sql(),
    "filter_effect": _filter_effect_sql(),
    "facet_values": with_dialogs(
        "SELECT facet, value, count(*) AS n_dialogs FROM ("
        "SELECT 'dialog_grade' AS facet, CAST(dialog_grade AS VARCHAR) AS value FROM dialogs "
        "UNION ALL SELECT 'dialog_role', dialog_role FROM dialogs "
        "UNION ALL SELECT 'product_slug', product_slug FROM dialogs) WHERE value IS NOT NULL GROUP BY 1, 2"),
    "dialog_search": with_dialogs(
        f"SELECT dialog_id, status FROM dialogs WHERE dialog_id IS NOT NULL AND "
        f"contains(lower(dialog_id), lower({lit(C.SEARCH)}))"),
    "dialog_search_first": with_dialogs(
        f"SELECT dialog_id, status FROM dialogs WHERE dialog_id IS NOT NULL AND "
        f"contains(lower(dialog_id), lower({lit(C.SEARCH)})) ORDER BY dialog_id LIMIT 1"),
    "cmp_conversion": with_dialogs(
        f"SELECT month, total, success, {pct('success', 'total')} AS conversion_pct FROM ("
        f"SELECT month, count(*) AS total, count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success "
        f"FROM dialogs WHERE month IS NOT NULL GROUP BY month)"),
    "cmp_conversion_filtered": with_dialogs(
        f"SELECT month, total, success, {pct('success', 'total')} AS conversion_pct FROM ("
        f"SELECT month, count(*) AS total, count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success "
        f"FROM dialogs WHERE month IS NOT NULL AND CAST(dialog_grade AS DOUBLE) = {float(C.GRADE)} "
        f"AND dialog_role = {lit(C.ROLE)} GROUP BY month)"),
    "cmp_daily": with_dialogs(
        "SELECT month, CAST(activity_dt AS DATE) AS date, count(*) AS n_dialogs FROM dialogs "
        "WHERE month IS NOT NULL AND activity_dt IS NOT NULL GROUP BY 1, 2"),
    "subject_sum": f"WITH {CLASS_CTE} SELECT subject, CAST(sum(pupils) AS BIGINT) AS pupils "
                   f"FROM class_stats WHERE subject IS NOT NULL GROUP BY subject",
    "subject_share": f"WITH {CLASS_CTE}, s AS (SELECT subject, CAST(sum(pupils) AS BIGINT) AS pupils "
                     f"FROM class_stats WHERE subject IS NOT NULL GROUP BY subject) "
                     f"SELECT subject, pupils, {pct('pupils', 'sum(pupils) OVER ()')} AS share_pct "
                     f"FROM s",
    "class_bars": f"WITH {CLASS_CTE} SELECT grade, CAST(sum(pupils) AS BIGINT) AS pupils, "
                  f"count(*) AS n_subject_rows FROM class_stats WHERE grade IS NOT NULL "
                  f"GROUP BY grade ORDER BY grade",
    "report_stage1": report_sql(["stage1"]),
    "report_stage2": report_sql(["stage2"]),
    "report_conversion": report_sql(["conversion"]),
    "conv_overall": report_sql(["stage1", "stage2", "conversion"], by="month"),
}


def _merge_skeleton() -> None:
    from . import oracle_skeleton as S
    ORACLE.update(S.ORACLE_SKELETON)
    ORACLE.update({
        "skeleton_semi": S.SEMI_SQL.format(grade=float(C.GRADE), role=lit(C.ROLE)),
        "top_sessions_skeleton": S.TOP_SKELETON_SQL.replace("{k}", str(C.TOP_K)),
        "dialog_options": S.OPTIONS_SQL,
        "skeleton_browse": S.BROWSE_SQL,
        "norm_alias": S.NORM_ALIAS_SQL,
    })


ROW_SELECT = ("dialog_id, CAST(activity_dt AS DATE) AS day, dialog_grade, dialog_role, product_slug, status, status_post, "
              "CAST(session_seconds AS DOUBLE) AS session_seconds")


def prefix_case(names, n: int = len(K.MONTH_PREFIX)) -> str:
    """The calendar months take the first n names in turn."""
    return f"CASE (month(activity_dt) - 1) % {n} " + " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(list(names)[:n])) + " END"


PREFIX = prefix_case(K.MONTH_PREFIX.values())


def _month_tag_counts_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE status = {lit(t)}) AS {n}"
                     for t, n in zip(K.STAGE1_REPORT_TAGS, C.TAG_COUNT_NAMES))
    return with_dialogs(f"SELECT month, count(*) AS total, {cols} FROM dialogs GROUP BY month")


ORACLE.update({
    "src_monthly_read": with_dialogs(f"SELECT month, {ROW_SELECT} FROM dialogs"),
    "export_csv": with_dialogs(f"SELECT 'jan' AS month, {ROW_SELECT} FROM dialogs WHERE dialog_role = {lit(C.ROLE)}"),
    "src_null_words": with_dialogs(
        f"SELECT {PREFIX} AS month, {ROW_SELECT} FROM (SELECT * REPLACE ("
        "CASE WHEN CAST(dialog_id AS BIGINT) % 3 <> 0 THEN product_slug END AS product_slug, "
        "CASE WHEN CAST(dialog_id AS BIGINT) % 5 <> 0 THEN dialog_grade END AS dialog_grade, "
        "CASE WHEN CAST(dialog_id AS BIGINT) % 7 <> 0 THEN session_seconds END AS session_seconds) FROM dialogs)"),
    "src_multiline": with_dialogs(
        f"SELECT {PREFIX} AS month, {ROW_SELECT} FROM (SELECT * REPLACE (CASE WHEN CAST(dialog_id AS BIGINT) % 4 = 0 "
        "THEN 'a \"quoted\"' || chr(10) || 'second line,' || dialog_role ELSE dialog_role END AS dialog_role) FROM dialogs)"),
    "src_missing_month": with_dialogs(f"SELECT {prefix_case(K.MONTH_PREFIX.values(), len(K.MONTH_PREFIX) - 1)} AS month, {ROW_SELECT} FROM dialogs"),
    "cmp_months_named": with_dialogs(
        f"SELECT {PREFIX} AS month, count(*) AS total, count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success, "
        f"{pct(f'count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)})', 'count(*)')} AS conversion_pct "
        "FROM dialogs WHERE (month(activity_dt) - 1) % 4 IN (1, 2) GROUP BY 1"),
    "month_routing": with_dialogs(
        f"SELECT {prefix_case(K.MONTH_PREFIX)} AS month_name, {PREFIX} AS prefix, count(*) AS n_dialogs FROM dialogs GROUP BY 1, 2"),
    "time_summary_approx": "SELECT count(*) AS n, true AS within_bound FROM orders",
    "kpi_nan_default_period": with_dialogs(
        f"SELECT total, success, {pct('success', 'total')} AS success_pct, {minutes('mean_s')} AS mean_minutes FROM (SELECT count(*) AS total, "
        f"count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS success, "
        "avg(session_seconds) FILTER (WHERE CAST(dialog_id AS BIGINT) % 37 <> 0) AS mean_s FROM dialogs "
        "WHERE activity_dt IS NOT NULL AND CAST(dialog_id AS BIGINT) % 41 <> 0)"),
    "metric_cards": with_dialogs(" UNION ALL ".join(
        f"SELECT {lit(src)} AS metric, round_even(avg({col}), 1) AS mean FROM dialogs"
        for src, col in ((K.SRC_SESSION_SECONDS, "session_seconds"), (K.SRC_PUPIL_MSGS, "pupil_msgs"), (K.SRC_TUTOR_MSGS, "tutor_msgs")))),
    "zero_filled": with_dialogs("SELECT product_slug, CAST(sum(coalesce(dialog_grade, 0)) AS BIGINT) AS grades FROM dialogs GROUP BY 1"),
    "required_columns": "SELECT wanted, present, (SELECT count(*) FROM orders) AS n_rows FROM "
                        "(VALUES ('status', true), ('dialog_id', true), ('no_such_column', false)) AS w(wanted, present)",
    "facet_grades": with_dialogs("SELECT DISTINCT dialog_grade AS value FROM dialogs WHERE dialog_grade IS NOT NULL"),
    "class_read": "SELECT strftime(o_orderdate, '%Y-%m') AS month, 5 + o_orderkey % 7 AS grade, "
                  "o_orderstatus AS subject, count(*) AS pupils FROM orders GROUP BY 1, 2, 3",
    "cmp_union": with_dialogs(
        f"SELECT 'orders' AS month, count(*) AS n_dialogs, "
        f"count(*) FILTER (WHERE status = {lit(K.TAG_SUCCESS)}) AS n_success, "
        f"count(*) FILTER (WHERE product_slug IS NULL) AS n_no_product, "
        f"count(*) FILTER (WHERE dialog_grade IS NULL) AS n_no_grade FROM dialogs "
        f"UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE event_type = 'purchase'), "
        f"count(*), count(*) FROM events"),
    "report_tidy": report_sql(["stage1", "stage2", "conversion"], by="month"),
    "stream_tag_counts": _month_tag_counts_sql(),
})


_merge_skeleton()
