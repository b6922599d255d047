"""DuckDB oracle SQL for the skeleton queries.

The oracle is the straightforward single-node formulation: positions with
``generate_subscripts`` / ``row_number``, running state with window functions
partitioned by dialog — exactly what the Spark side avoids for skew, which
makes it an independent check of the chunked scan.
"""

from __future__ import annotations

from .. import constants as K
from .oracle import lit

WS = K.PY_WHITESPACE_CLASS
NL = "chr(10)"


def _line_rule(line: str) -> str:
    n = f"length({line})"
    cases = {
        0: "'plan'",
        1: f"'info ' || CAST({n} % 9 AS VARCHAR)",
        2: "'action'",
        3: "'  action '",
        4: "'bossaction'",
        5: "'problem'",
        6: "'summary'",
        7: "'info'",
        8: "chr(9) || 'action' || chr(9)",
        9: f"'note ' || CAST({n} % 4 AS VARCHAR)",
        10: f"'action ' || CAST({n} % 5 AS VARCHAR)",
        11: f"'> ' || {line}",
    }
    whens = " ".join(f"WHEN {n} % 12 = {r} THEN {v}" for r, v in cases.items())
    return f"CASE WHEN {n} = 0 THEN '' {whens} END"


TEXT_SKEL_CTE = f"""
base AS (
  SELECT printf('%06d-%03d', conv_id, turn) AS dialog_id, conv_id, turn,
         array_to_string(list_transform(string_split(text, {NL}), lambda line: {_line_rule('line')}), {NL}) AS skeleton,
         text AS dialog_text, role AS tag,
         CASE WHEN turn % 4 = 3 THEN NULL ELSE 5 + conv_id % 7 END AS dialog_grade,
         CASE turn % 3 WHEN 0 THEN 'pupil' WHEN 1 THEN 'teacher' END AS dialog_role
  FROM conversations),
skel AS (
  SELECT dialog_id, skeleton, dialog_text, tag, dialog_grade, dialog_role FROM base
  UNION ALL SELECT dialog_id || '-n', NULL, dialog_text, tag, dialog_grade, dialog_role FROM base WHERE conv_id % 7 = 0 AND turn = 0
  UNION ALL SELECT dialog_id || '-e', '', dialog_text, tag, dialog_grade, dialog_role FROM base WHERE conv_id % 11 = 0 AND turn = 1
  UNION ALL SELECT dialog_id || '-b', ' ' || {NL} || chr(9) || {NL} || ' ', dialog_text, tag, dialog_grade, dialog_role
            FROM base WHERE conv_id % 11 = 0 AND turn = 2
  UNION ALL SELECT dialog_id || '-t', skeleton, NULL, tag, dialog_grade, dialog_role FROM base WHERE conv_id % 13 = 0 AND turn = 2),
tok AS (
  SELECT *, list_filter(list_transform(string_split(coalesce(skeleton, ''), {NL}),
                                       lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')),
                        lambda x: x <> '') AS blist
  FROM skel),
blocks AS (
  SELECT dialog_id, CAST(generate_subscripts(blist, 1) - 1 AS BIGINT) AS pos, unnest(blist) AS block
  FROM tok)"""

EVENT_BLOCK = """CASE WHEN k % 10 = 0 THEN event_type
     WHEN event_type = 'signup' THEN 'plan'
     WHEN event_type = 'view' THEN 'info ' || CAST(k AS VARCHAR)
     WHEN event_type = 'click' THEN 'action'
     WHEN event_type = 'error' THEN 'bossaction'
     WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'problem'
     WHEN event_type = 'purchase' THEN 'summary'
     ELSE event_type END"""

EVENT_SKEL_CTE = f"""
ev AS (
  SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
blocks AS (
  SELECT printf('%08d', user_id) AS dialog_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
         {EVENT_BLOCK} AS block
  FROM ev)"""


def _label() -> str:
    whens = " ".join(f"WHEN {lit(t)} THEN {lit(name)}" for t, name in K.BLOCK_LABELS.items())
    return f"CASE block_type {whens} ELSE block END"


STATE_CTES = f"""
typed AS (
  SELECT *, CASE WHEN block = 'plan' THEN 'plan' WHEN starts_with(block, 'info') THEN 'info'
                 WHEN starts_with(block, 'action') THEN 'action' WHEN block = 'problem' THEN 'problem'
                 WHEN starts_with(block, 'bossaction') THEN 'bossaction' WHEN block = 'summary' THEN 'summary'
                 ELSE 'other' END AS block_type
  FROM blocks),
flags AS (
  SELECT *, CASE WHEN block_type IN ('action', 'bossaction') THEN 1 ELSE 0 END AS deeper,
         block_type IN ('plan', 'info', 'problem', 'summary') AS is_reset,
         CASE WHEN block_type = 'info' THEN TRY_CAST(NULLIF(regexp_extract(block, '(\\d+)', 1), '') AS BIGINT)
         END AS info_num
  FROM typed),
run1 AS (
  SELECT *, CAST(sum(deeper) OVER w AS BIGINT) AS cum_depth,
         last_value(info_num IGNORE NULLS) OVER w AS l_info,
         lead(block_type) OVER (PARTITION BY dialog_id ORDER BY pos) AS next_type,
         count(*) OVER (PARTITION BY dialog_id) AS n_blocks
  FROM flags
  WINDOW w AS (PARTITION BY dialog_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
state AS (
  SELECT dialog_id, pos, n_blocks, block, block_type, {_label()} AS label,
         CAST(cum_depth - coalesce(max(CASE WHEN is_reset THEN cum_depth END) OVER
              (PARTITION BY dialog_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
              AS BIGINT) AS depth,
         cum_depth, CAST(coalesce(l_info, 0) AS BIGINT) AS step,
         block_type = 'action' AND next_type IS NOT NULL AND next_type <> 'action' AS is_jump
  FROM run1)"""

BLOCK_SELECT = ("SELECT dialog_id, pos, n_blocks, block, block_type, label, depth, cum_depth, step, "
                "pos AS x, -depth AS y FROM state")


def text_sql(body: str) -> str:
    return f"WITH {TEXT_SKEL_CTE},{STATE_CTES}\n{body}"


def event_sql(body: str) -> str:
    return f"WITH {EVENT_SKEL_CTE},{STATE_CTES}\n{body}"


EXCERPT_SQL = f"""WITH {TEXT_SKEL_CTE},
ex AS (
  SELECT dialog_id, blist, string_split(dialog_text, {NL}) AS lines,
         dialog_text IS NOT NULL AND dialog_text <> '' AS has_text
  FROM tok WHERE len(blist) > 0),
ex2 AS (
  SELECT *, greatest(1, len(lines) // len(blist)) AS k, unnest(range(0, len(blist))) AS i FROM ex)
SELECT dialog_id, CAST(i AS BIGINT) AS pos,
       CASE WHEN has_text THEN array_to_string(
            list_slice(lines, i * k + 1, least(i * k + k + {K.EXCERPT_CONTEXT_LINES}, len(lines))), {NL})
       END AS excerpt
FROM ex2"""

QUALITY_SQL = f"""WITH {TEXT_SKEL_CTE}
SELECT CASE WHEN skeleton IS NULL THEN 'null' WHEN skeleton = '' THEN 'empty'
            WHEN len(blist) = 0 THEN 'blank' ELSE 'ok' END AS reason,
       count(*) AS n_dialogs
FROM tok GROUP BY 1"""

LABELS_BODY = """SELECT dialog_id, pos,
       CAST(pos + 1 AS VARCHAR) || '. ' || label AS point_label,
       CAST(pos + 1 AS VARCHAR) || '. ' || block || ' (' || block_type || ')' AS menu_label,
       CAST(pos + 1 AS VARCHAR) || ' из ' || CAST(n_blocks AS VARCHAR) AS ordinal
FROM state"""

DROPOFF_BODY = f"""SELECT dialog_id, count(*) AS n_blocks,
       arg_max(block_type, pos) AS last_type,
       arg_max(block_type, pos) IN ({', '.join(lit(t) for t in K.DEEPER_TYPES)}) AS dropped
FROM typed GROUP BY dialog_id"""

ROLLUP_BODY = f"""SELECT last_type, n_dialogs, n_jumps, max_depth, n_blocks,
       round_even(CAST(n_dialogs AS DOUBLE) * 100.0 / sum(n_dialogs) OVER (), 1) AS share_pct,
       last_type IN ({', '.join(lit(t) for t in K.DEEPER_TYPES)}) AS dropped
FROM (SELECT last_type, count(*) AS n_dialogs, CAST(sum(n_jumps) AS BIGINT) AS n_jumps,
             max(max_depth) AS max_depth, CAST(sum(n_blocks) AS BIGINT) AS n_blocks
      FROM (SELECT dialog_id, count(*) AS n_blocks, count(*) FILTER (WHERE is_jump) AS n_jumps,
                   max(depth) AS max_depth, arg_max(block_type, pos) AS last_type
            FROM state GROUP BY dialog_id)
      GROUP BY last_type)"""

EVENT_HOT_CTE = EVENT_SKEL_CTE.replace(
    "SELECT printf('%08d', user_id) AS dialog_id,\n         CAST(row_number() OVER (PARTITION BY user_id ",
    "SELECT CASE WHEN user_id % 3 = 0 THEN '00000000' ELSE printf('%08d', user_id) END AS dialog_id,\n"
    "         CAST(row_number() OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END ")

# Every cell its own walk: the state runs over an id of the cell, and the shown id comes back at the end.
DUP_SQL = f"""WITH {TEXT_SKEL_CTE.replace('tok AS (', """cells AS (
  SELECT dialog_id || '/' || copy AS dialog_id, skeleton, dialog_text, tag, dialog_grade, dialog_role,
         CASE WHEN length(skeleton) % 5 <> 0 THEN dialog_id END AS shown FROM skel, (VALUES ('1'), ('2')) AS c(copy)),
tok AS (""").replace('FROM skel),\nblocks', 'FROM cells),\nblocks')},{STATE_CTES}
SELECT c.shown AS dialog_id, pos, n_blocks, block, block_type, label, depth, cum_depth, step, pos AS x, -depth AS y
FROM state JOIN cells c USING (dialog_id)"""

LONG_SQL = f"""WITH {TEXT_SKEL_CTE.replace('tok AS (', """cells AS (
  SELECT * REPLACE (array_to_string(list_transform(range(0, 25), lambda i: skeleton), chr(10)) AS skeleton) FROM skel),
tok AS (""").replace('FROM skel),\nblocks', 'FROM cells),\nblocks')},{STATE_CTES}
{BLOCK_SELECT}"""

ORACLE_SKELETON: dict[str, str] = {
    "skel_blocks_dup": DUP_SQL,
    "skel_blocks_long": LONG_SQL,
    "skel_blocks_hot": f"WITH {EVENT_HOT_CTE},{STATE_CTES}\n{BLOCK_SELECT}",
    "skel_blocks": text_sql(BLOCK_SELECT),
    "skel_blocks_events": event_sql(BLOCK_SELECT),
    "skel_labels": text_sql(LABELS_BODY),
    "skel_jumps": event_sql("SELECT dialog_id, pos, depth FROM state WHERE is_jump"),
    "skel_dropoff": event_sql(DROPOFF_BODY),
    "skel_excerpt": EXCERPT_SQL,
    "skel_rollup": event_sql(ROLLUP_BODY),
    "skeleton_quality": QUALITY_SQL,
}


def _with_dialogs_and_events(body: str) -> str:
    from .oracle import DIALOGS_CTE
    return f"WITH {DIALOGS_CTE},{EVENT_SKEL_CTE},{STATE_CTES}\n{body}"


SEMI_SQL = _with_dialogs_and_events(
    "SELECT dialog_id, count(*) AS n_blocks, arg_max(block_type, pos) AS last_type FROM typed "
    "WHERE dialog_id IN (SELECT dialog_id FROM dialogs WHERE CAST(dialog_grade AS DOUBLE) = {grade} "
    "AND dialog_role = {role}) GROUP BY dialog_id")

TOP_SKELETON_SQL = event_sql("""SELECT top.dialog_id, top.session_seconds, top.minutes, state.pos, state.block,
       state.block_type, state.depth
FROM (SELECT dialog_id, session_seconds, round_even(session_seconds / 60.0, 1) AS minutes
      FROM (SELECT printf('%08d', user_id) AS dialog_id,
                   CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS session_seconds
            FROM events GROUP BY 1)
      ORDER BY session_seconds DESC NULLS LAST, dialog_id LIMIT {k}) top
LEFT JOIN state ON top.dialog_id = state.dialog_id""")

OPTIONS_SQL = f"""WITH {TEXT_SKEL_CTE}
SELECT concat_ws(' | ', substring(dialog_id, 1, 36) || '...', tag,
                 CAST(dialog_grade AS VARCHAR) || ' кл.', dialog_role) AS label,
       max(dialog_id) AS dialog_id
FROM (SELECT * FROM skel ORDER BY dialog_id LIMIT 100) GROUP BY 1"""

BROWSE_SQL = f"""WITH {TEXT_SKEL_CTE}
SELECT dialog_id, skeleton, tag, dialog_grade, dialog_role FROM skel ORDER BY dialog_id LIMIT 50"""

NORM_ALIAS_SQL = f"""WITH {TEXT_SKEL_CTE}
SELECT dialog_id, CAST(len(blist) AS BIGINT) AS n_blocks FROM tok"""
