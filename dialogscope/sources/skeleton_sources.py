"""Skeleton tables bound to the driver's test tables.

Two shapes, matching the two ways skeletons arrive:

``text_skeletons`` — one row per dialog with a multi-line skeleton cell and a
multi-line dialog cell (the monthly skeleton table's shape).  Bound to
``conversations``: each conversation turn is a dialog; its ``text`` is the
dialog text, and the skeleton cell is derived line by line from that text by a
narrow per-row rule (``_rule_for``): every non-empty line of every text gives one
block and nothing is grouped.  Edge rows (null, empty or whitespace-only
skeleton, null dialog text) are added as rows of their own ids.

``event_blocks`` — one row per block, ordered by (ts, event_id) within a
user: blocks that arrive as an event stream rather than as a cell.  Bound to
``events`` (one dialog per ``user_id``).  No per-user list is ever collected;
positions are computed by ``skeleton.parse_block_stream`` with range chunks, so a user
owning a third of all events is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import table


def text_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dialog_id, skeleton, dialog_text, tag, dialog_grade, dialog_role."""
    conv = table(spark, sf_dir, "conversations")
    conv_id, turn = F.col("conv_id"), F.col("turn")
    lines = F.split(F.col("text"), "\n", -1)
    derived = F.array_join(F.transform(lines, _rule_for), "\n")
    # Which turns get an extra row, by its suffix; only the mark is exploded, so unused columns are pruned below it.
    edges = {"n": (conv_id % 7 == 0) & (turn == 0), "e": (conv_id % 11 == 0) & (turn == 1), "b": (conv_id % 11 == 0) & (turn == 2),
             "t": (conv_id % 13 == 0) & (turn == 2)}
    marks = F.filter(F.array(F.lit(""), *[F.when(cond, F.lit(mark)) for mark, cond in edges.items()]), lambda m: m.isNotNull())
    rows = conv.select("conv_id", "turn", "text", "role", F.explode(marks).alias("mark"))
    mark, ident, none = F.col("mark"), F.format_string("%06d-%03d", conv_id, turn), F.lit(None).cast("string")
    return rows.select(
        F.when(mark == "", ident).otherwise(F.concat(ident, F.lit("-"), mark)).alias("dialog_id"),
        F.when(mark == "n", none).when(mark == "e", F.lit("")).when(mark == "b", F.lit(" \n\t\n ")).otherwise(derived).alias("skeleton"),
        F.when(mark != "t", F.col("text")).alias("dialog_text"), F.col("role").alias("tag"),
        F.when(turn % 4 == 3, F.lit(None).cast("bigint")).otherwise(F.lit(5) + conv_id % 7).alias("dialog_grade"),
        F.when(turn % 3 == 0, F.lit("pupil")).when(turn % 3 == 1, F.lit("teacher")).otherwise(none).alias("dialog_role"))


def repeated_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text skeleton twice under the same id; the id is null where the skeleton's length is a multiple of 5."""
    sk = text_skeletons(spark, sf_dir).select(
        F.when(F.length("skeleton") % 5 != 0, F.col("dialog_id")).alias("dialog_id"), "skeleton")
    return sk.select("dialog_id", "skeleton", F.explode(F.array(F.lit(1), F.lit(2)))).select("dialog_id", "skeleton")


def long_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text skeleton with its lines 25 times in a row."""
    return text_skeletons(spark, sf_dir).select(
        "dialog_id", F.array_join(F.array_repeat("skeleton", 25), "\n").alias("skeleton"))


def _rule_for(line: Column) -> Column:
    """Binding rule (not a reference value): a text line of length n > 0
    becomes the block below for n % 12; empty lines stay empty."""
    n = F.length(line)
    cases = {
        0: F.lit("plan"),
        1: F.concat(F.lit("info "), (n % 9).cast("string")),
        2: F.lit("action"),
        3: F.lit("  action "),
        4: F.lit("bossaction"),
        5: F.lit("problem"),
        6: F.lit("summary"),
        7: F.lit("info"),
        8: F.concat(F.lit("\t"), F.lit("action"), F.lit("\t")),
        9: F.concat(F.lit("note "), (n % 4).cast("string")),  # an "other" block
        10: F.concat(F.lit("action "), (n % 5).cast("string")),
        11: F.concat(F.lit("> "), line),  # the whole line: an "other" block
    }
    expr = F.when(n == 0, F.lit(""))
    for r, value in cases.items():
        expr = expr.when(n % 12 == r, value)
    return expr


def event_block_expr() -> Column:
    """Block text of one event (binding rule, not a reference value):
    ``k % 10 = 0`` → the event type itself (an ``other`` block); signup →
    plan; view → ``info {k}``; click → action; error → bossaction; purchase →
    problem (even k) / summary (odd k)."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    et = F.col("event_type")
    return (F.when(k % 10 == 0, et)
            .when(et == "signup", F.lit("plan"))
            .when(et == "view", F.concat(F.lit("info "), k.cast("string")))
            .when(et == "click", F.lit("action"))
            .when(et == "error", F.lit("bossaction"))
            .when((et == "purchase") & (k % 2 == 0), F.lit("problem"))
            .when(et == "purchase", F.lit("summary"))
            .otherwise(et))


def event_blocks(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """dialog_id, ts, event_id, block — one row per event.

    ``hot=True`` is the skew case: every event of a user with
    ``user_id % 3 = 0`` is attributed to the single dialog ``00000000``, so one
    dialog holds about a third of all blocks (no row is dropped).
    """
    ev = table(spark, sf_dir, "events")
    ident = F.format_string("%08d", F.col("user_id"))
    if hot:
        ident = F.when(F.col("user_id") % 3 == 0, F.lit("00000000")).otherwise(ident)
    return ev.select(ident.alias("dialog_id"), "ts", "event_id", event_block_expr().alias("block"))
