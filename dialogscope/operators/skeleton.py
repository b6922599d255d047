"""Dialog skeletons as a corpus job (B-1 … B-11, F-5).

The dashboard parses ONE dialog's skeleton (an ordered list of blocks) into a
staircase picture.  Here the same rules run over the whole skeleton table and
give one row per (dialog, block).

Rules, per block in order (first hit wins for the type):

* tokens: the skeleton text split on ``\\n``, each stripped of whitespace
  (Python ``str.strip`` semantics), empty tokens dropped;
* type: ``== plan`` → plan; starts ``info`` → info; starts ``action`` →
  action; ``== problem`` → problem; starts ``bossaction`` → bossaction;
  ``== summary`` → summary; anything else → other;
* depth: plan/info/problem/summary reset it to 0, action/bossaction add 1,
  other leaves it;
* cumulative depth: action/bossaction blocks so far (never resets);
* step: the first digit run of the latest info block that had one, else 0;
* jump: an action block whose next block exists and is not an action;
* drop-off: the dialog's last block is action or bossaction.

Running state without a hot task
--------------------------------
Depth, step and jumps are running values along a dialog.

*Text cells* hold a whole dialog in one row, so the state is a fold inside the
row: the block array is cut into pieces of about sqrt(n) blocks, each piece is
folded with ``aggregate`` and its end state carried into the next.  Narrow (no
shuffle), rows never meet - repeated or null ids are no special case - and a
cell of n blocks costs n * sqrt(n) array steps, not n squared.

*Event streams* spread a dialog over many rows.  A window partitioned by dialog
alone would put a dialog that holds a third of all blocks into ONE task, so
every stream takes a two-level prefix scan:

1. rows are range-partitioned by (dialog, order); a long dialog falls into
   several partitions.  The partition is the chunk; a reliable checkpoint pins it;
2. a window per (dialog, chunk) computes local running values;
3. the running values at a chunk's last row are scanned per dialog (at most one row
   per partition) and joined back for the dialogs found in several chunks.

One plan for all sizes; a null dialog id is a dialog like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..config import default_parallelism, scratch_dir
from ..functions.columns import strip_py


# --- B-1 / B-2 / B-3: tokens, types, step numbers ------------------------------

def tokens(skeleton: Column) -> Column:
    """B-1: stripped, non-empty lines of the skeleton text (empty array for
    null text)."""
    parts = F.transform(F.split(F.coalesce(skeleton, F.lit("")), "\n", -1), strip_py)
    return F.filter(parts, lambda x: x != F.lit(""))


def block_type(block: Column) -> Column:
    """B-2: the type of one (stripped) block, case-sensitive, first hit wins."""
    return (F.when(block == "plan", F.lit("plan"))
            .when(block.startswith("info"), F.lit("info"))
            .when(block.startswith("action"), F.lit("action"))
            .when(block == "problem", F.lit("problem"))
            .when(block.startswith("bossaction"), F.lit("bossaction"))
            .when(block == "summary", F.lit("summary"))
            .otherwise(F.lit("other")))


def info_number(block: Column, btype: Column) -> Column:
    """B-3: first digit run of an info block as a number; null when none (the
    step then carries over)."""
    digits = F.regexp_extract(block, r"(\d+)", 1)
    return F.when((btype == "info") & (digits != ""), digits.try_cast("bigint"))


def block_label(block: Column, btype: Column) -> Column:
    """Display name of a block: a fixed name per type, the raw text for other."""
    expr = F.when(btype == "other", block)
    for t, name in K.BLOCK_LABELS.items():
        expr = expr.when(btype == t, F.lit(name))
    return expr


def with_block_flags(blocks: DataFrame, block_col: str = "block") -> DataFrame:
    b = F.col(block_col)
    t = block_type(b)
    return (blocks.withColumn("block_type", t)
            .withColumn("info_num", info_number(b, F.col("block_type")))
            .withColumn("deeper", F.col("block_type").isin(K.DEEPER_TYPES).cast("int"))
            .withColumn("is_reset", F.col("block_type").isin(K.RESET_TYPES))
            .withColumn("is_action", F.col("block_type") == "action"))


# --- text cells: the fold inside the row (B-3, B-4, B-5, B-8) ------------------

_STATE = "struct<cum:bigint,base:bigint,step:bigint,out:array<struct<depth:bigint,cum_depth:bigint,step:bigint>>>"


def _next_state(state: Column, block: Column) -> Column:
    """The running state after one more block, with the block's values appended."""
    cum = state["cum"] + block["deeper"]
    base = F.when(block["is_reset"], cum).otherwise(state["base"])
    step = F.coalesce(block["info_num"], state["step"])
    row = F.struct((cum - base).alias("depth"), cum.alias("cum_depth"), step.alias("step"))
    return F.struct(cum.alias("cum"), base.alias("base"), step.alias("step"),
                    F.concat(state["out"], F.array(row)).alias("out")).cast(_STATE)


def _folded(flags: Column, piece_rows: int | None) -> Column:
    """array<struct<depth, cum_depth, step>> of an array of flagged blocks."""
    size = F.size(flags)
    piece = F.lit(piece_rows) if piece_rows else F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / piece).cast("int")),
                         lambda i: F.slice(flags, i * piece + 1, piece))
    nothing = F.array().cast("array<struct<depth:bigint,cum_depth:bigint,step:bigint>>")
    zero = F.lit(0).cast("bigint")

    def one_piece(state, blocks):
        start = F.struct(state["cum"].alias("cum"), state["base"].alias("base"), state["step"].alias("step"),
                         nothing.alias("out")).cast(_STATE)
        # transform over a one-element array names the piece's result, so it is folded once
        return F.transform(F.array(F.aggregate(blocks, start, _next_state)), lambda end: F.struct(
            end["cum"].alias("cum"), end["base"].alias("base"), end["step"].alias("step"),
            F.concat(state["parts"], F.array(end["out"])).alias("parts")))[0]

    begin = F.struct(zero.alias("cum"), zero.alias("base"), zero.alias("step"),
                     F.array().cast("array<array<struct<depth:bigint,cum_depth:bigint,step:bigint>>>").alias("parts"))
    return F.flatten(F.aggregate(pieces, begin, one_piece, lambda s: s["parts"]))


def parse_skeletons(skeletons: DataFrame, id_col: str = "dialog_id", skeleton_col: str = "skeleton",
                    piece_rows: int | None = None) -> DataFrame:
    """B-1 ... B-6 over a table of skeleton text cells: one row per block, each
    input row on its own.  ``piece_rows`` fixes the fold's piece size (default: sqrt(n))."""
    def flagged(block):
        t = block_type(block)
        return F.struct(block.alias("block"), t.alias("block_type"), info_number(block, t).alias("info_num"),
                        t.isin(*K.DEEPER_TYPES).cast("bigint").alias("deeper"), t.isin(*K.RESET_TYPES).alias("is_reset"))

    flags = skeletons.select(F.col(id_col).alias("_id"), F.transform(tokens(F.col(skeleton_col)), flagged).alias("_flags"))
    state = flags.where(F.size("_flags") > 0).select("_id", "_flags", _folded(F.col("_flags"), piece_rows).alias("_state"))
    is_action = lambda i: F.get("_flags", i)["block_type"] == "action"
    rows = F.transform("_flags", lambda b, i: F.struct(
        b["block"].alias("block"), b["block_type"].alias("block_type"), F.get("_state", i).alias("state"),
        (is_action(i) & F.coalesce(~is_action(i + 1), F.lit(False))).alias("is_jump")))
    out = state.select("_id", F.size("_flags").cast("bigint").alias("n_blocks"), F.posexplode(rows).alias("pos", "b"))
    pos = F.col("pos").cast("bigint")
    return out.select(F.col("_id").alias(id_col), pos.alias("pos"), "n_blocks", "b.block", "b.block_type",
                      block_label(F.col("b.block"), F.col("b.block_type")).alias("label"), "b.state.depth", "b.state.cum_depth",
                      "b.state.step", "b.is_jump", pos.alias("x"), (-F.col("b.state.depth")).alias("y"))


# --- event streams: two-level prefix scan ---------------------------------------

def parse_block_stream(blocks: DataFrame, order: Sequence[str], id_col: str = "dialog_id",
                       range_partitions: int | None = None) -> DataFrame:
    """B-2 ... B-6 over block rows (``id_col``, the ``order`` columns, ``block``) of dialogs of any length.

    Adds: pos, n_blocks, block_type, label, depth, cum_depth, step, is_jump, x, y.
    """
    spark = blocks.sparkSession
    scratch_dir(spark)
    chunked = (with_block_flags(blocks).repartitionByRange(range_partitions or default_parallelism(spark), id_col, *order)
               .withColumn("_chunk", F.spark_partition_id().cast("bigint")))
    local = _local_windows(chunked, [id_col, "_chunk"], list(order)).checkpoint(eager=True)

    # The running values at a chunk's LAST row, for dialogs found in several chunks.
    last = local.where(F.col("_lnext_action").isNull()).select(
        F.col(id_col).alias("_id"), F.col("_chunk").alias("_of"), F.col("_lrn").alias("c_n"), F.col("_lact").alias("c_act"),
        F.col("_lreset").alias("c_reset"), F.col("_linfo").alias("c_info"), F.col("_first_action").alias("c_first_action"))
    whole = Window.partitionBy("_id")
    ordered = whole.orderBy("_of")
    prev = ordered.rowsBetween(Window.unboundedPreceding, -1)
    summ = (last.withColumn("chunks", F.count(F.lit(1)).over(whole))
            .withColumn("total", F.sum("c_n").over(whole).cast("bigint"))
            .withColumn("off_n", F.coalesce(F.sum("c_n").over(prev), F.lit(0)).cast("bigint"))
            .withColumn("off_act", F.coalesce(F.sum("c_act").over(prev), F.lit(0)).cast("bigint"))
            .withColumn("next_first_action", F.lead("c_first_action").over(ordered)))
    summ = (summ.withColumn("g_reset", F.col("off_act") + F.col("c_reset"))
            .withColumn("in_reset", F.last("g_reset", ignorenulls=True).over(prev).cast("bigint"))
            .withColumn("in_info", F.last("c_info", ignorenulls=True).over(prev).cast("bigint"))
            .where("chunks > 1")
            .select("_id", "_of", "total", "off_n", "off_act", "next_first_action", "in_reset", "in_info"))
    met = local.join(summ, local[id_col].eqNullSafe(summ["_id"]) & (local["_chunk"] == summ["_of"]), "left")
    zero = F.lit(0).cast("bigint")
    cum = (F.coalesce("off_act", zero) + F.col("_lact")).cast("bigint")
    reset = F.coalesce(F.coalesce("off_act", zero) + F.col("_lreset"), F.col("in_reset"), zero)
    following = F.coalesce("_lnext_action", "next_first_action")
    pos = (F.coalesce("off_n", zero) + F.col("_lrn") - 1).cast("bigint")
    depth = (cum - reset).cast("bigint")
    return met.select(
        *[local[c] for c in blocks.columns if c != "pos"], pos.alias("pos"), F.coalesce("total", "_chunk_n").alias("n_blocks"),
        "block_type", block_label(F.col("block"), F.col("block_type")).alias("label"), depth.alias("depth"), cum.alias("cum_depth"),
        F.coalesce("_linfo", "in_info", zero).cast("bigint").alias("step"),
        (F.col("is_action") & F.coalesce(~following, F.lit(False))).alias("is_jump"), pos.alias("x"), (-depth).alias("y"))


def _local_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running values inside each window partition ``keys`` (one chunk)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (df.withColumn("_lrn", F.row_number().over(w))
             .withColumn("_lact", F.sum("deeper").over(run))
             .withColumn("_linfo", F.last("info_num", ignorenulls=True).over(run))
             .withColumn("_lnext_action", F.lead("is_action").over(w))
             .withColumn("_first_action", F.first("is_action").over(run))
             .withColumn("_chunk_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    # _lact never decreases, so its running max over reset rows is its value at
    # the latest reset.
    return local.withColumn("_lreset", F.max(F.when(F.col("is_reset"), F.col("_lact"))).over(run))


BLOCK_COLUMNS = ["dialog_id", "pos", "n_blocks", "block", "block_type", "label", "depth", "cum_depth",
                 "step", "x", "y"]


def label_columns() -> list[Column]:
    """B-7: ``"{i+1}. {label}"``, the menu label ``"{i+1}. {block} ({type})"``
    and the ordinal ``"{i+1} из {n}"`` shown in the block details."""
    i1 = (F.col("pos") + 1).cast("string")
    return [F.concat(i1, F.lit(". "), F.col("label")).alias("point_label"),
            F.concat(i1, F.lit(". "), F.col("block"), F.lit(" ("), F.col("block_type"), F.lit(")"))
            .alias("menu_label"),
            F.concat(i1, F.lit(" из "), F.col("n_blocks").cast("string")).alias("ordinal")]


def with_labels(state: DataFrame) -> DataFrame:
    """B-7 labels of every block: dialog_id, pos and the three label texts."""
    return state.select("dialog_id", "pos", *label_columns())


def jumps(state: DataFrame) -> DataFrame:
    """B-8: the jump points (dialog_id, pos, depth)."""
    return state.where("is_jump").select("dialog_id", "pos", "depth")


def _type_code(btype: Column) -> Column:
    """A block type as its place in ``K.BLOCK_TYPES`` (from 1): a fixed-width value, so that grouping stays a hash aggregate."""
    return F.array_position(F.array(*map(F.lit, K.BLOCK_TYPES)), btype).cast("int")


def _type_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, K.BLOCK_TYPES)), code)


def _order_key(blocks: DataFrame, order: Sequence[str]) -> Column:
    """One fixed-width value that sorts like the order columns where they are a number, or a timestamp and a number."""
    kinds = dict(blocks.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and kinds[order[0]].startswith("timestamp") and kinds[order[1]] in whole:
        at = F.col(order[0])
        if kinds[order[0]] == "timestamp":
            micros = F.unix_micros(at)
        else:  # without a time zone: from the fields, which no clock change reorders
            micros = (F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(at).cast("bigint") * 3_600_000_000
                      + F.minute(at).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint"))
        return micros.cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(order[1]).cast("decimal(19,0)")
    return F.struct(*order)


def dropoff(blocks: DataFrame, order: Sequence[str] = ("pos",), id_col: str = "dialog_id", with_block: bool = False) -> DataFrame:
    """B-9: per dialog the last block's type and whether it is a drop-off.

    A grouped ``max_by`` over the ordering key: partial aggregation keeps one
    row per dialog per task, so a hot dialog is no hot task.  All buffers are of fixed
    width, so it is a hash aggregate; ``with_block`` adds the last block's text, which costs a sort.
    """
    key = _order_key(blocks, order)
    typed = blocks.withColumn("_code", _type_code(block_type(F.col("block"))))
    text = [F.max_by("block", key).alias("last_block")] if with_block else []
    return (typed.groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("n_blocks"), *text, _type_name(F.max_by("_code", key)).alias("last_type"))
            .withColumn("dropped", F.col("last_type").isin(K.DEEPER_TYPES)))


# --- B-10: dialog excerpt per block -------------------------------------------

def block_excerpts(skeletons: DataFrame, id_col: str = "dialog_id", skeleton_col: str = "skeleton",
                   text_col: str = "dialog_text", context: int = K.EXCERPT_CONTEXT_LINES) -> DataFrame:
    """B-10: the share of the dialog text shown for each block.

    With n text lines and b blocks, k = max(1, n div b); block i shows lines
    [i*k, min(i*k + k + context, n)).  Null when the text is null or empty.
    Computed inside each row (``transform`` over block indexes) before the
    explode, so the text is never copied once per block.
    """
    toks = tokens(F.col(skeleton_col))
    lines = F.split(F.col(text_col), "\n", -1)
    has_text = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    return (skeletons.select(id_col, toks.alias("_b"), lines.alias("_l"), has_text.alias("_t"))
            .where(F.size("_b") > 0)
            .select(id_col, "_b", "_l", "_t",
                    F.greatest(F.lit(1), F.floor(F.size("_l") / F.size("_b"))).cast("int").alias("_k"))
            .select(id_col, F.posexplode(F.transform(
                F.sequence(F.lit(0), F.size("_b") - 1),
                lambda i: F.when(F.col("_t"), F.array_join(F.slice(
                    "_l", i * F.col("_k") + 1,
                    F.greatest(F.lit(0), F.least(i * F.col("_k") + F.col("_k") + context, F.size("_l"))
                               - i * F.col("_k"))), "\n")))).alias("pos", "excerpt"))
            .withColumn("pos", F.col("pos").cast("bigint")))


# --- F-5 / B-11: quality and roll-ups ------------------------------------------

def skeleton_quality(skeletons: DataFrame, skeleton_col: str = "skeleton") -> DataFrame:
    """F-5: dialogs per parse outcome — null, empty text, whitespace only, ok."""
    s = F.col(skeleton_col)
    reason = (F.when(s.isNull(), F.lit("null"))
              .when(s == "", F.lit("empty"))
              .when(F.size(tokens(s)) == 0, F.lit("blank"))
              .otherwise(F.lit("ok")))
    return skeletons.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_dialogs"))


def dialog_summary(state: DataFrame) -> DataFrame:
    """Per dialog: blocks, jumps, max depth, max cumulative depth, last type."""
    return (state.groupBy("dialog_id")
            .agg(F.count(F.lit(1)).alias("n_blocks"),
                 F.count_if("is_jump").alias("n_jumps"),
                 F.max("depth").alias("max_depth"),
                 F.max("cum_depth").alias("max_cum_depth"),
                 _type_name(F.max_by(_type_code(F.col("block_type")), F.col("pos"))).alias("last_type")))


def dropoff_rollup(state: DataFrame) -> DataFrame:
    """B-11: dialogs by last block type, with drop-off flag, share of all
    dialogs, total jumps and the deepest point reached."""
    per = dialog_summary(state)
    rolled = (per.groupBy("last_type")
              .agg(F.count(F.lit(1)).alias("n_dialogs"),
                   F.sum("n_jumps").cast("bigint").alias("n_jumps"),
                   F.max("max_depth").alias("max_depth"),
                   F.sum("n_blocks").cast("bigint").alias("n_blocks")))
    # The share window runs over the (at most 7-row) rolled-up result.
    share = F.bround(F.try_divide(F.col("n_dialogs") * 100.0,
                                  F.sum("n_dialogs").over(Window.partitionBy())), 1)
    return (rolled.withColumn("share_pct", share)
            .withColumn("dropped", F.col("last_type").isin(K.DEEPER_TYPES)))
