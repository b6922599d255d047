"""Sequential funnels (A-2 … A-5) and their text (P-7).

The dashboard scans the table once per tag (six scans for the matching
funnel, five plus a pre-filter for the post funnel).  Here every funnel is
ONE global aggregate of conditional counts: each task reduces its split to one
row of counters (partial aggregation), a single row per task is shuffled, and
the stages are laid out from that one row with ``inline`` — no join, no
second pass, regardless of the table size.

Stage semantics (A-3/A-4): stage 0 is the total; stage i removes the rows
tagged with step i (count = previous − tag count, drop = −tag count); the
last stage is the success tag count itself, and its drop is the residual
−(survivors − successes) when positive, else 0.  The residual therefore holds
every other tag and null tags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import pct, signed_thousands, thousands

FUNNEL_COLUMNS = ["stage_no", "stage", "n_dialogs", "n_drop"]


def tag_counts(df: DataFrame, col: str, tags: Sequence[str], names: Sequence[str] | None = None,
               where: Column | None = None) -> DataFrame:
    """A-1/A-2: one row with ``total`` and one count per tag, in one pass."""
    names = list(names) if names is not None else [f"n_{i}" for i in range(len(tags))]
    cond = (lambda c: c) if where is None else (lambda c: where & c)
    total = F.count(F.lit(1)) if where is None else F.count_if(where)
    return df.agg(total.alias("total"),
                  *[F.count_if(cond(F.col(col) == t)).alias(n) for t, n in zip(tags, names)])


def funnel_from_counts(counts: DataFrame, total_stage: str, total_col: str,
                       steps: Sequence[tuple[str, str]], success: tuple[str, str]) -> DataFrame:
    """Lay out funnel stages from a one-row frame of counts.

    ``steps`` are (stage name, count column) pairs, ``success`` likewise.
    """
    stage_rows = [F.struct(F.lit(0).alias("stage_no"), F.lit(total_stage).alias("stage"),
                           F.col(total_col).cast("bigint").alias("n_dialogs"),
                           F.lit(0).cast("bigint").alias("n_drop"))]
    survivors = F.col(total_col).cast("bigint")
    for i, (stage, c) in enumerate(steps, start=1):
        survivors = survivors - F.col(c)
        stage_rows.append(F.struct(F.lit(i).alias("stage_no"), F.lit(stage).alias("stage"),
                                   survivors.cast("bigint").alias("n_dialogs"),
                                   (-F.col(c)).cast("bigint").alias("n_drop")))
    s_stage, s_col = success
    residual = survivors - F.col(s_col)
    stage_rows.append(F.struct(F.lit(len(steps) + 1).alias("stage_no"), F.lit(s_stage).alias("stage"),
                               F.col(s_col).cast("bigint").alias("n_dialogs"),
                               F.when(residual > 0, -residual).otherwise(F.lit(0)).cast("bigint")
                               .alias("n_drop")))
    return counts.select(F.inline(F.array(*stage_rows)))


def sequential_funnel(df: DataFrame, col: str, steps: Sequence[tuple[str, str]],
                      success: tuple[str, str], total_stage: str,
                      where: Column | None = None) -> DataFrame:
    """Generic sequential funnel over the tag column ``col``.

    ``steps``: (stage name, tag) pairs removed in order; ``success``: (stage
    name, tag) of the final stage; ``where`` restricts the population (the post
    funnel only looks at successful matches).  Returns stage_no, stage,
    n_dialogs, n_drop.
    """
    tags = [t for _, t in steps] + [success[1]]
    names = [f"c{i}" for i in range(len(tags))]
    counts = tag_counts(df, col, tags, names, where)
    return funnel_from_counts(counts, total_stage, "total",
                              [(s, n) for (s, _), n in zip(steps, names[:-1])],
                              (success[0], names[-1]))


def matching_funnel(df: DataFrame, col: str = "status") -> DataFrame:
    """A-3: the 7-stage matching funnel."""
    return sequential_funnel(df, col, K.MATCHING_STEPS, K.MATCHING_SUCCESS, K.MATCHING_TOTAL_STAGE)


def post_funnel(df: DataFrame, col: str = "status_post", status_col: str = "status") -> DataFrame:
    """A-4: the 6-stage post-matching funnel over successful matches only."""
    return sequential_funnel(df, col, K.POST_STEPS, K.POST_SUCCESS, K.POST_TOTAL_STAGE,
                             where=F.col(status_col) == K.TAG_SUCCESS)


def post_funnel_rate(df: DataFrame, col: str = "status_post", status_col: str = "status") -> DataFrame:
    """A-5: solved final tasks and their share of successful matches (1 dp)."""
    succ = F.col(status_col) == K.TAG_SUCCESS
    return (df.agg(F.count_if(succ).alias("total_success"),
                   F.count_if(succ & (F.col(col) == K.POST_SOLVED)).alias("solved"))
            .select("total_success", "solved", pct("solved", "total_success").alias("solved_pct")))


def with_funnel_text(funnel: DataFrame) -> DataFrame:
    """P-7: ``"{n:,} {drop:+,}"``, or just ``"{n:,}"`` when nothing dropped."""
    text = F.when(F.col("n_drop") != 0,
                  F.concat_ws(" ", thousands("n_dialogs"), signed_thousands("n_drop"))
                  ).otherwise(thousands("n_dialogs"))
    return funnel.withColumn("text", text)
