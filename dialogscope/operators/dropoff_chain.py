"""Where dialogs are lost, as an absorbing Markov chain over block texts (B-8/B-9/B-11 in the long run).

A dialog moves from block to block and ends; it ends as a drop-off if its last block's type is one (B-9).  ``transitions`` counts
the moves as a sparse matrix (block, next, n) with next null at a dialog's end; ``solve`` gives for each block text, from (I - P) x = b, the probability
that a dialog standing there ends as a drop-off and the mean number of blocks still to come.

The matrix and all vectors are DataFrames; the driver gets a few scalar products a step.  Plain iteration would take some thirty times a dialog's
length, so the systems are solved by stabilised biconjugate gradients (two matrix-vector products a step, both systems in one join).  It stops by a proven bound:
no entry of x is further from the solution than the largest residual times the norm of the inverse, the largest mean number
of steps; an approximation t of those steps whose residual is at most 1/2 proves that norm to be at most 2 max t.  The bound is held against
``tolerance`` for the probabilities, and against ``tolerance`` times max t for the steps.  Cycles that get no nearer (a tolerance beyond
doubles) raise an ArithmeticError.

Rows are range-partitioned by (dialog, order), so a hot dialog is spread over chunks; a chunk gives its counted moves and one row per
dialog that ends in it, and those rows alone are joined up.  Rows whose block is null are left out; rows whose id is null make one dialog.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..config import default_parallelism, scratch_dir
from .skeleton import block_type

TOLERANCE = 1e-10
CYCLE = 60  # steps before the residual is computed anew
STALLED = 3  # cycles without a smaller error before it gives up
SYSTEMS = (0, 1)  # 0: drop-off, 1: blocks to come


def transitions(blocks: DataFrame, order: Sequence[str] = ("pos",), id_col: str = "dialog_id", range_partitions: int | None = None) -> DataFrame:
    """(block, next, n): how often ``next`` follows ``block``; next is null where a dialog ends."""
    spark = blocks.sparkSession
    scratch_dir(spark)
    rows = blocks.where(F.col("block").isNotNull()).select(F.col(id_col).alias("_id"), "block", *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    keys = [f"_o{k}" for k in range(len(order))]
    chunked = rows.repartitionByRange(range_partitions or default_parallelism(spark), "_id", *keys).withColumn("_chunk", F.spark_partition_id())
    w = Window.partitionBy("_id", "_chunk").orderBy(*keys)
    moves = chunked.select("_id", "_chunk", "block", F.lead("block").over(w).alias("next"), F.first("block").over(w).alias("_first"))
    end = F.when(F.col("next").isNull(), F.struct("_id", "_chunk", "_first"))
    counted = moves.groupBy("block", "next", end.alias("_end")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    inner = counted.where(F.col("_end").isNull()).select("block", "next", "n")
    chunks = Window.partitionBy("_end._id").orderBy("_end._chunk")
    edges = counted.where(F.col("_end").isNotNull()).select("block", F.lead("_end._first").over(chunks).alias("next"), "n")
    return inner.unionByName(edges).groupBy("block", "next").agg(F.sum("n").alias("n"))


def _ratio(a: float | None, b: float | None) -> float:
    return a / b if a and b else 0.0


def _times(matrix: DataFrame, rows: DataFrame, source: str, target: str) -> DataFrame:
    """``rows`` with the columns ``target``k = (I - P) ``source``k, cut off from their lineage."""
    sent = rows.select(F.col("state").alias("next"), *[F.col(f"{source}{k}").alias(f"_y{k}") for k in SYSTEMS])
    got = matrix.join(sent, "next").groupBy("state").agg(*[F.sum(F.col("w") * F.col(f"_y{k}")).alias(f"_z{k}") for k in SYSTEMS])
    met = rows.join(got, "state", "left")
    made = [(F.col(f"{source}{k}") - F.coalesce(f"_z{k}", F.lit(0.0))).alias(f"{target}{k}") for k in SYSTEMS]
    return met.select(*[c for c in rows.columns if c not in {f"{target}{k}" for k in SYSTEMS}], *made).checkpoint()


def _dots(rows: DataFrame, *pairs: tuple[str, str]) -> list[list[float]]:
    """The scalar products of each pair, per system."""
    found = rows.agg(*[F.sum(F.col(f"{a}{k}") * F.col(f"{b}{k}")) for a, b in pairs for k in SYSTEMS]).first()
    return [[found[i * len(SYSTEMS) + k] for k in SYSTEMS] for i in range(len(pairs))]


def _set(rows: DataFrame, **columns) -> DataFrame:
    return rows.withColumns({f"{name}{k}": make(k) for name, make in columns.items() for k in SYSTEMS})


def _error(rows: DataFrame) -> float:
    """The proven bound of the larger error of the two systems (the second relative to its largest value)."""
    lost, steps, longest = rows.agg(*[F.max(F.abs(f"r{k}")) for k in SYSTEMS], F.max("x1")).first()
    return max(2 * longest * lost, 2 * steps) if steps <= 0.5 else float("inf")


def solve(moves: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(block, n, p_drop, mean_left): per block text its rows, the probability of a drop-off and the mean number of blocks to come."""
    scratch_dir(moves.sparkSession)
    moves = moves.checkpoint()
    ends = F.sum(F.when(F.col("next").isNull(), F.col("n")))
    lost = block_type(F.col("state")).isin(*K.DEEPER_TYPES).cast("double")
    rows = moves.groupBy(F.col("block").alias("state")).agg(F.sum("n").alias("n"), F.coalesce(ends, F.lit(0)).alias("_ends"))
    rows = rows.select("state", "n", (F.col("_ends") / F.col("n") * lost).alias("b0"), F.lit(1.0).alias("b1"), *[F.lit(0.0).alias(f"x{k}") for k in SYSTEMS]).checkpoint()
    if rows.isEmpty():
        return rows.select(F.col("state").alias("block"), "n", F.col("x0").alias("p_drop"), F.col("x1").alias("mean_left"))
    matrix = moves.where(F.col("next").isNotNull()).join(rows.select(F.col("state").alias("block"), F.col("n").alias("_all")), "block")
    matrix = matrix.select(F.col("block").alias("state"), "next", (F.col("n") / F.col("_all")).alias("w")).checkpoint()
    c = lambda name: (lambda k: F.col(f"{name}{k}"))
    errors: list[float] = []
    while True:
        rows = _set(_times(matrix, rows, "x", "v"), r=lambda k: F.col(f"b{k}") - F.col(f"v{k}"))
        errors.append(_error(rows))
        if errors[-1] <= tolerance:
            return rows.select(F.col("state").alias("block"), "n", F.col("x0").alias("p_drop"), (F.col("x1") - 1).alias("mean_left"))
        if len(errors) > STALLED and min(errors[-STALLED:]) >= min(errors[:-STALLED]) < float("inf"):
            raise ArithmeticError(f"an error of {min(errors)} at most is proven, {tolerance} was asked")
        rows = _set(rows, q=c("r"), p=c("r"))
        (rho,) = _dots(rows, ("q", "r"))
        for _ in range(CYCLE):
            rows = _times(matrix, rows, "p", "v")
            (qv,) = _dots(rows, ("q", "v"))
            alpha = [_ratio(rho[k], qv[k]) for k in SYSTEMS]
            rows = _times(matrix, _set(rows, s=lambda k: F.col(f"r{k}") - alpha[k] * F.col(f"v{k}")), "s", "t")
            ts, tt = _dots(rows, ("t", "s"), ("t", "t"))
            omega = [_ratio(ts[k], tt[k]) for k in SYSTEMS]
            rows = _set(rows, x=lambda k: F.col(f"x{k}") + alpha[k] * F.col(f"p{k}") + omega[k] * F.col(f"s{k}"),
                        r=lambda k: F.col(f"s{k}") - omega[k] * F.col(f"t{k}"))
            (now,) = _dots(rows, ("q", "r"))
            beta = [_ratio(now[k], rho[k]) * _ratio(alpha[k], omega[k]) for k in SYSTEMS]
            rows = _set(rows, p=lambda k: F.col(f"r{k}") + beta[k] * (F.col(f"p{k}") - omega[k] * F.col(f"v{k}")))
            rho = now
            if _error(rows) <= tolerance / 2 or not any(beta):  # done, or nothing to go on with
                break
        rows = _set(rows, x=lambda k: F.col(f"x{k}") + F.col(f"r{k}"))  # one plain step: never away from the solution
