"""The drop-off chain against the linear system solved by numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogscope import constants as K
from dialogscope.operators import dropoff_chain

TYPE = "dialog_id string, pos long, block string"


def solved(rows):
    by = {}
    for ident, pos, block in rows:
        if block is not None:
            by.setdefault(ident, []).append((pos, block))
    names = sorted({b for r in by.values() for _, b in r})
    at = {b: i for i, b in enumerate(names)}
    moves, ends = np.zeros((len(names),) * 2), np.zeros(len(names))
    for r in by.values():
        blocks = [b for _, b in sorted(r)]
        for a, b in zip(blocks, blocks[1:]):
            moves[at[a], at[b]] += 1
        ends[at[blocks[-1]]] += 1
    n = moves.sum(axis=1) + ends
    lost = np.array([b.startswith(tuple(K.DEEPER_TYPES)) for b in names])
    system = np.eye(len(names)) - moves / n[:, None]
    p, t = np.linalg.solve(system, ends / n * lost), np.linalg.solve(system, np.ones(len(names)))
    return {b: (int(n[i]), p[i], t[i] - 1) for b, i in at.items()}


def compare(spark, rows, chunks):
    df = spark.createDataFrame(rows, TYPE)
    got = dropoff_chain.solve(dropoff_chain.transitions(df, range_partitions=chunks)).collect()
    want = solved(rows)
    assert {r.block: r.n for r in got} == {b: w[0] for b, w in want.items()}
    longest = max((w[2] + 1 for w in want.values()), default=1)
    assert all(abs(r.p_drop - want[r.block][1]) < 1e-9 and abs(r.mean_left - want[r.block][2]) < 1e-9 * longest for r in got)


@pytest.mark.parametrize("chunks", [1, 7])
def test_random_dialogs_with_a_hot_one(spark, chunks):
    chance = random.Random(chunks)
    kinds = ["plan", "action", "action 2", "bossaction", "summary", "info 3", "problem", "note", "> a line", ""]
    rows = [("hot" if k % 3 == 0 else f"d{chance.randrange(60)}", k, chance.choices(kinds, range(1, 11))[0]) for k in range(1500)]
    rows += [(None, k, "action") for k in range(3)] + [("d1", 5000, None), ("alone", 0, "bossaction")]
    compare(spark, rows, chunks)


def test_slow_chain(spark):
    """A ring of states in fixed order, left seldom: plain iteration would take hundreds of steps a digit."""
    ring = ["plan", "info 1", "action", "problem", "note", "summary"]
    rows = [(f"d{d}", k, ring[(d + k) % 6]) for d in range(4) for k in range(150 + 37 * d)]
    compare(spark, rows, 5)


def test_one_block_and_no_block(spark):
    compare(spark, [("a", 0, "action")], 2)
    assert dropoff_chain.solve(dropoff_chain.transitions(spark.createDataFrame([], TYPE))).count() == 0
    assert dropoff_chain.solve(dropoff_chain.transitions(spark.createDataFrame([("a", 0, None)], TYPE))).count() == 0


def test_transitions_do_not_depend_on_chunks(spark):
    rows = [("x", k, f"b{k % 7}") for k in range(300)] + [("y", k, f"b{k % 3}") for k in range(10)]
    df = spark.createDataFrame(rows, TYPE)
    sets = [{(r.block, r.next, r.n) for r in dropoff_chain.transitions(df, range_partitions=n).collect()} for n in (1, 4, 50)]
    assert sets[0] == sets[1] == sets[2] and sum(n for _, _, n in sets[0]) == 310
    assert dropoff_chain.transitions(df).where(F.col("next").isNull()).agg(F.sum("n")).first()[0] == 2
