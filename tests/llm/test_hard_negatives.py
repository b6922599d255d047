"""Hard negatives against brute force and DuckDB; the tree's elimination against all distances."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogscope.llm import hard_negatives
from tests.llm.oracle import SF, same_as_sql


def long(s):
    return max(-(1 << 63), min((1 << 63) - 1, s))


def brute(rows, every=100):
    width = max((len(v) for *_, v in rows if v), default=0)
    good = sorted({(i, l, tuple(math.floor(256 * x) for x in v) + (0,) * (width - len(v))) for i, l, v in rows
                   if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    good = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in good]
    out = []
    for a, label, q in good:
        if a % every:
            continue
        scored = sorted((-long(sum(x * y for x, y in zip(q, v))), i, l == label) for i, l, v in good if i != a)
        for s, positive, _ in [x for x in scored if x[2]][:5]:
            found = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, positive, n, i, -s, -t) for n, (t, i, _) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, every=100):
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, vector array<double>, node int, mark string")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(vectors, F.col("vec_id") % every == 0, label)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def clustered(n, width, seed, labels=3, clusters=12):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(clusters, width))
    return [(i, int(chance.integers(labels)), [float(x) for x in centres[chance.integers(clusters)] + 0.1 * chance.normal(size=width)]) for i in range(n)]


def edge_rows():
    rows = clustered(300, 6, 0)
    rows += [(i, i % 3, [0.5] * 6) for i in range(300, 420)]  # ties, also among anchors
    rows += [(1000, 1, None), (1100, None, [1.0] * 6), (1200, 1, [1.0, None]), (1300, 1, [float("nan")] * 6), (1400, 2, [float("inf")] * 6), (None, 1, [1.0] * 6),
             (1500, 1, []), (1600, 1, [2.0]), (1601, 2, [1.7, 0.1]), (1700, 9, [3.0] * 6), (0, 1, [0.5] * 6), (0, 2, [0.5] * 6), (200, 2, [-1.0] * 6), rows[5], rows[200]]
    return rows


@pytest.mark.parametrize("leaf, part, queries, fan", [(16_384, 16_384, 8_192, 32), (40, 30, 3, 4)])
def test_against_brute_force(spark, monkeypatch, leaf, part, queries, fan):
    for name, value in {"LEAF": leaf, "PART": part, "QUERIES": queries, "SLICE": 2, "LEVELS": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives.build, "__defaults__", (fan,))
    want = brute(edge_rows())
    assert len(want) > 20
    assert run(spark, edge_rows()) == want


def test_rows_that_cannot_be_split(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 20)
    monkeypatch.setattr(hard_negatives, "PART", 25)
    rows = [(i, i % 2, [1.0, 2.0]) for i in range(120)]
    assert run(spark, rows, 50) == brute(rows, 50)


def test_very_large_components(spark):
    rows = [(0, 1, [1e15, -3.0]), (1, 2, [1e15, 5.0]), (2, 1, [1e13, 0.25]), (100, 1, [0.1, 0.2]), (3, 2, [1e12, 7.0]), (4, 2, [1e300, 1.0]), (200, 3, [1e300, 1.0]), (201, 3, [-1e300, 1.0])]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 2, [1.0])], [(1, 1, [1.0]), (2, 1, [1.0])], [(0, 1, []), (1, 2, []), (2, 2, []), (3, 4, [])]):
        assert run(spark, rows) == brute(rows)


def test_survivors_hold_every_row_of_the_annulus():
    vectors = np.floor(256 * np.array([v for *_, v in clustered(600, 4, 4)]))
    m = float(np.sqrt((vectors ** 2).sum(axis=1).max()))
    points = hard_negatives.far_apart(vectors, m, 12)
    heights = hard_negatives._height(vectors, m)
    d = hard_negatives.distances(vectors, heights, points, hard_negatives._height(points, m))
    child = d.argmin(axis=1)
    low, high = (np.array([[f(d[child == j, i]) for j in range(12)] for i in range(12)]) for f in (np.min, np.max))
    dropped = 0
    for q in vectors[::40]:
        scores = vectors @ q
        for s in np.sort(scores)[[-1, -20, -200, 5]]:
            bounds = np.floor([s, 0.8 * s])
            r1, r2 = (hard_negatives.radius(np.array([q @ q]), m, np.array([b])) for b in (bounds.max(), bounds.min()))
            at = hard_negatives.distances(q[None], np.zeros(1), points, hard_negatives._height(points, m))
            alive = hard_negatives.survivors(at, low, high, r1, r2, hard_negatives.SLACK * m)[0]
            inside = (scores >= bounds.min()) & (scores <= bounds.max())
            assert set(child[inside]) <= set(np.flatnonzero(alive))
            dropped += int((~alive).sum())
    assert dropped > 100


def test_leaves_are_eliminated(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 100)
    seen = Counter()
    whole = hard_negatives.routed

    def counted(tree, queries):
        at = whole(tree, queries)
        seen["pairs"] += at.count()
        seen["all"] += queries.count() * tree.rows.select("node").distinct().count()
        return at

    monkeypatch.setattr(hard_negatives, "routed", counted)
    rows = clustered(2000, 8, 5, clusters=30)
    assert run(spark, rows, 50) == brute(rows, 50)
    assert 0 < seen["pairs"] < 0.5 * seen["all"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_duckdb(spark):
    assert len(same_as_sql(spark, hard_negatives.op13_hard_negatives, hard_negatives.OP13_SQL)) > 20
