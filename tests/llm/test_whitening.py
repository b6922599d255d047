"""Whitening against whole-number arithmetic in plain Python and numpy's own covariance."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from dialogscope.llm import whitening
from tests.llm.oracle import SF


def kept(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows):
    """(x vectors, n, sums, covariance of x) by plain Python."""
    width = max((len(v) for _, v in kept(rows)), default=0)
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept(rows)]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    cross = [[n * sum(x[d] * x[e] for x in xs) - sums[d] * sums[e] for e in range(width)] for d in range(width)]
    return xs, n, sums, np.array([[c / n ** 2 for c in r] for r in cross])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.5, "x") for i, v in rows], "vec_id long, vector array<double>, whitened double, COMPONENT string")


def check(rows, got, components=32):
    xs, n, sums, covariance = brute(rows)
    values = np.linalg.eigvalsh(covariance)[::-1]
    many = min(components, int((values > values[0] * len(values) * whitening.NOISE).sum()))
    assert len(got) == n * many and {r.component for r in got} == set(range(1, many + 1))
    by = defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / np.trace(covariance)) <= 1e-8
        by[r.vec_id].append(r)
    wanted = defaultdict(list)
    for (i, _), x in zip(kept(rows), xs):
        wanted[i].append(sum((n * c - s) ** 2 for c, s in zip(x, sums)))
    assert {i: sorted(w for w in v for _ in range(many)) for i, v in wanted.items()} == {i: sorted(r.deviation for r in v) for i, v in by.items()}
    unique = [i for i in by if i is not None and len(by[i]) == many]
    white = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in unique])
    at = {i: x for (i, _), x in zip(kept(rows), xs)}
    centred = np.array([[c - s / n for c, s in zip(at[i], sums)] for i in unique])
    if many == len(values):  # Mahalanobis distances need no choice of signs or bases
        assert np.allclose((white ** 2).sum(axis=1), (centred @ np.linalg.inv(covariance) * centred).sum(axis=1), rtol=1e-6, atol=1e-6)
    back = np.linalg.lstsq(centred, white, rcond=None)[0] * np.sqrt(values[:many])
    if len(unique) > len(values):  # unit vectors that the covariance stretches by their eigenvalue
        assert np.allclose(back.T @ back, np.eye(many), atol=1e-6)
        assert np.allclose(covariance @ back, back * values[:many], atol=1e-6 * values[0])


def test_cross_products_are_exact():
    chance = np.random.default_rng(0)
    for n, width, top in [(1, 3, 5), (63, 4, 90), (64, 1, 1), (200, 5, 1 << 40), (130, 3, (1 << 63) - 1), (70, 2, 1)]:
        rows = chance.integers(0, top, (n, width), dtype=np.int64).astype(np.uint64)
        want = [[sum(int(r[d]) * int(r[e]) for r in rows) for e in range(width)] for d in range(width)]
        assert whitening.cross_products(rows).tolist() == want
    assert whitening.cross_products(np.zeros((5, 2), np.uint64)).tolist() == [[0, 0], [0, 0]]


def test_scatter_adds_batches_and_negative_numbers():
    chance = np.random.default_rng(1)
    rows = chance.integers(-(1 << 62), 1 << 62, (150, 3))
    held = whitening.Scatter(3)
    for at in range(0, 150, 40):
        held.add(rows[at:at + 40])
    held.add(rows[:0])
    whole = rows.astype(object)
    assert held.n == 150 and held.sums.tolist() == whole.sum(axis=0).tolist()
    assert held.products.tolist() == (whole.T @ whole).tolist()


@pytest.mark.parametrize("components", [32, 3])
def test_whitened_rows(spark, monkeypatch, components):
    monkeypatch.setattr(whitening, "BATCH", 50)
    chance = np.random.default_rng(2)
    mix = chance.normal(size=(6, 6))
    rows = [(i, [float(c) for c in chance.normal(size=6) @ mix]) for i in range(400)]
    rows += [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("-inf")] * 6)]
    rows += [(None, [0.25] * 6), (7, [0.5] * 6), (910, [1.0]), (911, [])] + [(912, [3.0] * 6)] * 5
    check(rows, whitening.whiten(frame(spark, rows), components).collect(), components)


def test_columns_without_spread_and_equal_columns(spark):
    chance = np.random.default_rng(3)
    rows = [(i, [float(a), 4.0, float(a), float(b)]) for i, (a, b) in enumerate(chance.normal(size=(90, 2)))]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}
    check(rows, got)


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(1, [0.5])] * 3):
        found = whitening.whiten(frame(spark, rows))
        assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_very_large_entries(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, -5.0]), (3, [7.0, 1e17])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {(1 << 63) - 1} and {r.vec_id for r in got} == {0, 1, 2, 3}
    assert all(math.isfinite(r.whitened) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, whitening.op11_whitening(spark, SF).collect())
