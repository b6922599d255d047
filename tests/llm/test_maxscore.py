"""MaxScore against brute force and DuckDB."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogscope.llm import maxscore
from tests.llm.oracle import SF, same_as_sql


def brute(rows, k=5):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    out = []
    for q, a in ints:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows):
    vectors = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, vector array<double>, score double, rank string")
    got = maxscore.top_k(vectors, F.col("vec_id") % 50 == 0)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_exact_and_prunes():
    chance = np.random.default_rng(0)
    decay = 0.9 ** np.arange(64)
    vectors = np.floor(256 * chance.normal(size=(9000, 64)) * decay)
    ids = np.arange(9000)
    counts = {}
    for q in range(0, 9000, 900):
        got = maxscore.max_score(vectors[q], q, ids, vectors, vectors.max(axis=0), vectors.min(axis=0), 5, counts)
        scores = vectors @ vectors[q]
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        assert got == [(-s, i) for s, i in want]
    assert counts["read"] < 0.9 * counts["all"]


@pytest.mark.parametrize("shard, queries", [(16_384, 2_048), (40, 3)])
def test_shards_blocks_and_edge_cases(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "QUERIES", queries)
    chance = np.random.default_rng(1)
    rows = [(i, [float(x) for x in chance.normal(size=8)]) for i in range(-60, 400)]
    rows += [(i, [0.5] * 8) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (550, [float("inf")] * 8), (600, []), (650, [1.0]), (651, [2.0, 3.0, 4.0] * 4),
             (None, [1.0] * 8), (3, rows[63][1]), (100, [9.0] * 8), (700, [0.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_less_than_half_is_read_with_shared_thresholds():
    """The embeddings of sf0.1 (directions without clusters) in several shards, as the two rounds of the operator take them."""
    import pyarrow.parquet as pq
    rows = pq.read_table(os.path.join(os.path.dirname(SF), "sf0.1", "embeddings.parquet")).to_pydict()
    ids, vectors = np.array(rows["vec_id"]), np.floor(256 * np.array(rows["embedding"], dtype=np.float64))
    place = np.abs(vectors).argmax(axis=1)
    order = np.argsort(place * 2 + (vectors[np.arange(len(ids)), place] < 0), kind="stable")
    shards = np.array_split(order, 5)
    counts = {}
    for home, shard in enumerate(shards):
        for q in shard[ids[shard] % 50 == 0]:
            found, start = [], -np.inf
            for s in [home, *[x for x in range(5) if x != home]]:
                some = shards[s][np.argsort(ids[shards[s]])]
                part = vectors[some]
                got = maxscore.max_score(vectors[q], ids[q], ids[some], part, part.max(axis=0), part.min(axis=0), 5, counts, start, (part * part).sum(axis=1))
                if s == home and len(got) == 5:
                    start = got[-1][0]
                found += got
            scores = vectors @ vectors[q]
            assert sorted((-s, i) for s, i in found)[:5] == sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:5]
    print(counts["read"] / counts["all"])
    assert counts["read"] < 0.5 * counts["all"]


def test_pairs_out_of_reach_never_meet(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 50)
    monkeypatch.setattr(maxscore, "QUERIES", 4)
    chance = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 3 + chance.normal(size=8) * 0.1]) for i in range(400)]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("mark", F.xxhash64("vec_id", "vector"))
    held = maxscore._dealt(df)
    found, bounds = maxscore._homes(held, F.col("vec_id") % 50 == 0, 5)
    starts = found.groupBy(F.col("query_id").alias("vec_id"), "mark").agg(F.min("score").alias("start"))
    asked = held.where("vec_id % 50 = 0").join(starts, ["vec_id", "mark"], "left")
    assert bounds.count() == 8 and asked.count() == 8
    assert maxscore._pairs(asked, bounds, 8, 2).count() < 8 * 7 / 2


def test_very_large_components(spark):
    rows = [(0, [1e15, -3.0]), (1, [1e15, 5.0]), (2, [-1e15, 0.25]), (50, [0.1, 0.2]), (3, [1e12, 7.0])]
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert run(spark, rows) == [(q, n, i, limit(s)) for q, n, i, s in brute(rows)]


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, []), (1, []), (2, [])]) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_duckdb(spark):
    assert len(same_as_sql(spark, maxscore.op9_maxscore, maxscore.OP9_SQL)) == 50
