"""SimHash fingerprints and components against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash

from dialogscope.llm import simhash
from dialogscope.llm.graph import components
from tests.llm.oracle import SF


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps, distance):
    """Position -> smallest position in its class."""
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label.tolist()
        label = new


TEXTS = [None, "", " \t\n\x0b\f\r", "One", "one two", "ONE  TWO\nthree", "É é É", "a b c d e f g", "A B\tC D E F G", "x" * 1000, "\xa0 \x85 \x1c"]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in docs.select("text", simhash.fingerprints(docs.text).alias("fp")).collect():
        assert r.fp % (1 << 64) == brute_fingerprint(r.text), r.text
    long = " ".join(str(i % 977) for i in range(150_000))
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_same_hash_as_sparks_function(spark):
    got = spark.sql("select xxhash64('one two three')").first()[0] % (1 << 64)
    assert got == brute_fingerprint("one two three")


def clusters(seed, groups):
    pick = random.Random(seed)
    out = set()
    for size, flips in groups:
        centre = pick.getrandbits(64)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, flips))))
    return sorted(out)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_components_of_links_are_the_brute_force_ones(spark, monkeypatch, distance):
    monkeypatch.setattr(simhash, "BUCKET", 8)  # buckets above 8 are split further, down to 12 free bits
    fps = clusters(distance, [(400, 5), (120, 3), (60, 8), (1, 0), (300, 30), (200, 64)]) + [0, 1, 3, 7, (1 << 64) - 1]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(5)
    roots = {r.node: r.root for r in components(simhash.links(nodes, distance)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = brute_classes(fps, distance)
    got = {}
    for s in signed:
        got.setdefault(roots.get(s, s), set()).add(s)
    expect = {}
    for s, c in zip(signed, want):
        expect.setdefault(c, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))
    assert all(root == min(members) for root, members in got.items())


def test_a_bucket_may_span_batches():
    import pyarrow as pa
    fps = [0, 1, 2, 7, 255, 256]
    rows = [pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([9], pa.int64()), pa.array([f], pa.int64())],
                                       ["mask", "part", "fp"]) for f in fps]
    out = [t for b in simhash._bucket_links(3)(iter(rows)) for t in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(out) == [(1, 0), (2, 0), (7, 0), (256, 0)]


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_near_duplicates_with_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS, 10)] + [(None, "a b c d e f g"), (None, "lonely words here now"), (3, "a b c d e f g"),
                                                      (17, "a b c d e f g"), (17, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_classes(fps, 3)
    want = [(i, f, min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None))
            for (i, _), f, c in zip(rows, fps, label)]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_is_the_brute_force_one(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs)
    fps = [simhash.fingerprint(docs[i]) for i in ids]
    label = brute_classes(fps, 3)
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, SF).collect()} == want
