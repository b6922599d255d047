"""Operator 10: SimHash near-duplicates over pigeonhole blocks.

Fingerprint: A-Z lower-cased, words are runs without ASCII white space, shingles
of k words joined by one space (fewer words: the whole sequence), XXH64 with
seed 42; a bit is set if more than half of the hashes set it.  Null, empty and
blank texts have fingerprint zero, which is linked like any other.

Links: d differing bits fall into at most d of 2d blocks, so two linked
fingerprints agree on some d whole blocks.  Each *distinct* fingerprint
is filed under every choice of d blocks (20 keys of about 32 bits for d = 3), buckets
are joined with their sizes, and inside a bucket the Hamming distance is verified.
A bucket above ``BUCKET`` members is not compared as it is: its members agree
outside the key's free bits, so those are split into d + 1 runs, of which one must agree,
too; members are filed again under key plus run, until buckets are small or at most
``FREE_BITS`` bits are free, which leaves at most 2^FREE_BITS distinct members.
Nothing is capped, no link is lost, and a bucket emits a spanning star, not its pairs.

Copies share one fingerprint and meet again only in the last join.  Rows with a null doc_id
take part; a component's id is its smallest non-null doc_id (null if it has none).
Repeated rows give repeated result rows.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, own_exchange, spread, strings, table
from dialogscope.llm.graph import components

SEED = 42
BUCKET = 256
FREE_BITS = 12


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    ones, n, at = np.zeros(64, np.int64), len(words) - k + 1, 0
    while at < n:  # a bounded piece of the shingles at a time
        part = words[at:at + 65_536 + k - 1]
        hashes = b"".join([xxhash.xxh64_digest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(k))))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        at += 65_536
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The SimHash as a bigint with the same bits."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, shingle) for t in strings(texts)], np.uint64).view(np.int64))

    return simhash(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _runs(bits: list[int], n: int) -> list[int]:
    """n masks that share out the given bit positions in order."""
    edges = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def block_masks(distance: int) -> list[int]:
    """Masks of every choice of ``distance`` blocks out of twice as many."""
    blocks = _runs(list(range(64)), 2 * distance)
    return [sum(c) for c in combinations(blocks, distance)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """The mask with each of distance + 1 runs of its free bits added."""
    return [mask | r for r in _runs([b for b in range(64) if not mask >> b & 1], distance + 1) if r]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest position of its class) after linking positions i and j."""
    while True:
        a, b = label[i], label[j]
        if not (open_ := a != b).any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up


def _stars(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links inside each run of equal keys (key: group numbers, ascending)."""
    label, i, s = np.arange(len(fp)), np.arange(len(fp)), 0
    held, n_held = [], 0
    while len(i):
        s += 1
        i = i[i + s < len(fp)]
        i = i[key[i] == key[i + s]]
        hit = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= distance]
        hit = hit[label[hit] != label[hit + s]]
        held.append((hit, hit + s))
        n_held += len(hit)
        if n_held > 500_000:
            label, held, n_held = _merge(label, *map(np.concatenate, zip(*held))), [], 0
    if held:
        label = _merge(label, *map(np.concatenate, zip(*held)))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own], fp[label[own]]


def _bucket_links(distance: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (mask, part, fp), sorted by mask and part; a bucket may go on in the next batch."""
        held = np.empty((3, 0), np.int64)
        for rows in _then_none(batches):
            if rows is not None:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns])], axis=1)
            if not held.shape[1]:
                continue
            new = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0)) + 1
            done = held.shape[1] if rows is None else int(new[-1]) if len(new) else 0
            if done:
                key = np.zeros(done, np.int64)
                key[new[new < done]] = 1
                a, b = _stars(np.cumsum(key), held[2, :done].view(np.uint64), distance)
                held = held[:, done:].copy()
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    return links


def _then_none(batches):
    yield from batches
    yield None


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``nodes.fp`` exactly as all links of
    at most ``distance`` bits do: every edge is a path of verified links inside one bucket."""
    spark = nodes.sparkSession
    if distance == 0:
        return spark.createDataFrame([], "a bigint, b bigint")

    def filed(rows: DataFrame, masks: Column) -> DataFrame:
        rows = rows.select("fp", F.explode(masks).alias("mask"))
        return rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")

    masks = block_masks(distance)
    members = filed(nodes, F.array(*[F.lit(_signed(m)) for m in masks]))
    found = []
    while True:
        sizes = (members.groupBy("mask", "part", own_exchange("mask", "part")).agg(F.count(F.lit(1)).alias("n"))
                 .where("n > 1").drop("_own"))
        shared = cut(members.join(sizes, ["mask", "part"]))
        small = f"n <= {BUCKET} or bit_count(~mask) <= {FREE_BITS}"
        found.append(shared.where(small).select("mask", "part", "fp"))
        large = shared.where(f"not ({small})")
        if large.isEmpty():
            break
        finer = {m: finer_masks(m, distance) for m in masks}
        masks = sorted({f for x in finer.values() for f in x})
        by_mask = F.create_map(*[x for m, fs in finer.items()
                                 for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in fs]))])
        members = filed(large, by_mask[F.col("mask")]).distinct()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    n = spread(nodes)
    return (every.repartition(n, "mask", "part").sortWithinPartitions("mask", "part")
            .mapInArrow(_bucket_links(distance), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, print (a hash of the text), fp (bigint), component_id for every row of ``docs``."""
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("print"), fingerprints(F.col("text"), shingle).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("of"), own_exchange("root")).agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, rooted.root == least.of).select(F.col("fp").alias("class_fp"), "component_id")
    return prints.join(classes, prints.fp == classes.class_fp).select("doc_id", "print", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies of a smaller doc_id.

    Rows that repeat both doc_id and text of a representative stay with it; rows without a doc_id stay.
    """
    found = near_duplicates(docs, shingle, distance)
    going = found.where("doc_id > component_id").select(F.struct("doc_id", "print").alias("gone")).distinct()
    own = F.struct(F.col("doc_id"), F.xxhash64("text").alias("print"))
    return docs.join(going, own == F.col("gone"), "left_anti")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
