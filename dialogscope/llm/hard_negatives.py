"""Operator 13: hard negatives by a GNAT-style multiway hyperplane tree over Spark tables.

Inner products become distances: with M the largest norm, a row x stands at (x, sqrt(M^2 - |x|^2)) and an anchor q at (q, 0), so that
d(q, x)^2 = |q|^2 + M^2 - 2 q.x.  A window of scores is an annulus around the anchor.

The tree: a node with more than ``LEAF`` rows takes ``FAN`` split points (a bounded sample, chosen far apart), each row goes to
the split point nearest to it, and every split point i stores, for every sibling j, the range of distances from i to the rows under j.
Nodes are split level by level, each level a Spark pass in which a node's rows are dealt out in parts of bounded size.  The
stored tree is a table with one row of FAN points and FAN x FAN ranges per node.

A search starts at the root with an annulus [r1, r2].  Sibling j survives if, for every split point i at distance d, its range from i meets
[max(d - r2, r1 - d), d + r2].  (anchor, node) pairs that do not survive are dropped before any row is looked at.  In the leaves
all scores are computed exactly as whole numbers, by parts of at most ``PART`` rows and ``QUERIES`` anchors.

Each search runs twice: in the leaf that holds the anchor, whose k-th best score narrows the annulus, and then from the root.
First the positives (same label, no window), then for each positive its window of negatives.

Rows that can't be split (a node whose sample has no two places, or the last level) stay in one leaf of any size; it is searched in
parts, so no bound drops a row.

Defined results: rows with a null vec_id, label or vector and those with null or non-finite components take no part.  A shorter
vector counts as filled up with zeros.  Rows that are equal in id, label and vector count once; different rows under one id
are rows of their own, candidates and, if the id is an anchor's, anchors (never for each other).  Scores beyond 64 bits become the nearest bigint;
windows are taken of these.  An empty table, or one without anchors, gives no rows.  Further columns of the input are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import own_exchange, stored, table
from dialogscope.llm.maxscore import valid

K = 5
FAN = 32
SAMPLE = 8 * FAN
LEAF = 16_384
PART = 16_384
QUERIES = 8_192
LEVELS = 8
SLICE = 64
SLACK = 1e-6  # of M: more than rounding can add to a distance
LEAST, MOST = -(1 << 63), (1 << 63) - 1
ROW = "vec_id bigint, mark bigint, label int, vector array<double>, node bigint"
QUERY = "q bigint, anchor_id bigint, label int, vector array<double>, same boolean, low bigint, high bigint, node bigint"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows."""
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _height(vectors: np.ndarray, m: float) -> np.ndarray:
    """The added coordinate of rows."""
    return np.sqrt(np.maximum(0, m * m - (vectors * vectors).sum(axis=1)))


def distances(vectors: np.ndarray, heights: np.ndarray, points: np.ndarray, point_heights: np.ndarray) -> np.ndarray:
    """From every row to every point, by differences (no cancellation)."""
    out = np.empty((len(vectors), len(points)))
    for k, (p, h) in enumerate(zip(points, point_heights)):
        out[:, k] = np.sqrt(((vectors - p) ** 2).sum(axis=1) + (heights - h) ** 2)
    return out


def far_apart(vectors: np.ndarray, m: float, k: int) -> np.ndarray:
    """Up to k different rows, each the farthest from those before."""
    heights, chosen = _height(vectors, m), [0]
    near = distances(vectors, heights, vectors[:1], heights[:1])[:, 0]
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(vectors, heights, vectors[chosen[-1:]], heights[chosen[-1:]])[:, 0])
    return vectors[chosen]


def survivors(d: np.ndarray, low: np.ndarray, high: np.ndarray, r1: np.ndarray, r2: np.ndarray, slack: float) -> np.ndarray:
    """Which siblings may hold a row at a distance of r1 to r2: (anchors, siblings), for distances d (anchors, split points) and the
    ranges (split points, siblings).  What can't be compared survives."""
    out = np.ones((len(d), low.shape[1]), bool)
    for i in range(d.shape[1]):
        at = d[:, i]
        out &= ~((high[i] < (np.maximum(at - r2, r1 - at) - slack)[:, None]) | (low[i] > (at + r2 + slack)[:, None]))
    return out


def radius(norms2: np.ndarray, m: float, score: np.ndarray) -> np.ndarray:
    """The distance at which an anchor's inner product is ``score``."""
    return np.sqrt(np.maximum(0, norms2 + m * m - 2.0 * score))


# --- tree -----------------------------------------------------------------------------------

def _choose(m: float, fan: int):
    def choose(key: tuple[pa.Scalar, ...], sample: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(sample.column("mark")), kind="stable")
        points = far_apart(_matrix(sample.column("vector"))[order], m, fan)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "k": pa.array([len(points)], pa.int32()), "points": pa.array([points.ravel()], pa.list_(pa.float64()))})
    return choose


def _assign(m: float, fan: int):
    def assign(rows: pa.Table, split: pa.Table) -> pa.Table:
        empty = {"i": pa.nulls(0, pa.int32()), "j": pa.nulls(0, pa.int32()), "near": pa.nulls(0, pa.float64()), "far": pa.nulls(0, pa.float64())}
        names = ["vec_id", "mark", "label", "vector", "node", *empty]
        if not rows.num_rows:
            return pa.table({n: (rows.column(n) if n in rows.column_names else empty[n]) for n in names})
        vectors, k = _matrix(rows.column("vector")), split.column("k")[0].as_py()
        points = _matrix(split.column("points")).reshape(k, -1)
        d = distances(vectors, _height(vectors, m), points, _height(points, m))
        child = d.argmin(axis=1)
        node = rows.column("node")[0].as_py()
        held = rows.select(["vec_id", "mark", "label", "vector"]).append_column("node", pa.array(node * fan + 1 + child, pa.int64()))
        for n in empty:
            held = held.append_column(n, pa.nulls(len(held), empty[n].type))
        ranges = [(node, i, j, d[child == j, i].min(), d[child == j, i].max()) for j in np.unique(child).tolist() for i in range(k)]
        found = pa.table({n: pa.array([r[c] for r in ranges], t) for c, (n, t) in enumerate((("node", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("near", pa.float64()), ("far", pa.float64())))})
        for n in ("vec_id", "mark", "label", "vector"):
            found = found.append_column(n, pa.nulls(len(found), held.schema.field(n).type))
        return pa.concat_tables([held.select(names), found.select(names).cast(held.select(names).schema)])
    return assign


class Tree:
    """rows: every row with its leaf as ``node``.  levels: one table (node, k, points, ranges) per level.  sizes: (node, parts) of the leaves."""

    def __init__(self, rows: DataFrame, m: float, fan: int):
        self.rows, self.m, self.fan, self.levels = rows, m, fan, []
        self.parts = None


def _parts(df: DataFrame, size: int, name: str) -> DataFrame:
    """(node, name): in how many parts a node's rows are dealt out."""
    return df.groupBy("node", own_exchange("node")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name)).drop("_own")


def _dealt(df: DataFrame, parts: DataFrame, name: str, by: str) -> DataFrame:
    """With the part of each row as ``name``, by hash; ``parts`` holds (node, n_<name>)."""
    return df.join(parts, "node").withColumn(name, F.pmod(F.xxhash64(F.lit(name), by), F.col(f"n_{name}")).cast("int"))


def build(rows: DataFrame, m: float, fan: int = FAN) -> Tree:
    """The tree over (vec_id, mark, label, vector); vectors of equal length, m the largest norm."""
    tree = Tree(stored(rows.withColumn("node", F.lit(0).cast("bigint")).select("vec_id", "mark", "label", "vector", "node")), m, fan)
    for depth in range(LEVELS):
        big = stored(tree.rows.groupBy("node", own_exchange("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF).select("node", "n"))
        if big.isEmpty():
            break
        # A row is in the sample if its own uniform number is below SAMPLE / n: about SAMPLE rows of each node.
        uniform = F.pmod(F.xxhash64("mark", F.lit(depth)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = tree.rows.join(big, "node").where(uniform < F.lit(SAMPLE) / F.col("n")).select("node", "mark", "vector")
        splits = stored(sample.groupBy("node").applyInArrow(_choose(m, fan), "node bigint, k int, points array<double>").where("k > 1"))
        if splits.isEmpty():
            break
        counts = big.join(splits.select("node"), "node", "left_semi").select("node", F.ceil(F.col("n") / PART).cast("int").alias("n_part"))
        dealt = _dealt(tree.rows, counts, "part", "mark").drop("n_part")
        copies = splits.join(counts, "node").select("node", "k", "points", F.explode(F.sequence(F.lit(0), F.col("n_part") - 1)).alias("part"))
        made = stored(dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part"))
                   .applyInArrow(_assign(m, fan), ROW + ", i int, j int, near double, far double"))
        ranges = (made.where("i is not null").groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"))
                  .groupBy("node").agg(F.collect_list(F.struct("i", "j", "near", "far")).alias("ranges")))  # at most FAN x FAN
        tree.levels.append(stored(splits.join(ranges, "node").select("node", "k", "points", *(F.col(f"ranges.{c}").alias(c) for c in ("i", "j", "near", "far")))))
        rest = tree.rows.join(splits.select("node"), "node", "left_anti")
        tree.rows = stored(made.where("i is null").select(*tree.rows.columns).unionByName(rest))
    tree.parts = stored(_parts(tree.rows, PART, "n_part"))
    return tree


# --- search ---------------------------------------------------------------------------------

def _route(m: float, fan: int):
    def route(queries: pa.Table, split: pa.Table) -> pa.Table:
        if not queries.num_rows or not split.num_rows:
            return queries.select([f.split()[0] for f in QUERY.split(", ")]).slice(0, 0)
        k = split.column("k")[0].as_py()
        points = _matrix(split.column("points")).reshape(k, -1)
        i, j, near, far = (np.array(split.column(c)[0].as_py()) for c in ("i", "j", "near", "far"))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)  # a sibling without rows meets nothing
        low[i, j], high[i, j] = near, far
        vectors = _matrix(queries.column("vector"))
        norms2 = (vectors * vectors).sum(axis=1)
        r1, r2 = (radius(norms2, m, np.array(queries.column(c).to_pylist(), np.float64)) for c in ("high", "low"))
        with np.errstate(invalid="ignore"):
            alive = survivors(distances(vectors, np.zeros(len(vectors)), points, _height(points, m)), low, high, r1, r2, SLACK * m)
        alive[:, np.isin(np.arange(k), j, invert=True)] = False
        at, child = np.nonzero(alive)
        held = queries.take(pa.array(at))
        node = pa.array(split.column("node")[0].as_py() * fan + 1 + child, pa.int64())
        return held.set_column(held.column_names.index("node"), "node", node).select([f.split()[0] for f in QUERY.split(", ")])
    return route


def _score(k: int):
    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and queries.num_rows:
            vectors, asked = _matrix(rows.column("vector")), _matrix(queries.column("vector"))
            if np.abs(vectors).max(initial=0) * np.abs(asked).max(initial=0) * max(1, vectors.shape[1]) >= 2.0 ** 52:  # doubles would round: whole numbers of any size
                vectors, asked = (np.array([[int(x) for x in row] for row in v], dtype=object).reshape(v.shape) for v in (vectors, asked))
            ids, labels = np.asarray(rows.column("vec_id")), np.asarray(rows.column("label"))
            q, anchor, label, same, low, high = (queries.column(c).to_pylist() for c in ("q", "anchor_id", "label", "same", "low", "high"))
            for at in range(0, len(q), SLICE):
                scores = asked[at:at + SLICE] @ vectors.T if vectors.shape[1] else np.zeros((len(q[at:at + SLICE]), len(ids)))
                for n, s in enumerate(scores, at):
                    if s.dtype == object:
                        s = np.array([max(LEAST, min(MOST, int(x))) for x in s], object)
                    fits = np.flatnonzero((ids != anchor[n]) & ((labels == label[n]) == same[n]) & (s >= low[n]) & (s <= high[n]))
                    s, i = s[fits], ids[fits]
                    if len(s) > 4 * k and s.dtype != object:
                        most = np.partition(s, len(s) - k)[len(s) - k]
                        s, i = s[s >= most], i[s >= most]
                    for x in np.lexsort((i, -s))[:k]:
                        found.append((q[n], int(i[x]), int(s[x])))
        return pa.table({n: pa.array([f[c] for f in found], pa.int64()) for c, n in enumerate(("q", "vec_id", "score"))})
    return score


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_leaves(tree: Tree, queries: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score, rank): the k best of each query among the rows of the leaves it is at."""
    blocks = stored(_parts(queries, QUERIES, "n_block").join(tree.parts, "node"))
    rows = _dealt(tree.rows, blocks, "part", "mark").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_block") - 1)))
    asked = _dealt(queries, blocks, "block", "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_part") - 1))).drop("n_part", "n_block")
    asked = asked.toDF(*asked.columns)  # anchors are rows of the tree: columns of their own
    found = (rows.select("node", "part", "block", "vec_id", "label", "vector").groupBy("node", "part", "block")
             .cogroup(asked.groupBy("node", "part", "block")).applyInArrow(_score(k), "q bigint, vec_id bigint, score bigint"))
    return _ranked(found, k)


def routed(tree: Tree, queries: DataFrame) -> DataFrame:
    """The queries at every leaf that may hold a row in their annulus; ``node`` of the given ones is not read."""
    at = queries.withColumn("node", F.lit(0).cast("bigint")).select(*[f.split()[0] for f in QUERY.split(", ")])
    for splits in tree.levels:
        blocks = _parts(at.join(splits.select("node"), "node", "left_semi"), QUERIES, "n_block")
        dealt = _dealt(at, blocks, "block", "q").drop("n_block")
        copies = splits.join(blocks, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_block") - 1))).drop("n_block")
        moved = dealt.groupBy("node", "block").cogroup(copies.groupBy("node", "block")).applyInArrow(_route(tree.m, tree.fan), QUERY)
        at = stored(moved.unionByName(at.join(splits.select("node"), "node", "left_anti")))
    return at


def search(tree: Tree, queries: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score, rank): for each query the k best rows in its window [low, high] of scores, of its label or of the others.

    queries: (q, anchor_id, label, vector, same, low, high, node); q names the query, node is the leaf to look at first.
    """
    if not tree.levels:
        return _in_leaves(tree, queries, k)
    queries = stored(queries)
    first = _in_leaves(tree, queries, k).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    narrowed = queries.join(first, "q", "left").withColumn("low", F.greatest("low", "least")).drop("least")  # null: no k rows yet
    return _in_leaves(tree, routed(tree, narrowed), k)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector, mark): rows that take part, once each, components as floor(256 x), vectors filled up to one length."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("vector")))
    large = F.lit(float(1 << 52))  # beyond, every double is a whole number
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < large / 256, F.floor(x * 256).cast("double")).otherwise(x * 256))
    return rows.withColumn("vector", whole)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, k_positive: int = K, k_negative: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over (vec_id, label, vector).

    is_anchor picks the anchors; ``label`` replaces the label, if given.
    """
    rows = usable(vectors)
    if label is not None:
        rows = rows.withColumn("label", label.cast("int"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    missing = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))
    rows = rows.withColumn("vector", F.concat("vector", missing)).distinct()
    rows = stored(rows.withColumn("mark", F.xxhash64("vec_id", "label", "vector")))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    m = float(rows.agg(F.max(F.sqrt(norm2))).first()[0] or 0)
    tree = build(rows, m)

    anchors = stored(tree.rows.where(is_anchor).select(F.col("mark").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector", "node"))
    bounds = {"same": F.lit(True), "low": F.lit(LEAST).cast("bigint"), "high": F.lit(MOST).cast("bigint")}
    names = [f.split()[0] for f in QUERY.split(", ")]
    positives = stored(search(tree, anchors.withColumnRenamed("anchor", "q").withColumns(bounds).select(*names), k_positive)
                    .select(F.col("q").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("at")))

    p = F.col("positive_score")
    floor_fifth = F.expr("positive_score div 5") - F.when((p < 0) & (p % 5 != 0), F.lit(1)).otherwise(F.lit(0))
    pairs = positives.join(anchors, "anchor").withColumns({"q": F.xxhash64("anchor", "at"), "same": F.lit(False), "low": p - floor_fifth, "high": p})
    pairs = stored(pairs.where("low <= high"))  # 80 p <= 100 n <= 100 p: n from p - floor(p / 5) to p
    found = search(tree, pairs.select(*names), k_negative)
    return (found.join(pairs.select("q", "anchor_id", "positive_id", "positive_score"), "q")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
