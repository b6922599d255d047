"""Operator 9: exact top-k inner products with MaxScore over shards.

A vector's components are quantised to floor(256 x).  The query's terms are its components; a term's score bounds in a shard are the
query component times the shard's largest and smallest value there.  Vectors are dealt over shards of bounded size by their largest component and its
sign (a position in their cell's range, by hash), so a shard's bounds are narrower than the table's where the vectors allow it.

1. Every query searches the shard it lies in.  Its k-th best score there is the threshold it starts with everywhere else, and
   each shard's bounds are returned with the results.
2. A (query, shard) pair whose bounds add up to less than the query's threshold is dropped before any vector is shuffled.
3. The other pairs meet in tasks of one shard and one block of queries (queries of neighbouring shards); a shard is only sent to the blocks that still need it.

Inside a task:

* a shard is walked in pieces, small ones first; the threshold is the k-th best score so far, or the one the query came with;
* terms are ordered by the spread of their bounds.  The terms with the smallest spreads, which together cannot lift a vector
  that gains nothing elsewhere to the threshold, are non-essential;
* essential terms are accumulated for every vector that is still competitive; the others are probed, a few at a time, only for the vectors whose
  sum plus an upper bound of what is left reaches the threshold.  That bound is the smaller of the remaining term bounds and the
  length of the query's remaining part times that of the vector's.

Nothing is estimated, so the result is exact; ties stay in until the end and go to the smaller vec_id.  Each shard returns at most k rows
per query, and these are merged by rank.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part.  A shorter vector
counts as filled up with zeros.  Repeated rows (same id, same vector) count once; different vectors under one id are
candidates of their own and, if that id is a query, queries of their own.  Scores beyond 64 bits become the nearest bigint.  An empty table gives an empty
result; further columns, whatever their names, are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, table

SHARD = 16_384
QUERIES = 2_048
PIECE = 4_096
FIRST = 64
PROBE = 4
LEAD = 0.15
K = 5
EXACT = 2.0 ** 52  # whole numbers below are exact in doubles, and so are their sums and bounds


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The quantised vectors as rows, filled up with zeros."""
    lists = column.combine_chunks()
    offsets = np.asarray(lists.offsets)
    sizes = np.diff(offsets)
    values = np.floor(256 * np.asarray(lists.values)[offsets[0]:offsets[-1]].astype(np.float64)) if len(lists) else np.empty(0)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def max_score(query: np.ndarray, skip: int, ids: np.ndarray, vectors: np.ndarray, high: np.ndarray, low: np.ndarray,
              k: int = K, counts: dict | None = None, start: float = -np.inf, lengths: np.ndarray | None = None,
              columns: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The k best (score, vec_id) among the rows of ``vectors`` without those of id ``skip``; rows below ``start`` may be left out.

    high, low: the largest and smallest value of each component; lengths: the squared lengths of the vectors, where they are
    exact; columns: the vectors by component (the terms' postings).  ``counts`` gathers how many components were read.
    """
    most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(least - most, kind="stable")  # widest spread first
    order = order[(most - least)[order] > 0]
    fixed = most.sum() - most[order].sum()  # components that are the same in all vectors
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # upper bound of the terms from a place on
    spread = np.append(np.cumsum((most - least)[order][::-1])[::-1], 0)
    squares = np.append(np.cumsum((query[order] ** 2)[::-1])[::-1], 0)  # squared length of the query's terms from a place on
    floor = least.sum()
    if lengths is not None:
        lengths = lengths - (high[high == low] ** 2).sum()
    lead = PROBE  # nothing can be left out before most of the query's length is spent
    if lengths is not None:
        lead = max(PROBE, int(np.argmax(squares <= LEAD * squares[0])))
    columns = vectors.T if columns is None else columns
    best_score, best_id = np.empty(0), np.empty(0, np.int64)
    end = 0
    while end < len(ids):
        at, end = end, min(len(ids), end + min(PIECE, max(FIRST, end)))  # small pieces first: a threshold soon
        some = np.arange(at, end)
        threshold = max(start, best_score[-1]) if len(best_score) == k else start
        essential = int(np.argmax(floor + spread < threshold)) if (floor + spread < threshold).any() else len(order)
        left = None if lengths is None else lengths[some]
        score, read, place = np.full(len(some), fixed, dtype=vectors.dtype), 0, 0
        while place < len(order) and len(some):
            stop = place + (PROBE if place else lead)
            terms = order[place:min(stop, essential) if place < essential else stop]
            values = columns[np.ix_(terms, some)] if place else columns[:, at:end][terms]
            score, read, place = score + query[terms] @ values, read + values.size, place + len(terms)
            bound = score + rest[place]
            if left is not None:
                left = left - (values * values).sum(axis=0)
                bound = np.minimum(bound, score + np.sqrt(left * squares[place]) * (1 + 1e-9) + 1)
            alive = bound >= threshold
            if not alive.all():
                some, score, left = some[alive], score[alive], None if left is None else left[alive]
        alive = (score >= threshold) & (ids[some] != skip)
        best_score, best_id = np.append(best_score, score[alive]), np.append(best_id, ids[some[alive]])
        keep = np.lexsort((best_id, -best_score))[:k]
        best_score, best_id = best_score[keep], best_id[keep]
        if counts is not None:
            counts["read"] = counts.get("read", 0) + read
            counts["all"] = counts.get("all", 0) + query.size * (end - at)
    return [(_long(s), int(i)) for s, i in zip(best_score, best_id)]


def _long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _search(k: int, home: bool):
    """The task of one shard and some queries.  At ``home``, a row without a mark gives the shard's bounds."""
    def search(key: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        rows, box = [], []
        if shard.num_rows and (home or queries.num_rows):
            width = max(int(np.diff(np.asarray(t.column("vector").combine_chunks().offsets)).max(initial=0)) for t in (shard, queries))
            ids = np.asarray(shard.column("vec_id"))
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], _matrix(shard.column("vector"), width)[order]
            asked = _matrix(queries.column("vector"), width)
            starts = [-np.inf] * len(asked) if home else [-np.inf if x is None else x for x in queries.column("start").to_pylist()]
            largest, longest = np.abs(vectors).max(initial=0), np.abs(asked).max(initial=0)
            if home:
                box = [(key[0].as_py(), vectors.max(axis=0).tolist(), vectors.min(axis=0).tolist(), float(largest * max(1, width)))]
            lengths = (vectors * vectors).sum(axis=1) if max(largest, longest) ** 2 * max(1, width) < EXACT else None
            if largest * longest * max(1, width) >= EXACT:  # doubles would round: whole numbers of any size
                vectors, asked = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (vectors, asked))
            if width:
                high, low, columns = vectors.max(axis=0), vectors.min(axis=0), np.ascontiguousarray(vectors.T)
                for q, mark, vector, start in zip(queries.column("vec_id").to_pylist(), queries.column("mark").to_pylist(), asked, starts):
                    rows += [(q, mark, i, s) for s, i in max_score(vector, q, ids, vectors, high, low, k, None, start, lengths, columns)]
            else:
                for q, mark in zip(queries.column("vec_id").to_pylist(), queries.column("mark").to_pylist()):
                    rows += [(q, mark, int(i), 0) for i in np.sort(ids[ids != q])[:k]]
        found = {n: pa.array([r[c] for r in rows] + [None] * len(box), pa.int64()) for c, n in enumerate(("query_id", "mark", "vec_id", "score"))}
        if home:
            kinds = (("shard", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64())), ("largest", pa.float64()))
            found |= {n: pa.array([None] * len(rows) + [r[c] for r in box], t) for c, (n, t) in enumerate(kinds)}
        return pa.table(found)
    return search


def valid(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows with their shard: cells (largest component, its sign) one after another, each row at a place in its cell's range by hash."""
    sizes = F.transform("vector", lambda x: F.abs(x))
    place = F.array_position(sizes, F.array_max(sizes))
    cell = F.coalesce(F.when(F.get("vector", (place - 1).cast("int")) < 0, -place).otherwise(place), F.lit(0))
    rows = rows.withColumn("cell", cell)
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # two rows per component at most
    ranges = cells.select("cell", "n", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("offset"))
    met = rows.join(F.broadcast(ranges), "cell")
    return met.select("vec_id", "vector", "mark", F.floor((F.col("offset") + F.pmod("mark", F.col("n"))) / F.lit(SHARD)).cast("int").alias("shard"))


def _pairs(asked: DataFrame, bounds: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(shard, block, vec_id, mark, vector, start): each query with every other shard whose bounds reach its threshold."""
    whole = F.transform("vector", lambda x: F.when(F.abs(256 * x) < EXACT, F.floor(256 * F.when(F.abs(256 * x) < EXACT, x))).otherwise(256 * x).cast("double"))
    asked = asked.select(F.col("shard").alias("home"), (F.col("shard") * F.lit(blocks) / F.lit(shards)).cast("int").alias("block"), "vec_id", "mark", "vector", "start",
                         whole.alias("terms"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where(F.col("home") != F.col("shard"))
    met = asked.join(bounds, "shard")
    gain = lambda side, sign: F.aggregate(F.zip_with("terms", side, lambda q, x: F.when(q * sign > 0, F.coalesce(q * x, F.lit(0.0))).otherwise(F.lit(0.0))),
                                          F.lit(0.0), lambda a, x: a + x)
    longest = F.coalesce(F.array_max(F.transform("terms", lambda x: F.abs(x))), F.lit(0.0))
    unsure = F.col("start").isNull() | (F.col("largest") * longest * F.greatest(F.lit(1), F.size("terms")) >= EXACT)
    return met.where(unsure | (gain("high", 1) + gain("low", -1) >= F.col("start"))).select("shard", "block", "vec_id", "mark", "vector", "start")


def _again(df: DataFrame) -> DataFrame:
    """The same columns as new ones, so that a frame can meet one made from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _homes(held: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The queries' results in their own shards, and the shards' bounds."""
    kinds = "query_id bigint, mark bigint, vec_id bigint, score bigint, shard int, high array<double>, low array<double>, largest double"
    home = cut(held.groupBy("shard").cogroup(_again(held.where(is_query)).groupBy("shard")).applyInArrow(_search(k, True), kinds))
    return (home.where(F.col("mark").isNotNull()).select("query_id", "mark", "vec_id", "score"),
            home.where(F.col("mark").isNull()).select("shard", "high", "low", "largest"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, vector) that ``is_query`` picks, its k best other rows."""
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = cut(rows.where(F.col("vec_id").isNotNull() & valid(F.col("vector"))).distinct().withColumn("mark", F.xxhash64("vec_id", "vector")))
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("asked")).first()
    shards, blocks = max(1, -(-n["all"] // SHARD)), max(1, -(-n["asked"] // QUERIES))
    held = _dealt(rows)
    found, bounds = _homes(held, is_query, k)
    if shards > 1:
        least = F.when((F.count(F.lit(1)) == k) & (F.min("score") > -(1 << 63)), F.min("score"))
        starts = found.groupBy(F.col("query_id").alias("vec_id"), "mark").agg(least.alias("start"))
        pairs = cut(_pairs(held.where(is_query).join(starts, ["vec_id", "mark"], "left"), bounds, shards, blocks))
        sent = held.join(pairs.select("shard", "block").distinct(), "shard")
        found = found.unionByName(sent.groupBy("shard", "block").cogroup(_again(pairs).groupBy("shard", "block"))
                                  .applyInArrow(_search(k, False), "query_id bigint, mark bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
