"""Connected components of an edge table by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, own_exchange


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung under the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    low = both.groupBy(F.col("a").alias("at"), own_exchange("a")).agg(F.min("b").alias("m")).select("at", F.least("at", "m").alias("m"))
    return both.join(low, both.a == low.at).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are hung under the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(F.col("a").alias("at"), own_exchange("a")).agg(F.min("b").alias("m"))
    hung = down.join(low, down.a == low.at).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(low.select(F.col("at").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the bigint edges (a, b): root is the smallest node it can reach.

    Nodes are found only through edges, so a node without any is its own root and
    not listed.  Each round is written to the shared checkpoint folder; the number
    of rounds is about the logarithm of the longest chain.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _state(edges)
    while now[0] and now != before:
        edges = cut(_small_star(_large_star(edges)))
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
