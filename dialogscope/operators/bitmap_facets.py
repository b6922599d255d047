"""Facet counts that follow the other filters (F-6/F-7), from a bitmap index.

The index has one row per (facet, value, bucket of 32,768 rows): a bitmap of the rows that hold the value.  Row numbers are dense inside
each partition, so buckets are full, and a partial aggregate makes the bitmaps where the rows are.  The index of a
table with v facet values takes v bits a row before Parquet's compression, whatever else the table holds.

``facet_counts`` answers any choice of filters from the index alone: for every value of facet f the rows with that value under all
active filters but f's own.  The chosen values of a facet are ORed, the facets ANDed per bucket, and the result ANDed with every
value's bitmap and counted.  The table is not read again.

Null facet values are in no bitmap.  A value that no row holds under the other filters is listed with 0.  The row with the empty facet
counts the rows kept by all filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import scratch_dir
from ..functions.columns import as_text
from .filters import require

KEPT = ""


def write_index(df: DataFrame, facets: Sequence[str], path: str) -> None:
    """Build the index of ``df`` and write it, one folder per facet."""
    require(df, *facets)
    scratch_dir(df.sparkSession)
    # The row numbers are pinned: a task that is run again must not number its rows anew.
    rows = df.select(*[as_text(c).alias(c) for c in facets]).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    pairs = F.array(F.struct(F.lit(KEPT).alias("facet"), F.lit(KEPT).alias("value")),
                    *[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in facets])
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("bits")
    (rows.select("_row", F.inline(pairs)).where("value is not null")
     .groupBy("facet", "value", F.bitmap_bucket_number("_row").alias("bucket")).agg(bits)
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _allowed(index: DataFrame, active: Mapping[str, Sequence[str]]) -> DataFrame:
    """(target, bucket, allowed): the rows that pass all filters but the target's own; target ``KEPT``: all filters."""
    chosen = F.lit(False)
    for facet, values in active.items():
        chosen = chosen | ((F.col("facet") == facet) & F.col("value").isin(*values))
    one = index.where(chosen).groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    targets = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(len(active) - (t != KEPT)).alias("needed")) for t in [KEPT, *active]])
    spread = one.select("facet", "bucket", "bits", F.inline(targets)).where("facet <> target")
    # A filter without a row in the bucket allows none of it.
    met = spread.groupBy("target", "needed", "bucket").agg(F.bitmap_and_agg("bits").alias("allowed"), F.count(F.lit(1)).alias("n"))
    return met.where("n = needed").select("target", "bucket", "allowed")


def facet_counts(index: DataFrame, active: Mapping[str, Sequence]) -> DataFrame:
    """(facet, value, n_dialogs) of every value under all active filters but its own facet's.

    ``active``: facet -> chosen values (any of them); no values chosen: no filter.
    """
    active = {f: [str(v) for v in values] for f, values in active.items() if len(values)}
    own = F.bitmap_count("bits")
    if not active:
        return index.groupBy("facet", "value").agg(F.sum(own).alias("n_dialogs"))
    target = F.when(F.col("facet").isin(*active), F.col("facet")).otherwise(F.lit(KEPT))
    free = F.lit(len(active) == 1) & (F.col("facet") == F.lit(next(iter(active))))  # no filter but its own
    allowed = _allowed(index, active)
    met = index.withColumn("target", target).join(allowed, ["target", "bucket"])
    both = (met.select("facet", "value", "bucket", F.explode(F.array("bits", "allowed")).alias("bits"))
            .groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits")))
    counted = both.where(~free).select("facet", "value", own.alias("n"))
    counted = counted.unionByName(index.where(free).select("facet", "value", own.alias("n")))
    zero = index.select("facet", "value", F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(zero).groupBy("facet", "value").agg(F.sum("n").alias("n_dialogs"))
