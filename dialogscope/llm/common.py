"""Helpers the operators of this subpackage share."""

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.config import scratch_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(array: pa.Array, step: int = 256):
    """The values of an Arrow string array, a few at a time as Python objects."""
    for at in range(0, len(array), step):
        yield from array.slice(at, step).to_pylist()


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents no model learns from (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder.

    Unlike a checkpoint, which keeps the estimates of the plan it cuts (they multiply from join to join where one
    is cut again and again), a written table has the size of its files, by which joins choose what to broadcast.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> int:
    """How many partitions an explicit repartition makes: the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def own_exchange(*keys: str) -> Column:
    """A further grouping column that changes no group.

    An aggregate by k that is joined by k lends the join its partitioning, and then adaptive execution can't split
    a hot key's partition.  Grouped by k and this column, the few rows of the aggregate are dealt
    out once more, both sides of the join have exchanges of their own, and a hot key is split.
    """
    return F.xxhash64(*keys).alias("_own")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_name(folder: str) -> str:
    """A folder's name for Arrow: Hadoop's s3a and s3n are s3, dbfs is mounted under /dbfs."""
    scheme, _, rest = folder.partition(":")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return folder


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The Arrow file system of a folder, and the folder's path there.

    S3 and GCS need credentials that Arrow finds itself (environment or instance role), HDFS needs libhdfs on every node.
    """
    return pyarrow.fs.FileSystem.from_uri(arrow_name(folder))
