"""Session settings and the shared scratch location.

Cluster rule: intermediate tables and checkpoints go to the shared folder
named by ``spark.checkpoint.dir``.  We only set our own folder when the
session has none (local tests), never a machine-local path on a cluster.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this package wants.  AQE re-plans joins and
# coalesces small shuffle partitions at runtime; skew-join splitting handles a
# customer/dialog that holds a large share of the rows.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streamed sessions of a hot user are merged in each task before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpointed scan chunks are removed once their DataFrame is gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "dialogscope",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the shuffle
    partition count should then be sized to ~128-256 MB per partition of the
    largest shuffle (AQE coalesces downwards from it).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    Uses the checkpoint folder the cluster names (``spark.checkpoint.dir``).
    Where none is set, a session with a local master gets a fresh folder under the
    system temp dir, registered as the checkpoint dir; any other session is
    refused, since executors could not see a machine-local folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session: no SparkContext here
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder: the master is {master!r}, not local")
        current = tempfile.mkdtemp(prefix="dialogscope-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(current)
        else:
            spark.conf.set("spark.checkpoint.dir", current)
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-path of the shared scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this package wrote, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def default_parallelism(spark: SparkSession) -> int:
    """Partition count for explicit repartitions (range chunking etc.)."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover - conf always present in practice
        return max(1, os.cpu_count() or 1)
