"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: anything
that must be materialised (lineage cuts, snapshot tables) goes under the
shared folder named by ``spark.checkpoint.dir``. Only when that setting is
absent on a ``local`` master (tests) do we fall back to a fresh ``/tmp``
folder; on a cluster the setting is required.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings the engine relies on. ANSI stays on (Spark 4 default); the
# operators use try_* functions wherever the reference coerces silently.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Splits of a table that is small for the cluster; plans do not depend on the size of the input.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "recurra") -> SparkSession:
    """Build (or reuse) a session with the engine's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RECURRA_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Stored input per shuffle partition (some 170,000 fact rows), and the most that partitions are put together to.
SHARE_BYTES = 4 << 20
ADVISORY_BYTES = 16 << 20


def fit_shuffles(spark: SparkSession, n_bytes: int) -> int:
    """Raise the number of shuffle partitions to what an input of ``n_bytes`` needs; return the number that holds.

    With a fixed number a task's share, and with it the memory and the spills of its sorts and hash tables, grows
    with the input. A larger number that is set stays; AQE puts small partitions together, up to a size that is
    held here too.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARE_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(advisory)) > ADVISORY_BYTES:
        spark.conf.set(advisory, str(ADVISORY_BYTES))
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="recurra-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a written table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def materialize(spark: SparkSession, df, name: str, compression: str | None = None):
    """Write ``df`` as parquet under the shared folder and read it back.

    Used for intermediates that several consumers read (the customer
    history): lineage is cut, a lost executor does not force recomputation
    from the raw facts, and readers still get column pruning and file-size
    statistics for AQE. Never a machine-local folder on a cluster. ``compression``
    is that of the files, if not the session's.
    """
    import uuid
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").options(**({"compression": compression} if compression else {})).parquet(path)
    return spark.read.parquet(path)
