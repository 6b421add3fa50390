"""Spark session settings for the analytics library.

The library never assumes local mode.  Everything that matters at cluster
scale is a configuration here (AQE, skew-join splitting, size-checked
broadcast) or a property of the DataFrame plans in ``operators``.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings applied by ``build_session``.  Broadcast stays size-checked: Spark
# only broadcasts a join side whose estimated (static) or measured (AQE) size
# is below the threshold and falls back to a sort-merge join beyond it.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "salespark",
                  shuffle_partitions: int | None = None,
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # remote sessions have no SparkContext
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; unset, it is an error.  Only on a local master (tests) a fresh scratch
    folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the server's configuration applies
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="salespark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 128 * 1024 ** 2) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run over ``input_bytes`` of parquet.

    * scans: 256 MB splits (a task's decoded batch stays well inside an
      executor core's share of memory);
    * shuffles: an initial partition count that gives ~``target`` bytes per
      partition for a shuffle as large as the (compressed) input, at least
      three waves of tasks, at most 200 000; AQE then coalesces small
      partitions to the advisory size and splits skewed ones;
    * broadcast: only sides below 32 MB, checked statically or at runtime.
    """
    slots = max(1, executors * cores_per_executor)
    by_size = -(-int(input_bytes) // target_partition_bytes)
    partitions = int(min(200_000, max(3 * slots, by_size)))
    return {
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(
            4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": "32m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    }


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor, once per
    application.  The whole package goes along: workers find one package of its name only."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import salespark

    top = Path(next(iter(salespark.__path__)))
    path = Path(tempfile.mkdtemp(prefix="salespark-")) / "salespark-whole.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, Path(top.name) / file.relative_to(top))
    spark.sparkContext.addPyFile(str(path))  # the file goes to the executors from the driver
    _SHIPPED.add(app)
