"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC wall clock (timestamps are instants
# written in UTC), ANSI arithmetic, and AQE so that shuffle partition counts and
# join strategies are re-planned from runtime statistics.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int) -> dict:
    """Settings for a large cluster scanning ~100 TB.

    Input splits and shuffle partitions target ~256 MB so each task's working
    set fits executor memory (sorts and aggregates spill beyond it rather than
    fail); AQE coalesces small shuffle partitions and splits skewed ones;
    broadcasts stay bounded by the threshold (and by the library's own checks);
    the RocksDB state store keeps large streaming de-duplication state off-heap;
    speculation and retries absorb slow or lost executors.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.speculation": "true",
        "spark.task.maxFailures": "8",
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sitewatt", extra: dict | None = None,
                total_cores: int | None = None) -> SparkSession:
    """Return a session with the library's base settings.

    On a cluster ``master`` stays ``None`` (taken from spark-submit); pass
    ``total_cores`` to apply ``cluster_conf``. Local runs pass a master and a
    shuffle partition count matched to the cores.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if total_cores:
        conf.update(cluster_conf(total_cores))
    for k, v in conf.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (shared storage). Only when it is unset, as in
    local tests, a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors and a restarted "
                               "driver must see checkpoints and derived tables")
        d = tempfile.mkdtemp(prefix="sitewatt-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():  # DataFrame.checkpoint() writes under the context's folder
        sc.setCheckpointDir(d)
    return d
