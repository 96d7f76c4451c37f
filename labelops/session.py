"""Session helpers: a tuned local session for tests/bench, checkpoint-dir lookup, package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "labelops") -> SparkSession:
    """Local session for tests and the bench; on a cluster pass the cluster's own session instead.

    Only this local session names a checkpoint folder of its own (a scratch folder), since driver
    and executors share one machine here.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not _configured_dir(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labelops-ckpt-"))
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
            or sc.getConf().get("spark.checkpoint.dir", None))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names in ``spark.checkpoint.dir``.

    Where none is set: a local master gets a scratch folder (driver and executors are one process
    there); a cluster raises, because a machine-local folder is invisible to its other nodes.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = _configured_dir(spark)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="labelops-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables next to the checkpoint data (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/labelops-{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions run in their
    Python workers can import it whatever the working folder or PYTHONPATH there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="labelops-zip-"), "labelops.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
