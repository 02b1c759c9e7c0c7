"""Spark session defaults for the member-risk jobs.

Cluster runs inherit whatever the submitter configured; only unset keys get
a default here. ``spark.checkpoint.dir`` is read from the session and a
local scratch folder is used only when nothing was configured (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


# The JVM does not compile methods of more than 8000 bytes of byte code: a stage whose generated
# method is larger (wide rows, long chains of columns) is interpreted row by row unless Spark is
# told to run its operators one by one.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "memberrisk") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MEMBERRISK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply session-level settings that are safe to set at runtime."""
    conf = spark.conf
    if conf.get("spark.sql.session.timeZone", None) != "UTC":
        conf.set("spark.sql.session.timeZone", "UTC")
    if conf.get(METHOD_LIMIT[0], None) is None:
        conf.set(*METHOD_LIMIT)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package (as ``--py-files`` does), once an
    application, so that it need not be installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="memberrisk-py-"), "memberrisk.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only in local mode, where driver and executors are one process, a fresh
    scratch folder is made when the session names none. On a cluster that is
    an error: each executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="memberrisk-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def write_table(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    return the table: one job, a plan leaf with real size statistics (AQE
    and broadcast decisions see the true size), and a lost executor never
    replays the lineage behind it."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)
