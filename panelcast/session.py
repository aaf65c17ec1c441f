"""Session helpers (S9). Accepts an existing session; never hard-codes a master."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # remove checkpoint files once their DataFrames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app_name: str = "panelcast", master: str | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one with AQE on and the UI off."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python (as ``--py-files`` would), once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="panelcast-py-"), "panelcast.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is static: the deployment (or a test's session builder) names a
    folder every executor can reach. Without one this fails, for any master.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not current:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder on storage shared by "
                           "all executors when the session is built")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never ``localCheckpoint``) so lost executors are
    recovered from the shared folder instead of recomputing the whole plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def staged(df: DataFrame, name: str = "staged", partitions: int | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: what reads it several
    times (fits, quantile passes, windows) neither repeats the work before it nor pins executor
    memory, and a lost executor re-reads files. ``partitions`` deals the rows to as many files."""
    path = scratch_path(df.sparkSession, name)
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (unique per call, so
    concurrent jobs never write into each other's output)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
