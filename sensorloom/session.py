"""Session settings the jobs rely on, and the shared folder for written state."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Folders made for local sessions that name none.
_LOCAL_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing is left to the cluster."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; a
    cluster must name one, since a machine-local folder would not survive the
    loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="sensorloom-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/sensorloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label: str):
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Only functions that run in Python inside tasks need it. Spark hands the
    archive from the driver to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_sensorloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    stem = os.path.join(tempfile.mkdtemp(prefix="sensorloom-"), "sensorloom_package")
    archive = shutil.make_archive(stem, "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(archive)
    context._sensorloom_shipped = True
