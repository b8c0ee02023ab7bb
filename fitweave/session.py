"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture costs several JVM calls per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # html and long texts are wide rows: keep Arrow batches small in bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


SPREAD = "spark.fitweave.spreadTasks"
TASK_ROWS = 2_000  # rows whose work is a millisecond or more each
_SHIPPED: set[str] = set()


def build_session(app: str = "fitweave", master: str | None = None, **extra) -> SparkSession:
    """Session with the engine's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint directory.

    Only a local session without that setting may fall back to a temporary
    folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = os.path.join(tempfile.gettempdir(), "fitweave-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Reliable checkpoints go to the cluster's shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(base or scratch_path(spark, "checkpoints"))


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared scratch folder and reads it back.

    Unlike a cache it survives lost executors, and later readers load only the columns they
    need.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """Repartitions a frame into the number of tasks that ``SPREAD`` names; as it is if that is unset.

    For sessions that read single small files, whose one row group would be one task.  A cluster leaves
    the setting alone: its scans have many splits.
    """
    tasks = frame.sparkSession.conf.get(SPREAD, None)
    return frame.repartition(int(tasks)) if tasks else frame


def spread_rows(frame: DataFrame, counted: DataFrame) -> DataFrame:
    """Deals the rows of a frame over tasks of about ``TASK_ROWS`` rows, before costly work per row.

    ``counted`` is a scanned table with as many rows, whose count comes from file footers.  Narrow tables come in few
    files or row groups, so without this all work on millions of rows is one task.  ``SPREAD`` wins if it is set.
    """
    if frame.sparkSession.conf.get(SPREAD, None):
        return spread(frame)
    tasks = -(-counted.count() // TASK_ROWS)
    return frame.repartition(tasks) if tasks > 1 else frame


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, so that Python workers find it wherever the driver was started."""
    home = Path(__file__).resolve().parent
    marker = f"{home.name}-{spark.sparkContext.applicationId}.zip"
    if marker in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp()) / marker  # read by the driver's file server alone
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(home.rglob("*.py")):
            target.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(marker)
