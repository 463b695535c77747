"""Session defaults for local runs. On a cluster the caller's own session and its settings are used as they are."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "staylens") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.driver.memory", os.environ.get("STAYLENS_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.gettempdir() + "/staylens-warehouse")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python tasks import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="staylens-"), "staylens"), "zip", root, "staylens")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it; a local one only where the session has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="staylens-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def materialise(df):
    """Cut the lineage of an intermediate result that several branches read: stored in the shared checkpoint folder, so
    it outlives a lost executor and is not computed again per branch."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """As `materialise`, for the rounds of a loop: a table in the shared checkpoint folder, read back. A checkpoint keeps the planner's size
    estimate, and joins multiply estimates, so that after some rounds planning takes longer than the work; a table has its real size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, rows: int, each: int):
    """The rows of a frame dealt evenly to tasks of about `each` of some `rows` rows: where a row of few bytes is much work, the number of tasks
    must follow the rows, neither the splits of a file nor the size of a shuffle."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))
