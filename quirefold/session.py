"""Session helpers: a local session for tests and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-node use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quirefold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once an application.

    Workers that have it on their path anyway are not harmed by a second copy.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quirefold-code-")) / "quirefold.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine's own temporary
    folder would be lost with the machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    folder = tempfile.mkdtemp(prefix="quirefold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python process ends."""
    path = f"{shared_folder(spark)}/quirefold-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of that table.

    Later plans read the files, so a lost executor costs no recomputation. The
    files go when the driver's Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` to be broadcast if it was counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _located(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop knows them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fetch_file(spark: SparkSession, folder: str, target: str) -> None:
    """The one part file of a written folder, wherever that is, as a file on the driver's machine."""
    where, files = _located(spark, f"{folder}/part-*")
    (part,) = files.globStatus(where)
    local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{Path(target).resolve()}")
    files.copyToLocalFile(False, part.getPath(), local, True)


def publish_file(spark: SparkSession, source: str, name: str) -> str:
    """A file of the driver's machine, copied to where all executors can read it."""
    path = scratch(spark, name)
    where, files = _located(spark, path)
    files.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{Path(source).resolve()}"), where)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where, files = _located(spark, path)
    files.delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session is gone; the folder's owner clears it
        pass
