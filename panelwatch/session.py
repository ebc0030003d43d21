"""Session helper for tests, the bench and local use, and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "panelwatch", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PANELWATCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster without the
    setting is refused, because a machine-local path would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        folder = tempfile.mkdtemp(prefix="panelwatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_FOLDERS[application] = folder
    return _LOCAL_FOLDERS[application]


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, inside the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/panelwatch-{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    Results are plans that read such tables, so call this once they are stored elsewhere; an
    application that stores its results can call it after each run. What other applications
    keep in the shared folder stays.
    """
    system, where = _file_system(spark, run_folder(spark))
    system.delete(where, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs scan the same intermediate (model fits, iterations): the
    table survives the loss of any executor and cuts the lineage. The folders of all such
    tables are in ``run_folder``; ``discard`` removes one, ``remove_scratch`` all of them.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    folder = shared_dir(spark).rstrip("/") + "/"
    for file in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if file.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and cached rows that no plan or fit refers to any more.

    It does so once the driver's garbage is collected, which the many passes of a fit seldom cause.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def storage_memory(spark: SparkSession) -> int:
    """Bytes that all executors together have for cached rows."""
    found = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    return sum(executor.totalOnHeapStorageMemory() for executor in found)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a folder in any store that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def root_depth(spark: SparkSession, folder: str) -> int:
    """Components of a folder's full path, as Spark's file sources report paths below it."""
    system, where = _file_system(spark, folder)
    return len(system.makeQualified(where).toString().split("/"))


def complete_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables below a folder whose writing was committed, in order."""
    system, where = _file_system(spark, folder)
    if not system.exists(where):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    children = [s.getPath() for s in system.listStatus(where) if s.isDirectory()]
    return sorted(c.getName() for c in children if system.exists(path(c, "_SUCCESS")))
