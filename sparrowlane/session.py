"""What a session needs to run this package's Python functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_ARROW_BYTES, OWN_ARROW_BYTES = 64 << 20, 4 << 20


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by ``sys.path`` alone.

    Arrow batches are also held to 4 MB where the session has Spark's default of 64 MB: rows with long texts would
    otherwise fill a worker several times over.
    """
    if spark.conf.get(ARROW_BYTES, f"{DEFAULT_ARROW_BYTES}b").rstrip("b") == str(DEFAULT_ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, f"{OWN_ARROW_BYTES}b")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset.

    A folder of this machine stands in for it in local mode alone: executors on other machines could not read it.
    """
    workers_can_import(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sparrowlane-")
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/sparrowlane-{name}-{uuid.uuid4().hex}"


def file_count(df: DataFrame) -> int:
    """Files enough for the tables that ``df`` reads: one for each part of a scan of them (32 MB at most), four for each core at least."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    part = max(1, min(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes(), 32 << 20))
    return max(4 * spark.sparkContext.defaultParallelism, min(size // part, 1 << 22))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe from the loss of executors.

    Many small partitions go to fewer files, without a shuffle: a file costs a store far more than a task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.coalesce(file_count(df)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove everything that this package has left in the shared folder; call it when no frame read from there is in use."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(conf)
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("sparrowlane-"):
            fs.delete(status.getPath(), True)


def open_fs(path: str):
    """A pyarrow file system and the path in it, for files that tasks of this package write into the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
