"""Session construction and the shared folder for tables written between steps."""

from __future__ import annotations

import contextvars
import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# For rows with binary columns, which may be large: how few make a group of rows and a page of a file.
# Readers hold a group at a time, as many bytes as its values take unpacked.
LARGE_ROWS = {
    "parquet.block.row.count.limit": "16",
    "parquet.page.row.count.limit": "4",
    "parquet.page.size.row.check.min": "4",
    "parquet.enable.dictionary": "false",
    "parquet.column.statistics.enabled": "false",
}

_job_folders: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar(
    "job_folders", default=None
)


def local_session(
    cores: int | str = "*", app: str = "stockloom", checkpoints: str | None = None
) -> SparkSession:
    """A session for tests and the benchmark; cluster jobs bring their own."""
    cpus = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", checkpoints or tempfile.mkdtemp(prefix="stockloom-"))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.debug.maxToStringFields", "200")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stockloom-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/stockloom/{label}-{uuid.uuid4().hex}"
    if (folders := _job_folders.get()) is not None:
        folders.append((spark, path))
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleans_up(job: Callable) -> Callable:
    """Remove the folders that a job took by :func:`fresh_folder` when it ends, also by an error.

    For functions whose result no longer reads those folders.
    """

    @functools.wraps(job)
    def run(*args, **kwargs):
        token = _job_folders.set([])
        try:
            return job(*args, **kwargs)
        finally:
            folders = _job_folders.get()
            _job_folders.reset(token)
            for spark, path in folders:
                delete_folder(spark, path)

    return run


def write_files(df: DataFrame, path: str) -> None:
    """Write Parquet files that are read in little memory, whatever the size of a row or of a file."""
    large = any(isinstance(f.dataType, T.BinaryType) for f in df.schema)
    df.write.options(**(LARGE_ROWS if large else {})).parquet(path)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the files.

    Used where one frame feeds several jobs: the upstream work runs once, and a lost executor
    costs a re-read rather than a recomputation of the whole lineage.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    write_files(df, path)
    return spark.read.schema(df.schema).parquet(path)
