"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without it gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Names and removes the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a scan of the files: its work runs once, its lineage ends."""
        self._count += 1
        path = f"{self.path}/{self._count}"
        df.write.parquet(path)
        # Spark deletes the shuffle files of this write once the driver collects garbage; done now,
        # they don't add up over an operator's steps.
        self._spark.sparkContext._jvm.System.gc()
        stored = self._spark.read.schema(df.schema).parquet(path)
        stored._scratch_path = path
        return stored

    def store_by(self, df: DataFrame, key: str) -> DataFrame:
        """The same, hash-bucketed and sorted by a column: joins on it don't shuffle these rows."""
        self._count += 1
        path, name = f"{self.path}/{self._count}", f"scratch_{uuid.uuid4().hex}"
        buckets = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        (
            df.repartition(buckets, key)
            .sortWithinPartitions(key)
            .write.bucketBy(buckets, key)
            .sortBy(key)
            .option("path", path)
            .saveAsTable(name)
        )
        stored = self._spark.table(name)
        stored._scratch_path = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that no later step reads."""
        for table in tables:
            self.delete(table._scratch_path)

    def delete(self, path: str) -> None:
        """Delete a folder below the shared one."""
        hadoop = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(hadoop, True)
