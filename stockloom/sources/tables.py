"""Named Parquet tables under one folder.

A table that is replaced as a whole gets a new folder for each version. A manifest row, written
last, makes the version the current one: a write that dies leaves the old version in place, and
readers that have planned on it can finish. The version before the current one is kept, older ones
are deleted. Tables that only grow are folders that are appended to.

A version can be clustered: hash-bucketed and sorted by key columns, one file per bucket. The manifest
keeps keys and number of buckets, and readers get a scan that Spark knows to be dealt out by them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.session import delete_folder

VERSIONS = "table_versions"
_VERSION_SCHEMA = "name string, number int, folder string, keys array<string>, buckets int"


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _definition(folder: str) -> str:
    """The name of the session's definition of a clustered version."""
    return f"clustered_{folder.rsplit('/', 1)[-1]}"


@dataclass(frozen=True)
class Tables:
    """Tables of one project. Writers are expected to take turns."""

    spark: SparkSession
    root: str

    def _versions(self, name: str) -> list:
        """Number and folder of the table's versions, newest first; one row for each rewrite."""
        rows = self._scan(f"{self.root}/{VERSIONS}", _VERSION_SCHEMA)
        if rows is None:
            return []
        return rows.where(F.col("name") == name).orderBy(F.desc("number")).collect()

    def _scan(self, path: str, schema: T.StructType | str | None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(path)
        except AnalysisException as error:
            if any(c in str(error) for c in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                return None
            raise

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """A scan of the table's current version, or None if it was never written."""
        versions = self._versions(name)
        if versions and versions[0].buckets:
            return self._clustered(versions[0])
        return self._scan(f"{self.root}/{versions[0].folder if versions else name}", schema)

    def _clustered(self, version) -> DataFrame:
        """A scan by a table definition of this session, which knows the buckets."""
        path, table = f"{self.root}/{version.folder}", _definition(version.folder)
        if not self.spark.catalog.tableExists(table):
            schema = self.spark.read.parquet(path).schema
            columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
            keys = ", ".join(map(_quoted, version.keys))
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                f"INTO {version.buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(table)

    def require(self, name: str) -> DataFrame:
        table = self.read(name)
        if table is None:
            raise LookupError(f"table {name!r} not found under {self.root}")
        return table

    def replace(
        self, name: str, df: DataFrame, cluster_by: Sequence[str] = (), buckets: int | None = None
    ) -> DataFrame:
        """Write the table anew, make that its current version and return a scan of it.

        With ``cluster_by``, rows are dealt out by these columns once, into ``buckets``, by default as
        many as the session has shuffle partitions; windows and joins by them need no shuffle
        afterwards. Rows that are already dealt out by them to as many tasks stay where they are.
        """
        versions = self._versions(name)
        folder = f"{name}/{uuid.uuid4().hex}"
        path = f"{self.root}/{folder}"
        if not cluster_by:
            buckets = None
        elif buckets is None:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if buckets:
            # The writer sorts by bucket and key itself.
            dealt = df.repartition(buckets, *cluster_by)
            writer = dealt.write.bucketBy(buckets, *cluster_by).sortBy(*cluster_by)
            # Rows that come from a table of the same buckets are not dealt out again; its scan has to
            # keep the buckets apart then, or every task would write a file for each of them.
            setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
            usual = self.spark.conf.get(setting)
            self.spark.conf.set(setting, "false")
            try:
                writer.option("path", path).saveAsTable(_definition(folder))
            finally:
                self.spark.conf.set(setting, usual)
        else:
            df.write.parquet(path)
        number = versions[0].number + 1 if versions else 1
        entry = self.spark.createDataFrame(
            [(name, number, folder, list(cluster_by) or None, buckets)], _VERSION_SCHEMA
        )
        self.append(VERSIONS, entry.coalesce(1))
        for old in versions[1:]:
            self.spark.sql(f"DROP TABLE IF EXISTS {_definition(old.folder)}")
            delete_folder(self.spark, f"{self.root}/{old.folder}")
        return self.spark.table(_definition(folder)) if buckets else self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")
