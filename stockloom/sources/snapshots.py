"""Versioned feature-store snapshots with a lineage manifest.

Data is written first and its manifest row last. Readers trust only the manifest, so a build
that dies in between leaves an unlisted folder which the next build of that version replaces.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.settings import FeatureSpec
from stockloom.sources.tables import Tables

MANIFEST = "feature_snapshots"
PREFIX = "feature_store_v"


class SnapshotError(LookupError):
    """No such snapshot."""


def manifest(tables: Tables) -> DataFrame:
    stored = tables.read(MANIFEST, schemas.FEATURE_SNAPSHOTS)
    if stored is None:
        return tables.spark.createDataFrame([], schemas.FEATURE_SNAPSHOTS)
    return stored


def snapshot_statistics(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(
        F.count("*").alias("row_count"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def build_snapshot(
    tables: Tables,
    store: DataFrame,
    spec: FeatureSpec,
    git_commit: str | None = None,
    buckets: int | None = None,
) -> Row:
    """Freeze ``store`` as the next version, clustered by series, and list it. Returns the manifest
    row.

    A store already dealt out by series to as many tasks as ``buckets`` is written without a shuffle.

    A build always makes a new version, also when nothing changed.
    """
    version = manifest(tables).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    name = f"{PREFIX}{version}"
    written = tables.replace(name, store, spec.group_columns, buckets)
    statistics = snapshot_statistics(written).first()
    entry = (
        version,
        name,
        datetime.now(timezone.utc),
        git_commit,
        spec.fingerprint(),
        statistics.row_count,
        statistics.min_date,
        statistics.max_date,
    )
    row = tables.spark.createDataFrame([entry], schemas.FEATURE_SNAPSHOTS)
    tables.append(MANIFEST, row.coalesce(1))
    return row.first()


def latest_snapshot(tables: Tables) -> DataFrame:
    """The newest manifest row, as a frame of at most one row."""
    return manifest(tables).orderBy(F.desc("version")).limit(1)


def snapshot_lineage(tables: Tables, table_name: str | None = None) -> DataFrame:
    """Manifest row of the named snapshot, or of the newest; empty if there is none."""
    rows = (
        latest_snapshot(tables)
        if table_name is None
        else manifest(tables).where(F.col("table_name") == table_name)
    )
    return rows.drop("config_hash")


def snapshot_name(tables: Tables, table_name: str | None = None) -> str:
    found = snapshot_lineage(tables, table_name).first()
    if found is None:
        wanted = "no feature snapshots found" if table_name is None else f"no snapshot {table_name}"
        raise SnapshotError(f"{wanted}; build features first")
    return found.table_name


def read_snapshot(tables: Tables, table_name: str | None = None) -> DataFrame:
    return tables.require(snapshot_name(tables, table_name))
