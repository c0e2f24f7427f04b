"""Log of backtest runs: one row per parameter and per metric."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.sources.tables import Tables

RUNS = "runs"


def run_rows(
    spark: SparkSession,
    metrics: DataFrame,
    params: dict[str, object],
    experiment: str,
    run_id: str | None = None,
    started_at: datetime | None = None,
) -> DataFrame:
    """Log rows of one run from its metrics (name, quantile, value) and its parameters."""
    run_id = run_id or uuid.uuid4().hex
    started_at = started_at or datetime.now(timezone.utc)
    listed = spark.createDataFrame(
        [(k, str(v)) for k, v in params.items()], "name string, param string"
    ).select(
        F.lit("param").alias("kind"),
        "name",
        F.lit(None).cast("double").alias("quantile"),
        "param",
        F.lit(None).alias("metric"),
    )
    measured = metrics.select(
        F.lit("metric").alias("kind"), "name", "quantile", F.lit(None).alias("param"), "value"
    )
    return schemas.conform(
        listed.unionAll(measured).select(
            F.lit(run_id).alias("run_id"),
            F.lit(experiment).alias("experiment"),
            F.lit(started_at).cast("timestamp").alias("started_at"),
            "*",
        ),
        schemas.RUN_LOG,
    )


def log_run(tables: Tables, rows: DataFrame) -> None:
    tables.append(RUNS, rows.coalesce(1))


def runs(tables: Tables) -> DataFrame | None:
    return tables.read(RUNS, schemas.RUN_LOG)


def latest_run(log: DataFrame, experiment: str) -> DataFrame:
    """Log rows of the experiment's most recently started run; empty if it has none."""
    mine = log.where(F.col("experiment") == experiment)
    newest = mine.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return mine.where(F.col("run_id") == newest.scalar())


def run_metrics(run: DataFrame) -> DataFrame:
    """Metrics (name, quantile, value) of one run's log rows."""
    return run.where("kind = 'metric'").select("name", "quantile", F.col("metric").alias("value"))


def run_identity(run: DataFrame) -> DataFrame:
    """run_id, started_at of one run's log rows; no row without a run."""
    return run.select("run_id", "started_at").distinct()
