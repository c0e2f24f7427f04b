"""The jobs from raw files to report, over the tables of one project folder.

Each job reads stored tables and writes its own, so a later job never repeats an earlier one's
work and a failed job can simply be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from stockloom.operators import backtest, decisions, features, horizon, ingest, quality, reports
from stockloom.operators import split as splits
from stockloom.operators.forest import ForestQuantiles
from stockloom.session import cleans_up, write_and_read
from stockloom.settings import CostSpec, FeatureSpec, ForecastSpec, ReplaySpec
from stockloom.sources import raw_csv, run_log, snapshots
from stockloom.sources.tables import Tables

RECOMMENDATIONS = "recommendations"
RESULTS = "simulation_results"
SKIPPED = "skipped_decisions"


def _kept(df: DataFrame) -> DataFrame:
    """A small result that no longer depends on a job's intermediate tables."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@cleans_up
def ingest_raw(tables: Tables, raw_dir: str) -> DataFrame:
    """Raw files to star schema, replacing earlier content. Fails if a check fails.

    Every file is parsed once: the wide sales file is landed as Parquet, its days as one array, from
    which the dimensions and the long rows are taken. Returns the ingest counts; the long rows are counted while the
    sales are written.
    """
    raw = raw_csv.read_raw(tables.spark, raw_dir)
    wide = write_and_read(ingest.packed_days(raw["sales"]), "wide-sales")
    stores = tables.replace("stores", ingest.stores(wide))
    skus = tables.replace("skus", ingest.skus(wide))
    calendar = tables.replace("calendar", ingest.calendar(raw["calendar"]))
    prices = tables.replace("prices", ingest.prices(raw["prices"]))
    seen = Observation("long rows")
    long = ingest.long_packed(wide, ingest.day_columns(raw["sales"])).observe(seen, F.count("*").alias("n"))
    sales = tables.replace("sales", ingest.sales(long, calendar, prices))
    quality.require_quality(quality.quality_checks(stores, skus, calendar, prices, sales))
    kept = sales.count()
    counts = (stores.count(), skus.count(), calendar.count(), kept, seen.get["n"] - kept)
    return tables.spark.createDataFrame(
        [counts],
        "stores long, skus long, calendar_days long, sales_rows long, dropped_rows long",
    )


@cleans_up
def build_features(
    tables: Tables, spec: FeatureSpec | None = None, git_commit: str | None = None
) -> Row:
    """Materialize the next feature-store version; returns its manifest row."""
    spec = spec or FeatureSpec()
    store = features.feature_store(
        tables.require("sales"),
        tables.require("skus"),
        tables.require("stores"),
        tables.require("calendar"),
        spec,
    )
    return snapshots.build_snapshot(tables, store, spec, git_commit)


@cleans_up
def train(
    tables: Tables,
    spec: FeatureSpec | None = None,
    forecast: ForecastSpec | None = None,
    costs: CostSpec | None = None,
    snapshot: str | None = None,
    forecaster: backtest.Forecaster = ForestQuantiles,
    experiment: str = "forecast",
) -> DataFrame:
    """Backtest on a snapshot and log the run; returns the flat metrics."""
    spec, forecast, costs = spec or FeatureSpec(), forecast or ForecastSpec(), costs or CostSpec()
    name = snapshots.snapshot_name(tables, snapshot)
    store = _needed(tables.require(name), spec, forecaster)
    dataset = write_and_read(
        horizon.assemble_horizons(store, spec, forecast.horizon_days, forecast.origin_stride_days),
        "train",
    )
    bounds = splits.chronological_bounds(
        dataset, forecast.test_size_days, forecast.validation_size_days
    )
    quantiles = forecast.trained_quantiles(costs)
    metrics = _kept(backtest.backtest_metrics(dataset, bounds, quantiles, forecaster))
    params = {
        "snapshot_table": name,
        "horizon_days": forecast.horizon_days,
        "origin_stride_days": forecast.origin_stride_days,
        "quantiles": quantiles,
    }
    run_log.log_run(tables, run_log.run_rows(tables.spark, metrics, params, experiment))
    return metrics


def _needed(store: DataFrame, spec: FeatureSpec, forecaster: backtest.Forecaster) -> DataFrame:
    """The feature store, or its sales columns alone if the forecaster looks at no features."""
    if forecaster([0.5]).uses_features:
        return store
    return store.select(*spec.group_columns, spec.date_column, spec.target, *spec.numeric_features)


def _lead_time_dataset(
    tables: Tables,
    spec: FeatureSpec,
    lead_time_days: int,
    snapshot: str,
    forecaster: backtest.Forecaster,
) -> DataFrame:
    store = _needed(tables.require(snapshot), spec, forecaster)
    return write_and_read(horizon.assemble_horizon(store, spec, lead_time_days), "lead-time")


@cleans_up
def recommend(
    tables: Tables,
    lead_time_days: int = 7,
    spec: FeatureSpec | None = None,
    forecast: ForecastSpec | None = None,
    costs: CostSpec | None = None,
    snapshot: str | None = None,
    forecaster: backtest.Forecaster = ForestQuantiles,
) -> DataFrame:
    """Write the recommendations table anew and return it."""
    spec, forecast, costs = spec or FeatureSpec(), forecast or ForecastSpec(), costs or CostSpec()
    name = snapshots.snapshot_name(tables, snapshot)
    dataset = _lead_time_dataset(tables, spec, lead_time_days, name, forecaster)
    rows = decisions.recommend(dataset, lead_time_days, costs, forecast, forecaster)
    return tables.replace(RECOMMENDATIONS, rows.withColumn("snapshot_table", F.lit(name)))


@cleans_up
def simulate(
    tables: Tables,
    replay_spec: ReplaySpec | None = None,
    spec: FeatureSpec | None = None,
    forecast: ForecastSpec | None = None,
    costs: CostSpec | None = None,
    snapshot: str | None = None,
    forecaster: backtest.Forecaster = ForestQuantiles,
) -> DataFrame:
    """Write the replay results table anew and return it; with it, as ``skipped_decisions``, the
    decisions that were left out for want of history."""
    spec, forecast, costs = spec or FeatureSpec(), forecast or ForecastSpec(), costs or CostSpec()
    replay_spec = replay_spec or ReplaySpec()
    name = snapshots.snapshot_name(tables, snapshot)
    dataset = _lead_time_dataset(tables, spec, replay_spec.lead_time_days, name, forecaster)
    rows = write_and_read(
        decisions.replay(dataset, replay_spec, costs, forecast, forecaster), "replay"
    )
    if rows.isEmpty():
        raise decisions.DecisionError("no reviewed rows had history to build a baseline from")
    tables.replace(SKIPPED, decisions.skipped_decisions(dataset, replay_spec, forecast))
    return tables.replace(RESULTS, rows.withColumn("snapshot_table", F.lit(name)))


def report(
    tables: Tables,
    costs: CostSpec | None = None,
    snapshot: str | None = None,
    experiment: str = "forecast",
) -> dict[str, DataFrame | None]:
    """The report sections. A section whose input was never produced is None."""
    costs = costs or CostSpec()
    log = run_log.runs(tables)
    recommendations = tables.read(RECOMMENDATIONS)
    results = tables.read(RESULTS)
    run = None if log is None else run_log.latest_run(log, experiment)
    metrics = None if run is None else run_log.run_metrics(run)
    known = recommendations is not None
    return {
        "snapshot": snapshots.snapshot_lineage(tables, snapshot),
        "forecast_run": None if run is None else run_log.run_identity(run),
        "forecast_metrics": metrics,
        "quantile_accuracy": (
            None if metrics is None else backtest.quantile_accuracy(metrics).orderBy("quantile")
        ),
        "recommendation_summary": (
            reports.recommendation_summary(recommendations) if known else None
        ),
        "top_misses": reports.top_misses(recommendations) if known else None,
        "policy_summary": None if results is None else reports.policy_summary(results),
        "policy_savings": None if results is None else reports.policy_savings(results),
        "skipped_decisions": tables.read(SKIPPED),
        "cost_assumptions": reports.cost_assumptions(tables.spark, costs),
        "kpi_tiles": reports.kpi_tiles(tables.spark, recommendations, results, metrics),
    }
