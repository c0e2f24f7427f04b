"""Registered queries: each builds its result from the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions import newsvendor
from stockloom.functions.quantiles import quantile_column, rearrange_quantiles
from stockloom.operators import (
    backtest,
    decisions,
    features,
    horizon,
    ingest,
    inventory,
    quality,
    reports,
    split,
    summaries,
)
from stockloom.operators.boosting import BoostedQuantiles
from stockloom.operators.forest import ForestQuantiles, assembled_features, score_by_tables
from stockloom.operators.seasonal import SeasonalQuantiles
from stockloom.plans import jobs
from stockloom.session import fresh_folder, write_and_read
from stockloom.settings import Aggregate, CostSpec, FeatureSpec, ForecastSpec, ReplaySpec
from stockloom.sources import order_lines, raw_csv, run_log, snapshots
from stockloom.sources.order_lines import OrderLinePanel
from stockloom.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Floating results are rounded before comparison: sums depend on the order of their terms. Large
# totals have fewer sure digits; cents times a ratio of two digits never end halfway at the fourth.
DIGITS = 6
MONEY_DIGITS = 4
MONEY_TOTALS = (
    "revenue",
    "total_cost",
    "total_understock_cost",
    "total_overstock_cost",
    "baseline_cost",
    "ml_cost",
    "savings",
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        [
            F.round(f.name, MONEY_DIGITS if f.name in MONEY_TOTALS else DIGITS).alias(f.name)
            if f.dataType == T.DoubleType()
            else f.name
            for f in df.schema
        ]
    )


SPEC, FORECAST, COSTS, REPLAY = FeatureSpec(), ForecastSpec(), CostSpec(), ReplaySpec()
LEVELS = FORECAST.trained_quantiles(COSTS)
LEAD = REPLAY.lead_time_days
EMBARGO = 2350  # days; most of the panel's length


class Star(OrderLinePanel):
    """The star schema over the panel, each table built on first use."""

    @cached_property
    def stores(self) -> DataFrame:
        return ingest.stores(self.raw_series)

    @cached_property
    def skus(self) -> DataFrame:
        return ingest.skus(self.raw_series)

    @cached_property
    def calendar(self) -> DataFrame:
        return ingest.calendar(self.raw_calendar)

    @cached_property
    def prices(self) -> DataFrame:
        return ingest.prices(self.raw_prices)

    @cached_property
    def long_cells(self) -> DataFrame:
        """store_id, sku_id, d, units_sold by unpivoting the week-wide cells."""
        cells = ingest.unpivot_days(self.raw_week_cells, ["store_id", "item_id", "wm_yr_wk"])
        slot = F.substring("d", 3, 1).cast("int")
        day = order_lines.day_in_week(F.col("wm_yr_wk"), 1) + slot - 1
        return cells.select(
            "store_id",
            F.col("item_id").alias("sku_id"),
            F.concat(F.lit("d_"), day.cast("string")).alias("d"),
            "units_sold",
        )

    def history(self, spec: FeatureSpec) -> DataFrame:
        return features.history_features(self.daily_sales, spec)

    @cached_property
    def sku_master(self) -> DataFrame:
        """All items. Joined to sales it gives what ``skus`` gives."""
        return self.raw_items.withColumnRenamed("item_id", "sku_id")

    def store(self, sales: DataFrame | None = None) -> DataFrame:
        return features.feature_store(
            self.daily_sales if sales is None else sales,
            self.sku_master,
            self.store_master,
            self.calendar,
            SPEC,
        )

    @cached_property
    def dimensions(self) -> features.Dimensions:
        return features.Dimensions(self.sku_master, self.store_master, self.calendar)

    def assembled_from(self, with_features: bool) -> tuple[DataFrame, features.Dimensions | None]:
        """What horizons are assembled from: all features, or for forecasters that look at none of
        them the sales alone."""
        return (self.history(SPEC), self.dimensions) if with_features else (self.daily_sales, None)


@query
def stores(spark, sf):
    return Star(spark, sf).stores


@query
def skus(spark, sf):
    return Star(spark, sf).skus


@query
def calendar_dim(spark, sf):
    return Star(spark, sf).calendar


@query
def prices(spark, sf):
    return Star(spark, sf).prices


@query
def unpivot_sales(spark, sf):
    return Star(spark, sf).long_cells


@query
def sales_fact(spark, sf):
    """Unpivot, then the calendar and price joins."""
    tables = Star(spark, sf)
    return ingest.sales(tables.long_cells, tables.calendar, tables.prices)


@query
def sales_panel(spark, sf):
    """The same fact without the joins."""
    return Star(spark, sf).daily_sales


@query
def ingest_stats(spark, sf):
    tables = Star(spark, sf)
    return ingest.ingest_statistics(
        tables.stores, tables.skus, tables.calendar, tables.long_cells, tables.daily_sales
    )


@query
def table_counts(spark, sf):
    tables = Star(spark, sf)
    return summaries.row_counts(
        {
            "stores": tables.stores,
            "skus": tables.skus,
            "calendar": tables.calendar,
            "prices": tables.prices,
            "sales": tables.daily_sales,
        }
    )


@query
def quality_checks(spark, sf):
    tables = Star(spark, sf)
    return quality.quality_checks(
        tables.stores, tables.skus, tables.calendar, tables.prices, tables.daily_sales
    )


@query
def quality_checks_damaged(spark, sf):
    """The checks on tables with every kind of damage: repeated, negative, free and unpriced sales,
    an unknown store, item and day, a hole in the calendar and repeated prices."""
    tables = Star(spark, sf)
    sales = tables.daily_sales
    monday = F.dayofweek("date") == 2
    sunday = sales.where(F.dayofweek("date") == 1)
    bad = (
        sales.withColumn("units_sold", F.when(monday, -F.col("units_sold")).otherwise(F.col("units_sold")))
        .unionAll(sunday)
        .unionAll(sunday.withColumn("store_id", F.concat("store_id", F.lit("?"))))
        .unionAll(sunday.withColumn("sku_id", F.lit("NONE")).withColumn("sell_price", F.lit(0.0)))
        .unionAll(sunday.withColumn("date", F.add_months("date", 1200)).withColumn("sell_price", F.lit(None)))
    )
    prices = tables.prices.unionAll(tables.prices.where("wm_yr_wk % 3 = 0"))
    calendar = tables.calendar.where("month != 6 OR is_weekend")
    return quality.quality_checks(tables.stores, tables.skus, calendar, prices, bad)


@query
def sales_summary(spark, sf):
    tables = Star(spark, sf)
    return rounded(summaries.sales_summary(tables.daily_sales, tables.sku_master, tables.store_master))


@query
def series_coverage(spark, sf):
    return summaries.series_coverage(Star(spark, sf).daily_sales)


@query
def duplicate_keys(spark, sf):
    """Duplicate detection, on a key that has duplicates: order lines of one store, item and day."""
    lines = Star(spark, sf).lines.select(
        "store_id", F.col("item_id").alias("sku_id"), F.col("day").alias("date")
    )
    return summaries.duplicate_keys(lines, summaries.SALES_KEY)


@query
def orphan_rows(spark, sf):
    """Anti join on a reference that often misses: labels belong to documents, not all have one."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("key"))
    return summaries.orphans(documents, labels, "key")


@query
def feature_store(spark, sf):
    return rounded(Star(spark, sf).store())


@query
def feature_store_from_view(spark, sf):
    """The left-join form of the feature store."""
    tables = Star(spark, sf)
    return rounded(
        features.feature_store_from_view(
            tables.daily_sales,
            tables.history(SPEC),
            tables.sku_master,
            tables.store_master,
            tables.calendar,
        )
    )


@query
def lag_features(spark, sf):
    spec = FeatureSpec(lags=(1, 2, 7, 14, 28, 364))
    return Star(spark, sf).history(spec).select(*spec.group_columns, spec.date_column, *spec.lag_names)


@query
def rolling_features(spark, sf):
    """All five aggregates."""
    spec = FeatureSpec(aggregations=("mean", "std", "min", "max", "sum"))
    frame = Star(spark, sf).history(spec)
    return rounded(frame.select(*spec.group_columns, spec.date_column, *spec.rolling_names))


@query
def rolling_features_in_blocks(spark, sf):
    """The same with blocks far shorter than the series."""
    spec = FeatureSpec(aggregations=("mean", "std", "min", "max", "sum"))
    tables = Star(spark, sf)
    frame = features.history_features(tables.daily_sales, spec, block_days=365, partitions=tables.partitions)
    return rounded(frame.select(*spec.group_columns, spec.date_column, *spec.rolling_names))


@query
def custom_aggregates(spark, sf):
    """Rolling aggregates of one's own beside a named one: share of days without demand, spread, and
    the mean with a row's weight growing towards the current day."""

    def weighted(units, frame):
        """Of the frame's values in order the n-th counts n-fold."""
        seen = F.collect_list(units).over(frame)
        total = F.aggregate(
            F.zip_with(seen, F.sequence(F.lit(1), F.size(seen)), lambda u, n: u * n), F.lit(0), lambda a, b: a + b
        )
        n = F.count(units).over(frame)
        return F.when(n > 0, total * 2 / (n * (n + 1)))

    spec = FeatureSpec(
        lags=(1,),
        windows=(7, 28),
        aggregations=(
            "mean",
            Aggregate("idle_share", lambda units, frame: F.avg((units == 0).cast("int")).over(frame)),
            Aggregate("spread", lambda units, frame: F.max(units).over(frame) - F.min(units).over(frame)),
            Aggregate("recent_mean", weighted),
        ),
    )
    frame = Star(spark, sf).history(spec)
    return rounded(frame.select(*spec.group_columns, spec.date_column, *spec.rolling_names))


def lead_time(spark: SparkSession, sf: str, with_features: bool = True) -> DataFrame:
    """The lead-time dataset."""
    store, dimensions = Star(spark, sf).assembled_from(with_features)
    return horizon.assemble_horizon(store, SPEC, LEAD, 1, dimensions)


def multi_horizon(spark: SparkSession, sf: str, with_features: bool = True) -> DataFrame:
    """All horizons from origins sampled at the stride."""
    store, dimensions = Star(spark, sf).assembled_from(with_features)
    return horizon.assemble_horizons(
        store, SPEC, FORECAST.horizon_days, FORECAST.origin_stride_days, dimensions
    )


def lead_time_rows(spark: SparkSession, sf: str, forecaster=SeasonalQuantiles) -> DataFrame:
    """The columns that the forecaster needs, stored: several jobs read them."""
    return write_and_read(lead_time(spark, sf, forecaster.uses_features), "lead-time")


def multi_horizon_rows(spark: SparkSession, sf: str, forecaster=SeasonalQuantiles) -> DataFrame:
    return write_and_read(multi_horizon(spark, sf, forecaster.uses_features), "multi-horizon")


def bounds_of(dataset: DataFrame) -> split.Bounds:
    return split.chronological_bounds(
        dataset, FORECAST.test_size_days, FORECAST.validation_size_days
    )


@query
def series_history(spark, sf):
    rows = lead_time_rows(spark, sf)
    known = inventory.series_history(rows.where(~bounds_of(rows).is_test))
    return known.select(
        "store_id", "sku_id", F.array_join(F.col("demand").cast("array<string>"), ",").alias("days")
    )


@query
def origin_stride(spark, sf):
    """Sales on the sampled origin days."""
    return Star(spark, sf).daily_sales.where(
        horizon.on_cadence("date", FORECAST.origin_stride_days)
    )


@query
def lead_time_dataset(spark, sf):
    return rounded(lead_time(spark, sf))


@query
def horizon_dataset(spark, sf):
    """Horizons 1..28 from origins sampled every 7 days, all features.

    The store is rounded, not its copies: every row of it is an origin or a target many times.
    """
    store, dimensions = Star(spark, sf).assembled_from(True)
    return horizon.assemble_horizons(
        rounded(store), SPEC, FORECAST.horizon_days, FORECAST.origin_stride_days, dimensions
    )


@query
def origin_dates(spark, sf):
    return split.origin_dates(lead_time(spark, sf, False)).orderBy("origin_date")


@query
def split_counts(spark, sf):
    rows = multi_horizon_rows(spark, sf)
    return backtest.split_counts(rows, bounds_of(rows))


@query
def two_way_split(spark, sf):
    rows = lead_time_rows(spark, sf)
    bounds = split.two_way_bounds(rows, FORECAST.validation_size_days)
    return backtest.split_counts(rows, bounds).where("split != 'test'")


@query
def seasonal_quantiles(spark, sf):
    rows = lead_time_rows(spark, sf)
    model = SeasonalQuantiles(LEVELS).fit(rows.where(bounds_of(rows).is_train))
    return rounded(model.table())


@query
def seasonal_predictions(spark, sf):
    rows = lead_time_rows(spark, sf)
    scored = backtest.predict_test(rows, bounds_of(rows), LEVELS, SeasonalQuantiles)
    keys = ("store_id", "sku_id", "origin_date", "target_date", "target")
    return rounded(scored.select(*keys, *map(quantile_column, LEVELS)))


@query
def monotone_rearrange(spark, sf):
    """Three values per row that do cross: demand 1, 7 and 14 days ago."""
    lags = Star(spark, sf).history(SPEC)
    names = {0.1: "units_sold_lag_1", 0.5: "units_sold_lag_7", 0.9: "units_sold_lag_14"}
    raw = lags.select(
        "store_id",
        "sku_id",
        "date",
        *[F.coalesce(F.col(c), F.lit(0)).alias(quantile_column(q)) for q, c in names.items()],
    )
    return rearrange_quantiles(raw, list(names))


@query
def backtest_metrics(spark, sf):
    rows = multi_horizon_rows(spark, sf)
    return rounded(backtest.backtest_metrics(rows, bounds_of(rows), LEVELS, SeasonalQuantiles))


@query
def quantile_accuracy(spark, sf):
    rows = multi_horizon_rows(spark, sf)
    scored = backtest.predict_test(rows, bounds_of(rows), LEVELS, SeasonalQuantiles)
    return rounded(backtest.quantile_accuracy(backtest.accuracy(scored, LEVELS)))


@query
def run_metrics(spark, sf):
    """Two logged runs; the metrics of the later one with its id and start, by its start time."""
    rows = multi_horizon_rows(spark, sf)
    tables = Tables(spark, fresh_folder(spark, "runs"))
    first = backtest.split_counts(rows, bounds_of(rows)).select(
        F.col("split").alias("name"),
        F.lit(None).cast("double").alias("quantile"),
        F.col("n_rows").cast("double").alias("value"),
    )
    days = [datetime(2024, 5, 2, tzinfo=timezone.utc), datetime(2024, 5, 1, tzinfo=timezone.utc)]
    scored = backtest.predict_test(rows, bounds_of(rows), LEVELS, SeasonalQuantiles)
    metrics = backtest.accuracy(scored, LEVELS)
    params = {"horizon_days": FORECAST.horizon_days, "quantiles": LEVELS}
    run_log.log_run(tables, run_log.run_rows(spark, metrics, params, "forecast", "b", days[0]))
    run_log.log_run(tables, run_log.run_rows(spark, first, {"step": "split"}, "forecast", "a", days[1]))
    latest = run_log.latest_run(run_log.runs(tables), "forecast")
    named = run_log.run_metrics(latest).join(run_log.run_identity(latest))
    return rounded(named.withColumn("started_at", F.to_date("started_at")))


@query
def forest_quantiles(spark, sf):
    """The global model on all features, stated by what holds whatever the trees look like.

    Every test row is scored once; its levels do not decrease, lie between the least and the
    largest outcome of training, and equal what joins with the exported trees make of its features.
    """
    rows = lead_time_rows(spark, sf, ForestQuantiles)
    bounds = bounds_of(rows)
    train, test = rows.where(bounds.is_train), rows.where(bounds.is_test)
    maker = ForestQuantiles(LEVELS)
    model = maker.fit(train, rows.where(bounds.is_validation))
    key = ["store_id", "sku_id", "origin_date"]
    features_of = assembled_features(test, SPEC, model.means).select(*key, vector_to_array("_features").alias("x"))
    by_tables = score_by_tables(features_of, key, *model.tables(), max(maker.depths))
    scored = model.predict(test).join(by_tables, key, "left")
    names = [F.col(quantile_column(q)) for q in LEVELS]
    low, high = (train.agg(f("target").cast("double")).scalar() for f in (F.min, F.max))
    ordered = F.lit(True)
    for a, b in zip(names, names[1:], strict=False):
        ordered &= a <= b
    same = F.lit(True)
    for i, name in enumerate(names):
        same &= F.abs(name - F.get("levels", F.lit(i))) < 1e-9
    return scored.select(
        *key,
        "target_date",
        "target",
        ordered.alias("ordered"),
        ((names[0] >= low) & (names[-1] <= high)).alias("within_outcomes"),
        F.coalesce(same, F.lit(False)).alias("as_by_tables"),
    )


@query
def boosted_quantiles(spark, sf):
    """One boosted model per level on all features, on the same split as the seasonal quantiles.

    The losses of the seasonal quantiles and of the training quantile alone, where boosting starts
    from, have SQL; of the boosted ones it is stated that no level does worse than its start.
    """
    rows = lead_time_rows(spark, sf, BoostedQuantiles)
    bounds = bounds_of(rows)
    parts = [rows.where(own) for own in (bounds.is_train, bounds.is_validation, bounds.is_test)]
    model = BoostedQuantiles(LEVELS, rounds=8, patience=2).fit(*parts[:2])
    constant = parts[2].select(
        "target", *[F.lit(level.base).alias(quantile_column(level.quantile)) for level in model.levels]
    )
    scored = {
        "boosted": model.predict(parts[2]),
        "seasonal": SeasonalQuantiles(LEVELS).fit(parts[0]).predict(parts[2]),
        "constant": constant,
    }
    losses = None
    for name, predicted in scored.items():
        own = backtest.quantile_accuracy(backtest.accuracy(predicted, LEVELS))
        own = own.select("quantile", F.col("pinball").alias(name))
        losses = own if losses is None else losses.join(own, "quantile")
    n_rows = parts[2].agg(F.count("*")).scalar()
    return rounded(
        losses.select(
            "quantile",
            n_rows.alias("n_rows"),
            F.col("seasonal").alias("seasonal_pinball"),
            F.col("constant").alias("constant_pinball"),
            (F.col("boosted") <= F.col("constant") + 1e-12).alias("boosted_no_worse_than_constant"),
        )
    )


@query
def report_cost_assumptions(spark, sf):
    """The section of the report: ratios and what follows from them, with the sales they apply to."""
    sales = Star(spark, sf).daily_sales
    covered = sales.agg(F.sum(F.col("units_sold") * F.col("sell_price")).alias("revenue"))
    return rounded(reports.cost_assumptions(spark, COSTS).join(covered))


@query
def cost_assumptions(spark, sf):
    """The economics in currency, at each category's mean price."""
    tables = Star(spark, sf)
    price = F.col("mean_price")
    understock = newsvendor.understock_ratio(
        F.lit(COSTS.unit_cost_ratio), F.lit(COSTS.stockout_penalty_ratio)
    )
    overstock = newsvendor.overstock_ratio(
        F.lit(COSTS.unit_cost_ratio), F.lit(COSTS.salvage_ratio), F.lit(COSTS.holding_cost_ratio)
    )
    by_category = (
        tables.prices.join(tables.sku_master, "sku_id")
        .groupBy("cat_id")
        .agg(F.avg("sell_price").alias("mean_price"))
    )
    return rounded(
        by_category.select(
            "cat_id",
            "mean_price",
            (price * understock).alias("understock_cost"),
            (price * overstock).alias("overstock_cost"),
            newsvendor.critical_fractile(price * understock, price * overstock).alias(
                "critical_fractile"
            ),
        )
    )


def baseline(spark: SparkSession, sf: str, distribution: str) -> DataFrame:
    rows = lead_time_rows(spark, sf)
    known = rows.where(~bounds_of(rows).is_test)
    return rounded(
        inventory.order_up_to(known, distribution, REPLAY.window_days, REPLAY.service_level)
    )


@query
def baseline_normal(spark, sf):
    return baseline(spark, sf, "normal")


@query
def baseline_poisson(spark, sf):
    return baseline(spark, sf, "poisson")


@query
def baseline_bootstrap(spark, sf):
    return baseline(spark, sf, "empirical")


def recommended(spark: SparkSession, sf: str) -> DataFrame:
    rows = decisions.recommend(
        lead_time_rows(spark, sf), LEAD, COSTS, FORECAST, SeasonalQuantiles
    )
    return rows.withColumn("snapshot_table", F.lit("feature_store_v1"))


def replayed(spark: SparkSession, sf: str, spec: ReplaySpec = REPLAY) -> DataFrame:
    rows = lead_time_rows(spark, sf)
    return decisions.replay(rows, spec, COSTS, FORECAST, SeasonalQuantiles)


@query
def recommendations(spark, sf):
    return rounded(recommended(spark, sf))


def two_snapshots(tables: Tables, star: Star) -> None:
    """The feature store and a copy of it; both are dealt out as the panel is."""
    snapshots.build_snapshot(tables, star.store(), SPEC, "first", star.partitions)
    again = snapshots.read_snapshot(tables)
    snapshots.build_snapshot(tables, again, SPEC, "second", star.partitions)


def project_with_snapshots(spark: SparkSession, sf: str) -> Tables:
    """Two snapshots of the feature store of the panel."""
    tables = Tables(spark, fresh_folder(spark, "project"))
    two_snapshots(tables, Star(spark, sf))
    return tables


@query
def stored_recommendations(spark, sf):
    """The job run twice on a named snapshot; the second run replaces the first."""
    tables = project_with_snapshots(spark, sf)
    for forecast in (replace(FORECAST, validation_size_days=7), FORECAST):
        jobs.recommend(
            tables, LEAD, forecast=forecast, snapshot="feature_store_v1", forecaster=SeasonalQuantiles
        )
    return rounded(tables.require(jobs.RECOMMENDATIONS))


@query
def stored_replay(spark, sf):
    """The same for the replay, on the newest snapshot."""
    tables = project_with_snapshots(spark, sf)
    for spec in (ReplaySpec(demand_distribution="poisson"), ReplaySpec(demand_distribution="normal")):
        jobs.simulate(tables, spec, forecaster=SeasonalQuantiles)
    return rounded(tables.require(jobs.RESULTS))


@query
def snapshot_by_name(spark, sf):
    """Lineage of an older snapshot and the rows it holds."""
    tables = project_with_snapshots(spark, sf)
    name = snapshots.snapshot_name(tables, "feature_store_v1")
    listed = snapshots.snapshot_lineage(tables, name).drop("created_at")
    rows = snapshots.read_snapshot(tables, name).agg(F.count("*").alias("stored_rows"))
    return listed.join(rows)


@query
def skipped_decisions(spark, sf):
    """An embargo so long that series launched late have no history left."""
    rows = lead_time_rows(spark, sf)
    return decisions.skipped_decisions(rows, ReplaySpec(embargo_days=EMBARGO), FORECAST)


@query
def recommendation_summary(spark, sf):
    return rounded(reports.recommendation_summary(recommended(spark, sf)))


@query
def top_misses(spark, sf):
    return rounded(reports.top_misses(recommended(spark, sf)))


@query
def policy_replay(spark, sf):
    return rounded(replayed(spark, sf))


@query
def policy_replay_normal(spark, sf):
    """Weekly reviews against the normal baseline."""
    return rounded(replayed(spark, sf, ReplaySpec(demand_distribution="normal", review_period_days=7)))


@query
def policy_replay_poisson(spark, sf):
    """Poisson baseline over one day, fitted on outcomes known before the first decision."""
    spec = ReplaySpec(demand_distribution="poisson", baseline_window_days=1, embargo_days=LEAD - 1)
    return rounded(replayed(spark, sf, spec))


@query
def policy_summary(spark, sf):
    return rounded(reports.policy_summary(replayed(spark, sf)))


@query
def policy_savings(spark, sf):
    return rounded(reports.policy_savings(replayed(spark, sf)))


@query
def kpi_tiles(spark, sf):
    rows = lead_time_rows(spark, sf)
    scored = backtest.predict_test(rows, bounds_of(rows), LEVELS, SeasonalQuantiles)
    advice = decisions.recommend(rows, LEAD, COSTS, FORECAST, SeasonalQuantiles)
    results = decisions.replay(rows, REPLAY, COSTS, FORECAST, SeasonalQuantiles)
    return rounded(
        reports.kpi_tiles(
            spark,
            advice.withColumn("snapshot_table", F.lit("feature_store_v1")),
            results,
            backtest.accuracy(scored, LEVELS),
        )
    )


@query
def snapshot_lineage(spark, sf):
    """Two snapshots of the panel; the manifest of the later one."""
    tables = Tables(spark, fresh_folder(spark, "snapshots"))
    two_snapshots(tables, Star(spark, sf))
    return snapshots.snapshot_lineage(tables).drop("created_at")


def land_raw_files(spark: SparkSession, sf: str, raw_dir: str) -> None:
    """The panel as raw files: one wide row per series with a column for every calendar day."""
    panel = Star(spark, sf)
    calendar = panel.raw_calendar
    calendar.write.option("header", True).csv(f"{raw_dir}/{raw_csv.CALENDAR}")
    grid = write_and_read(panel.grid, "grid")
    prices = grid.select("store_id", "item_id", "wm_yr_wk", "sell_price")
    prices.where("sell_price IS NOT NULL").write.option("header", True).csv(
        f"{raw_dir}/{raw_csv.PRICES}"
    )
    weeks = F.sort_array(
        F.collect_list(F.struct("wm_yr_wk", F.array(*[f"d_{i}" for i in range(1, 8)]).alias("u")))
    )
    # One array of daily units per series: as long as the calendar, like the raw file's rows.
    rows = grid.groupBy("store_id", "item_id").agg(
        F.filter(F.flatten(F.transform(weeks, lambda w: w["u"])), lambda u: u.isNotNull()).alias(
            "units"
        )
    )
    days = [r.d for r in calendar.orderBy("date").select("d").collect()]
    wide = rows.join(panel.raw_series, ["store_id", "item_id"]).selectExpr(
        "concat_ws('_', item_id, store_id, 'evaluation') AS id",
        "item_id",
        "dept_id",
        "cat_id",
        "store_id",
        "state_id",
        *[f"units[{i}] AS {day}" for i, day in enumerate(days)],
    )
    wide.write.option("header", True).csv(f"{raw_dir}/{raw_csv.SALES}")


@query
def ingest_csv(spark, sf):
    """Raw files to star schema, twice: the second run replaces the first."""
    raw_dir = fresh_folder(spark, "raw")
    land_raw_files(spark, sf, raw_dir)
    tables = Tables(spark, fresh_folder(spark, "star"))
    jobs.ingest_raw(tables, raw_dir)
    jobs.ingest_raw(tables, raw_dir)
    return tables.require("sales")
