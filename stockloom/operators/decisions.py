"""Order recommendations and the replay of stocking policies over past decision days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import newsvendor
from stockloom.functions.quantiles import quantile_column
from stockloom.operators import split
from stockloom.operators.backtest import Forecaster
from stockloom.operators.horizon import on_cadence
from stockloom.operators.inventory import SERIES, order_up_to
from stockloom.settings import CostSpec, ForecastSpec, ReplaySpec

# The policy names of the result table.
ML_POLICY = "ml_quantile"
BASELINE_POLICY = "classical_baseline"
_EPOCH = date(1970, 1, 1)


class DecisionError(ValueError):
    """The data leaves nothing to recommend or replay."""


def recommend(
    dataset: DataFrame,
    lead_time_days: int,
    costs: CostSpec,
    forecast: ForecastSpec,
    forecaster: Forecaster,
) -> DataFrame:
    """Order quantities for every series at the latest origin whose outcome is known.

    ``dataset`` is assembled at the lead time with stride 1. The forecaster learns from earlier
    origins only.
    """
    latest = split.latest_origins(dataset, forecast.validation_size_days + 2)
    if not latest:
        raise DecisionError(f"no rows available at lead_time_days={lead_time_days}")
    current, *earlier = latest
    bounds = split.bounds_from(earlier, 0, forecast.validation_size_days)
    past = F.col("origin_date") < F.lit(current)
    fractile = costs.critical_fractile
    levels = sorted({0.5, fractile})
    fitted = forecaster(levels).fit(
        dataset.where(bounds.is_train), dataset.where(past & bounds.is_validation)
    )
    scored = fitted.predict(dataset.where(F.col("origin_date") == F.lit(current)))
    quantity, median = F.col(quantile_column(fractile)), F.col(quantile_column(0.5))
    return scored.select(
        *SERIES,
        "origin_date",
        "target_date",
        F.lit(lead_time_days).alias("lead_time_days"),
        quantity.alias("order_quantity"),
        median.alias("median_forecast"),
        newsvendor.safety_stock(quantity, median).alias("safety_stock"),
        F.lit(fractile).alias("critical_fractile"),
        F.lit(costs.understock_ratio).alias("understock_cost_ratio"),
        F.lit(costs.overstock_ratio).alias("overstock_cost_ratio"),
        F.col("target").cast("double").alias("actual_demand"),
    )


def _graded(policy: str, quantity: Column, costs: CostSpec) -> Column:
    demand, price = F.col("actual_demand"), F.col("sell_price")
    under = newsvendor.understock_cost(quantity, demand, costs.understock_ratio, price)
    over = newsvendor.overstock_cost(quantity, demand, costs.overstock_ratio, price)
    return F.struct(
        F.lit(policy).alias("policy"),
        quantity.alias("order_quantity"),
        under.alias("understock_cost"),
        over.alias("overstock_cost"),
        (under + over).alias("cost"),
    )


def _replay_bounds(dataset: DataFrame, replay_spec: ReplaySpec, forecast: ForecastSpec) -> split.Bounds:
    """The split of the replay; fails where it would leave no decision."""
    required = forecast.test_size_days + forecast.validation_size_days
    latest = split.latest_origins(dataset, required + 1)
    if not latest:
        raise DecisionError(f"no rows available at lead_time_days={replay_spec.lead_time_days}")
    bounds = split.bounds_from(latest, forecast.test_size_days, forecast.validation_size_days)
    every = replay_spec.review_period_days
    if not any((day - _EPOCH).days % every == 0 for day in bounds.test_dates):
        raise DecisionError(f"no test rows survive review_period_days={every}")
    return bounds


def _known(dataset: DataFrame, bounds: split.Bounds, replay_spec: ReplaySpec) -> DataFrame:
    """The rows whose outcomes the baseline may use."""
    end = bounds.test_start - timedelta(days=replay_spec.embargo_days)
    return dataset.where(F.col("origin_date") < F.lit(end))


def skipped_decisions(
    dataset: DataFrame, replay_spec: ReplaySpec, forecast: ForecastSpec
) -> DataFrame:
    """Per series without history: the reviewed test decisions that :func:`replay` leaves out."""
    bounds = _replay_bounds(dataset, replay_spec, forecast)
    reviewed = dataset.where(
        bounds.is_test & on_cadence("origin_date", replay_spec.review_period_days)
    )
    known = _known(dataset, bounds, replay_spec).select(*SERIES).distinct()
    return (
        reviewed.join(known, list(SERIES), "left_anti")
        .groupBy(*SERIES)
        .agg(F.count("*").alias("n_skipped"))
    )


def replay(
    dataset: DataFrame,
    replay_spec: ReplaySpec,
    costs: CostSpec,
    forecast: ForecastSpec,
    forecaster: Forecaster,
) -> DataFrame:
    """Two rows per reviewed test decision, one per policy, graded on the same demand.

    ``dataset`` is assembled at the lead time with stride 1. The baseline quantity does not
    depend on the day, so it is computed once per series and joined. Series without history are
    left out of both policies; :func:`skipped_decisions` counts them.
    """
    bounds = _replay_bounds(dataset, replay_spec, forecast)
    every = replay_spec.review_period_days
    fractile = costs.critical_fractile
    fitted = forecaster([fractile]).fit(
        dataset.where(bounds.is_train), dataset.where(bounds.is_validation)
    )
    reviewed = dataset.where(bounds.is_test & on_cadence("origin_date", every))
    scored = fitted.predict(reviewed)
    baseline = order_up_to(
        _known(dataset, bounds, replay_spec),
        replay_spec.demand_distribution,
        replay_spec.window_days,
        replay_spec.service_level,
        replay_spec.n_simulations,
        replay_spec.random_seed,
    )
    decided = (
        scored.join(baseline, list(SERIES))
        .withColumn("actual_demand", F.col("target").cast("double"))
        .select(
            *SERIES,
            "origin_date",
            "target_date",
            "actual_demand",
            "sell_price",
            F.inline(
                F.array(
                    _graded(ML_POLICY, F.col(quantile_column(fractile)), costs),
                    _graded(BASELINE_POLICY, F.col("order_up_to"), costs),
                )
            ),
        )
    )
    return decided.select(
        "policy",
        *SERIES,
        "origin_date",
        "target_date",
        "order_quantity",
        "actual_demand",
        "sell_price",
        "understock_cost",
        "overstock_cost",
        "cost",
    )
