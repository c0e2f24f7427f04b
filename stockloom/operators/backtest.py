"""Backtest of a quantile forecaster on the held-out latest origins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions import metrics
from stockloom.functions.quantiles import quantile_column
from stockloom.operators.split import Bounds

Forecaster = Callable[[list[float]], object]


def split_counts(dataset: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows and distinct origin dates of each part."""
    per_day = dataset.groupBy("origin_date").agg(F.count("*").alias("n"))
    return per_day.groupBy(bounds.label.alias("split")).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_origin_dates")
    )


def predict_test(
    dataset: DataFrame, bounds: Bounds, quantiles: list[float], forecaster: Forecaster
) -> DataFrame:
    fitted = forecaster(quantiles).fit(
        dataset.where(bounds.is_train), dataset.where(bounds.is_validation)
    )
    return fitted.predict(dataset.where(bounds.is_test))


def accuracy(predictions: DataFrame, quantiles: list[float]) -> DataFrame:
    """Metrics (name, quantile, value): pinball and coverage per level, the rest on the median and
    without a level.

    All measures come from one pass and one single-row aggregate.
    """
    actual = F.col("target").cast("double")
    median = F.col(quantile_column(0.5))
    measures = [
        ("wape", None, metrics.wape(actual, median)),
        ("bias", None, metrics.bias(actual, median)),
        ("rmse", None, metrics.rmse(actual, median)),
    ]
    for q in quantiles:
        predicted = F.col(quantile_column(q))
        measures.append(("pinball", q, metrics.pinball_loss(actual, predicted, q)))
        measures.append(("coverage", q, metrics.coverage(actual, predicted)))
    return _long(predictions, measures)


def _long(rows: DataFrame, measures: list[tuple]) -> DataFrame:
    """(name, quantile, value) of aggregates over ``rows``."""
    totals = rows.agg(*[c.cast("double").alias(f"m{i}") for i, (*_, c) in enumerate(measures)])
    entries = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(quantile).cast("double").alias("quantile"),
            F.col(f"m{i}").alias("value"),
        )
        for i, (name, quantile, _) in enumerate(measures)
    ]
    return totals.select(F.inline(F.array(*entries)))


def backtest_metrics(
    dataset: DataFrame, bounds: Bounds, quantiles: list[float], forecaster: Forecaster
) -> DataFrame:
    """(name, quantile, value): the accuracy measures and the row count of each part."""
    parts = {"train": bounds.is_train, "validation": bounds.is_validation, "test": bounds.is_test}
    counts = [(f"n_{name}_rows", None, F.count(F.when(own, 1))) for name, own in parts.items()]
    predictions = predict_test(dataset, bounds, quantiles, forecaster)
    return _long(dataset, counts).unionAll(accuracy(predictions, quantiles))


def quantile_accuracy(flat: DataFrame) -> DataFrame:
    """Per-quantile rows (quantile, pinball, coverage) from metrics; missing ones are NaN."""

    def measure(kind: str):
        value = F.max(F.when(F.col("name") == kind, F.col("value")))
        return F.coalesce(value, F.lit(float("nan"))).alias(kind)

    leveled = flat.where(F.col("quantile").isNotNull())
    return leveled.groupBy("quantile").agg(measure("pinball"), measure("coverage"))
