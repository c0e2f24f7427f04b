"""Empirical demand quantiles per series and day of week."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.quantiles import quantile_column, rearrange_quantiles
from stockloom.settings import FeatureSpec

_DAYS = range(7)


def target_day_of_week() -> Column:
    return F.dayofweek("target_date") - 1


def demand_histogram(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """How often each target value occurs per key.

    Counting combines on the map side, so a series that holds much of the data shrinks to its
    distinct unit counts before it is shuffled.
    """
    return rows.groupBy(*keys, F.col("target").cast("double").alias("target")).agg(
        F.count("*").alias("n")
    )


@dataclass(frozen=True)
class SeasonalModel:
    """Per series: quantiles by target day of week and over all days; and the overall ones."""

    quantiles: list[float]
    per_series: DataFrame
    overall: DataFrame
    spec: FeatureSpec

    def table(self) -> DataFrame:
        """One row per series and day of week seen in training."""
        entries = [
            F.struct(
                F.lit(d).alias("day_of_week"),
                *[F.col(f"day_{d}")[i].alias(quantile_column(q)) for i, q in self._levels()],
            )
            for d in _DAYS
        ]
        rows = self.per_series.select(*self.spec.group_columns, F.inline(F.array(*entries)))
        return rows.where(F.col(quantile_column(self.quantiles[0])).isNotNull())

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with one column per quantile.

        A series' own quantiles of the target's day of week are used where training had such
        days, else its quantiles over all days, else those over all series.
        """
        own_day = F.element_at(
            F.array(*[F.col(f"day_{d}") for d in _DAYS]), target_day_of_week() + 1
        )
        chosen = F.coalesce(own_day, F.col("all_days"), self.overall.scalar())
        joined = rows.join(self.per_series, list(self.spec.group_columns), "left")
        scored = joined.withColumn("_levels", chosen).select(
            *rows.columns,
            *[F.col("_levels")[i].alias(quantile_column(q)) for i, q in self._levels()],
        )
        return rearrange_quantiles(scored, self.quantiles)

    def _levels(self):
        return enumerate(self.quantiles)


@dataclass(frozen=True)
class SeasonalQuantiles:
    """Forecaster whose quantiles are exact percentiles of the training targets."""

    quantiles: list[float]
    spec: FeatureSpec = field(default_factory=FeatureSpec)
    uses_features: ClassVar[bool] = False

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> SeasonalModel:
        """Fit on ``train``; there is nothing to stop early, so ``validation`` is not used."""
        series = list(self.spec.group_columns)
        counts = demand_histogram(train, [*series, target_day_of_week().alias("_day")])
        levels = F.array(*[F.lit(q) for q in self.quantiles])

        def percentile(values: Column) -> Column:
            return F.percentile(values, levels, F.col("n"))

        per_series = counts.groupBy(*series).agg(
            percentile(F.col("target")).alias("all_days"),
            *[
                percentile(F.when(F.col("_day") == d, F.col("target"))).alias(f"day_{d}")
                for d in _DAYS
            ],
        )
        overall = demand_histogram(train, []).agg(percentile(F.col("target")).alias("overall"))
        return SeasonalModel(list(self.quantiles), per_series, overall, self.spec)
