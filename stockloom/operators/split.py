"""Chronological splits, counted in distinct origin dates that occur in the data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SplitError(ValueError):
    """The data has too few rows or origin dates for the requested split."""


@dataclass(frozen=True)
class Bounds:
    """First day of validation and of test; ``test_start`` is None without a test part."""

    validation_start: date
    test_start: date | None
    test_dates: tuple[date, ...] = ()

    @property
    def is_train(self) -> Column:
        return F.col("origin_date") < F.lit(self.validation_start)

    @property
    def is_validation(self) -> Column:
        later = F.col("origin_date") >= F.lit(self.validation_start)
        return later if self.test_start is None else later & ~self.is_test

    @property
    def is_test(self) -> Column:
        if self.test_start is None:
            return F.lit(False)
        return F.col("origin_date") >= F.lit(self.test_start)

    @property
    def label(self) -> Column:
        return (
            F.when(self.is_train, "train").when(self.is_validation, "validation").otherwise("test")
        )


def origin_dates(dataset: DataFrame) -> DataFrame:
    return dataset.select("origin_date").distinct()


def latest_origins(dataset: DataFrame, n: int) -> list[date]:
    """The ``n`` latest distinct origin dates, newest first: a bounded top-k, not a full collect."""
    top = origin_dates(dataset).orderBy(F.desc("origin_date")).limit(n)
    return [row.origin_date for row in top.collect()]


def bounds_from(latest: list[date], test_days: int, validation_days: int) -> Bounds:
    """Bounds from the latest distinct origin dates, newest first."""
    required = test_days + validation_days
    if len(latest) <= required:
        raise SplitError(
            f"not enough distinct origin dates ({len(latest)}): test {test_days} + validation "
            f"{validation_days} days need at least {required + 1}"
        )
    return Bounds(
        validation_start=latest[required - 1],
        test_start=latest[test_days - 1] if test_days else None,
        test_dates=tuple(latest[:test_days]),
    )


def chronological_bounds(dataset: DataFrame, test_days: int, validation_days: int) -> Bounds:
    """Train, validation and test bounds of an assembled dataset."""
    latest = latest_origins(dataset, test_days + validation_days + 1)
    return bounds_from(latest, test_days, validation_days)


def two_way_bounds(dataset: DataFrame, validation_days: int) -> Bounds:
    return chronological_bounds(dataset, 0, validation_days)
