"""Job parameters. Frozen dataclasses that reject values the jobs cannot honour."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import Column, WindowSpec

from stockloom.functions import newsvendor

AGGREGATIONS = ("mean", "std", "min", "max", "sum")
DISTRIBUTIONS = ("empirical", "normal", "poisson")


class SettingsError(ValueError):
    """A parameter is outside its allowed range."""


def _refuse(name: str, value: object, why: str) -> None:
    raise SettingsError(f"{name} = {value!r}: {why}")


def _counts(**values: int) -> None:
    """Each is a number of days, rows or draws."""
    for name, value in values.items():
        if value < 1:
            _refuse(name, value, "a count starts at one")


def _shares(open_ends: bool, **values: float) -> None:
    """Each is a share of a whole; with ``open_ends`` neither nothing nor all of it."""
    for name, value in values.items():
        if not 0 <= value < 1 or (open_ends and value == 0):
            _refuse(name, value, "not a proper share")


def _filled(**values: tuple) -> None:
    for name, value in values.items():
        if not value:
            _refuse(name, value, "nothing to work with")


@dataclass(frozen=True)
class Aggregate:
    """A rolling aggregate of one's own: what ``over`` makes of the rolled column and a frame.

    The frame ends one row before the current one. ``name`` becomes part of the column's name.
    """

    name: str
    over: Callable[[Column, WindowSpec], Column]

    def __post_init__(self) -> None:
        if not self.name.isidentifier() or self.name in AGGREGATIONS:
            _refuse("aggregate name", self.name, "not a new name")


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns identify a series and which history features to derive from it.

    ``aggregations`` holds names of :data:`AGGREGATIONS` and :class:`Aggregate` objects.
    """

    target: str = "units_sold"
    date_column: str = "date"
    group_columns: tuple[str, ...] = ("store_id", "sku_id")
    lag_column: str = "units_sold"
    lags: tuple[int, ...] = (1, 7, 14, 28)
    roll_column: str = "units_sold"
    windows: tuple[int, ...] = (7, 14, 28)
    aggregations: tuple[str | Aggregate, ...] = ("mean", "std", "min", "max")
    calendar_features: tuple[str, ...] = (
        "day_of_week",
        "week_of_year",
        "month",
        "is_weekend",
        "is_event",
        "is_holiday",
        "snap_flag",
    )
    categorical_features: tuple[str, ...] = ("store_id", "sku_id", "dept_id", "cat_id", "state_id")
    numeric_features: tuple[str, ...] = ("sell_price",)

    def __post_init__(self) -> None:
        _filled(
            group_columns=self.group_columns,
            lags=self.lags,
            windows=self.windows,
            aggregations=self.aggregations,
        )
        # A lag or window of zero rows would let a row see its own day.
        _counts(**{f"lag {n}": n for n in self.lags}, **{f"window {n}": n for n in self.windows})
        for entry in self.aggregations:
            if not isinstance(entry, Aggregate) and entry not in AGGREGATIONS:
                _refuse("aggregations", entry, f"known are {', '.join(AGGREGATIONS)}; or pass an Aggregate")
        if len({*self.aggregation_names}) < len(self.aggregations):
            _refuse("aggregations", self.aggregation_names, "each name can stand for one column only")

    @property
    def lag_names(self) -> list[str]:
        return [f"{self.lag_column}_lag_{n}" for n in self.lags]

    @property
    def aggregation_names(self) -> list[str]:
        return [a.name if isinstance(a, Aggregate) else a for a in self.aggregations]

    @property
    def rolling_names(self) -> list[str]:
        return [f"{self.roll_column}_roll_{a}_{w}" for w in self.windows for a in self.aggregation_names]

    @property
    def history_names(self) -> list[str]:
        """Columns known at the origin day."""
        return self.lag_names + self.rolling_names

    @property
    def extra_categoricals(self) -> list[str]:
        return [c for c in self.categorical_features if c not in self.group_columns]

    @property
    def future_names(self) -> list[str]:
        """Columns known in advance for the target day."""
        return [*self.calendar_features, *self.numeric_features, *self.extra_categoricals]

    @property
    def reach(self) -> int:
        """How many earlier rows of a series one row's features look at."""
        return max(*self.lags, *self.windows)

    def fingerprint(self) -> str:
        """Short stable hash, recorded with each snapshot. Functions count by their names."""
        text = json.dumps(asdict(self), sort_keys=True, default=lambda f: f"{f.__module__}.{f.__qualname__}")
        return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class CostSpec:
    """Unit economics as shares of the sell price."""

    # The usual assumptions.
    currency: str = "USD"
    unit_cost_ratio: float = 0.65
    salvage_ratio: float = 0.35
    holding_cost_ratio: float = 0.02
    stockout_penalty_ratio: float = 0.10

    def __post_init__(self) -> None:
        _shares(True, unit_cost_ratio=self.unit_cost_ratio)
        _shares(False, salvage_ratio=self.salvage_ratio, holding_cost_ratio=self.holding_cost_ratio)
        if self.stockout_penalty_ratio < 0:
            _refuse("stockout_penalty_ratio", self.stockout_penalty_ratio, "a penalty, not a reward")
        if self.salvage_ratio >= self.unit_cost_ratio:
            _refuse("salvage_ratio", self.salvage_ratio, "leftovers would pay for themselves")

    @property
    def understock_ratio(self) -> float:
        return newsvendor.understock_ratio(self.unit_cost_ratio, self.stockout_penalty_ratio)

    @property
    def overstock_ratio(self) -> float:
        return newsvendor.overstock_ratio(
            self.unit_cost_ratio, self.salvage_ratio, self.holding_cost_ratio
        )

    @property
    def critical_fractile(self) -> float:
        return newsvendor.balance(self.understock_ratio, self.overstock_ratio)


@dataclass(frozen=True)
class ForecastSpec:
    """Horizons, quantile levels and split sizes (in distinct origin dates)."""

    horizon_days: int = 28
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)
    test_size_days: int = 28
    validation_size_days: int = 28
    origin_stride_days: int = 7

    def __post_init__(self) -> None:
        _counts(
            horizon_days=self.horizon_days,
            test_size_days=self.test_size_days,
            validation_size_days=self.validation_size_days,
            origin_stride_days=self.origin_stride_days,
        )
        _filled(quantiles=self.quantiles)
        _shares(True, **{f"quantile {q}": q for q in self.quantiles})
        if any(a >= b for a, b in zip(self.quantiles, self.quantiles[1:], strict=False)):
            _refuse("quantiles", self.quantiles, "each must exceed the one before")
        if 0.5 not in self.quantiles:
            _refuse("quantiles", self.quantiles, "the accuracy measures need the median")

    def trained_quantiles(self, costs: CostSpec) -> list[float]:
        return sorted({*self.quantiles, costs.critical_fractile})


@dataclass(frozen=True)
class ReplaySpec:
    """Replay of both stocking policies over held-out decision days.

    The baseline covers ``lead_time_days`` of summed demand while both policies are graded
    against one day's demand; ``baseline_window_days=1`` makes the two alike. ``embargo_days``
    drops that many origin days before the test start from the baseline's history; the default
    0 keeps the last ``lead_time_days - 1`` outcomes although they lie after the first decision.
    """

    service_level: float = 0.95
    lead_time_days: int = 7
    review_period_days: int = 1
    demand_distribution: str = "empirical"
    n_simulations: int = 1000
    random_seed: int = 42
    baseline_window_days: int | None = None
    embargo_days: int = 0

    def __post_init__(self) -> None:
        _shares(True, service_level=self.service_level)
        _counts(
            lead_time_days=self.lead_time_days,
            review_period_days=self.review_period_days,
            n_simulations=self.n_simulations,
            baseline_window_days=1 if self.baseline_window_days is None else self.baseline_window_days,
        )
        if self.demand_distribution not in DISTRIBUTIONS:
            _refuse("demand_distribution", self.demand_distribution, f"known are {', '.join(DISTRIBUTIONS)}")
        if self.embargo_days < 0:
            _refuse("embargo_days", self.embargo_days, "cannot reach into the test days")

    @property
    def window_days(self) -> int:
        return self.baseline_window_days or self.lead_time_days
