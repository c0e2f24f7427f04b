"""Direct multi-horizon assembly: history from the origin day, the rest from the target day.

``store`` is a feature store or a projection of one: feature columns it lacks are left out. With
``dimensions``, it may be sales with history columns alone; what describes a target day is then
joined to the assembled rows. Rows without a series key or a day are left out.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.features import Dimensions
from stockloom.settings import FeatureSpec


def on_cadence(day: str, every: int) -> Column:
    """Whether a date lies on the epoch-aligned 1-in-``every`` day cadence."""
    return F.unix_date(day) % every == 0


def _present(store: DataFrame, names: list[str]) -> list[str]:
    return [name for name in names if name in store.columns]


def _assembled(
    store: DataFrame,
    spec: FeatureSpec,
    nearest: int,
    furthest: int,
    stride: int,
    dimensions: Dimensions | None,
) -> DataFrame:
    """Every row as a target, once for each sampled origin ``nearest`` to ``furthest`` days before it.

    A frame over the days before the target gathers the origins that the series has there, at most
    ``furthest / stride`` of them, so that no row travels to another: the frame works on the same
    clustering by series as the history windows, or needs one shuffle by series where there is none.
    """
    day, known = spec.date_column, [F.col(c).isNotNull() for c in spec.group_columns]
    origin = F.struct(F.col(day).alias("origin_date"), *_present(store, spec.history_names))
    # Stated as SQL: only there may a range of days be taken of a date, whose order the rows have.
    gathered = F.expr(
        f"collect_list(_origin) OVER (PARTITION BY {', '.join(f'`{c}`' for c in spec.group_columns)} "
        f"ORDER BY `{day}` RANGE BETWEEN {furthest} PRECEDING AND {nearest} PRECEDING)"
    )
    rows = (
        store.where(functools.reduce(operator.and_, known))
        .select(
            *spec.group_columns,
            day,
            *_present(store, spec.future_names),
            F.col(spec.target).alias("target"),
            F.when(on_cadence(day, stride), origin).alias("_origin"),
        )
        .withColumn("_origins", gathered)
        .drop("_origin")
        .withColumnRenamed(day, "target_date")
        .select("*", F.inline("_origins"))
        .drop("_origins")
        .withColumn("horizon", F.datediff("target_date", "origin_date"))
    )
    if dimensions is not None:
        rows = dimensions.describe(rows, "target_date")
    return rows.select(
        *spec.group_columns,
        "origin_date",
        "target_date",
        "horizon",
        *_present(rows, spec.history_names),
        *_present(rows, spec.future_names),
        "target",
    )


def assemble_horizon(
    store: DataFrame,
    spec: FeatureSpec,
    horizon: int,
    stride: int = 1,
    dimensions: Dimensions | None = None,
) -> DataFrame:
    """Rows (series, origin, target = origin + horizon) for one horizon.

    Days are matched by date: an origin without a row on its target day yields nothing.
    """
    return _assembled(store, spec, horizon, horizon, stride, dimensions)


def assemble_horizons(
    store: DataFrame,
    spec: FeatureSpec,
    max_horizon: int,
    stride: int = 1,
    dimensions: Dimensions | None = None,
) -> DataFrame:
    """Rows for all horizons 1..max_horizon in one pass over the series."""
    return _assembled(store, spec, 1, max_horizon, stride, dimensions)
