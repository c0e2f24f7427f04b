"""Quantile columns: naming, rearrangement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_column(quantile: float) -> str:
    """The name of a level's column in a wide table of predictions."""
    return f"q_{quantile}".replace(".", "_")


def rearranged(values: list[Column]) -> Column:
    """The given per-row quantile values in ascending order, as an array."""
    return F.array_sort(F.array(*values))


def rearrange_quantiles(df: DataFrame, quantiles: list[float]) -> DataFrame:
    """Make each row's quantile columns non-decreasing in the quantile level."""
    names = [quantile_column(q) for q in sorted(quantiles)]
    ordered = df.withColumn("_ordered", rearranged([F.col(n) for n in names]))
    return ordered.withColumns(
        {name: F.col("_ordered")[i] for i, name in enumerate(names)}
    ).drop("_ordered")
