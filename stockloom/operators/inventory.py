"""Classical order-up-to levels: one quantity per series from its demand history."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.seasonal import demand_histogram
from stockloom.settings import DISTRIBUTIONS

SERIES = ("store_id", "sku_id")


def series_history(rows: DataFrame) -> DataFrame:
    """Per series the targets in order of origin date, as an array.

    The array has one entry per origin day of the series. The order-up-to levels below do not
    need it: they work on sums or on counts per demand value.
    """
    entries = F.sort_array(F.collect_list(F.struct("origin_date", "target")))
    return rows.groupBy(*SERIES).agg(F.transform(entries, lambda e: e["target"]).alias("demand"))


def normal_levels(rows: DataFrame, window_days: int, level: float) -> DataFrame:
    """mean * L + z * std * sqrt(L) with the population deviation; the mean when it is zero."""
    z = NormalDist().inv_cdf(level)
    demand = F.col("target").cast("double")
    return (
        rows.groupBy(*SERIES)
        .agg(F.avg(demand).alias("mean"), F.stddev_pop(demand).alias("std"))
        .select(
            *SERIES,
            (
                F.col("mean") * window_days + F.lit(z) * F.col("std") * math.sqrt(window_days)
            ).alias("order_up_to"),
        )
    )


def poisson_quantile(mean: Column, level: float) -> Column:
    """Smallest k with P(X <= k) >= level for X ~ Poisson(mean).

    Probabilities are summed in log space over a run of k that must hold the answer: below it lies
    a mass under 1e-18, and Chernoff's bound puts the quantile before its end. Its length grows
    with the mean's square root.
    """
    tail = -math.log(1 - level)
    last = F.ceil(mean + tail / 3 + F.sqrt(F.lit(tail * tail / 9) + mean * (2 * tail))) + 1
    below = F.floor(mean - F.sqrt(mean * (2 * 41.5)))
    first = F.when(mean < 200, F.lit(0)).otherwise(below).cast("bigint")
    n = first.cast("double")
    # Stirling's series; the first term is either 0! or of a k beyond seventy.
    log_factorial = F.when(n == 0, F.lit(0.0)).otherwise(
        n * F.log(n) - n + F.log(n * (2 * math.pi)) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)
    )
    log_p = n * F.log(mean) - mean - log_factorial
    start = F.struct(
        log_p.alias("log_p"),
        F.exp(log_p).alias("cdf"),
        F.when(F.exp(log_p) >= level, first).alias("k"),
    )

    def step(state: Column, k: Column) -> Column:
        term = state["log_p"] + F.log(mean) - F.log(k)
        total = state["cdf"] + F.exp(term)
        found = F.coalesce(state["k"], F.when(total >= level, k))
        return F.struct(term.alias("log_p"), total.alias("cdf"), found.alias("k"))

    run = F.sequence(first + 1, last.cast("bigint"))
    walked = F.aggregate(run, start, step, lambda s: F.coalesce(s["k"].cast("double"), last.cast("double")))
    return F.when(mean > 0, walked).otherwise(F.lit(0.0))


def poisson_levels(rows: DataFrame, window_days: int, level: float) -> DataFrame:
    mean = rows.groupBy(*SERIES).agg((F.avg("target") * window_days).alias("mean"))
    return mean.select(*SERIES, poisson_quantile(F.col("mean"), level).alias("order_up_to"))


def _draw_numbers(n_simulations: int, window_days: int, seed: int) -> np.ndarray:
    """A fixed pseudo-random 32-bit number per simulated day, from md5 of 'seed|draw|day'."""
    return np.array(
        [
            [
                int(hashlib.md5(f"{seed}|{draw}|{day}".encode()).hexdigest()[:8], 16)
                for day in range(window_days)
            ]
            for draw in range(n_simulations)
        ],
        dtype=np.int64,
    )


def bootstrap_levels(
    rows: DataFrame, window_days: int, level: float, n_simulations: int, seed: int
) -> DataFrame:
    """Quantile of simulated window totals, each the sum of days drawn with replacement.

    A draw picks position ``number % n`` of the series' demand in ascending order. Only the
    counts per demand value travel to the simulation, never the single days.
    """
    numbers = _draw_numbers(n_simulations, window_days, seed)

    def simulate(values: pd.Series, counts: pd.Series) -> pd.Series:
        """All series of a batch at once: their cumulative counts lie one behind the other, and a
        series' draws are looked up behind the counts of those before it."""
        if not len(values):
            return pd.Series([], dtype="float64")
        upper = np.cumsum(np.concatenate(counts.to_list()))
        ends = np.cumsum([len(c) for c in counts])
        total = np.array([c.sum() for c in counts])
        before = upper[ends - 1] - total
        drawn = before[:, None, None] + numbers[None] % total[:, None, None]
        demand = np.concatenate(values.to_list())[np.searchsorted(upper, drawn, side="right")]
        return pd.Series(np.quantile(demand.sum(axis=2), level, axis=1))

    def in_parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, counts in batches:  # draws of 256 series at a time bound the memory
            parts = [slice(a, a + 256) for a in range(0, len(values), 256)]
            done = [simulate(values[p], counts[p]) for p in parts]
            yield pd.concat(done, ignore_index=True) if done else pd.Series([], dtype="float64")

    simulated = F.pandas_udf(in_parts, "double")
    per_series = (
        demand_histogram(rows, list(SERIES))
        .groupBy(*SERIES)
        .agg(F.sort_array(F.collect_list(F.struct("target", "n"))).alias("counts"))
    )
    return per_series.select(
        *SERIES, simulated(F.col("counts.target"), F.col("counts.n")).alias("order_up_to")
    )


def order_up_to(
    rows: DataFrame,
    distribution: str,
    window_days: int,
    level: float,
    n_simulations: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """store_id, sku_id, order_up_to by the named demand distribution."""
    if distribution == "empirical":
        return bootstrap_levels(rows, window_days, level, n_simulations, seed)
    if distribution == "normal":
        return normal_levels(rows, window_days, level)
    if distribution == "poisson":
        return poisson_levels(rows, window_days, level)
    raise ValueError(f"unknown distribution {distribution!r}; choose from {DISTRIBUTIONS}")
