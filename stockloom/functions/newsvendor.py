"""Newsvendor economics. Ratios are shares of the unit sell price; numbers and columns both work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def understock_ratio(unit_cost, stockout_penalty):
    """Lost margin and goodwill per unit short."""
    return 1.0 - unit_cost + stockout_penalty


def overstock_ratio(unit_cost, salvage, holding):
    """What a unit left over costs after salvage, with its storage."""
    return unit_cost - salvage + holding


def balance(understock, overstock):
    return understock / (understock + overstock)


def critical_fractile(understock: Column, overstock: Column) -> Column:
    """The balance of both costs. Fails on a cost that is not strictly positive."""
    valid = (understock > 0) & (overstock > 0)
    return F.when(valid, balance(understock, overstock)).otherwise(
        F.raise_error(F.lit("understock and overstock cost must be > 0")).cast("double")
    )


def safety_stock(order_quantity: Column, median: Column) -> Column:
    """May be negative: the costs can favour stocking less than the median."""
    return order_quantity - median


def understock_cost(quantity: Column, demand: Column, ratio: float, price: Column) -> Column:
    return price * F.lit(ratio) * F.greatest(demand - quantity, F.lit(0.0))


def overstock_cost(quantity: Column, demand: Column, ratio: float, price: Column) -> Column:
    return price * F.lit(ratio) * F.greatest(quantity - demand, F.lit(0.0))
