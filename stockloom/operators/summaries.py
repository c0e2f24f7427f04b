"""Summary tables over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALES_KEY = ("store_id", "sku_id", "date")
PRICE_KEY = ("store_id", "sku_id", "wm_yr_wk")


def sales_summary(sales: DataFrame, skus: DataFrame, stores: DataFrame) -> DataFrame:
    """Units and revenue by state, category and day.

    With dimensions small enough to broadcast, rows are combined where they lie and only group
    totals are shuffled.
    """
    return (
        sales.join(stores, "store_id")
        .join(skus, "sku_id")
        .groupBy("state_id", "cat_id", "date")
        .agg(
            F.sum("units_sold").alias("units_sold"),
            F.sum(F.col("units_sold") * F.col("sell_price")).alias("revenue"),
        )
    )


def series_coverage(sales: DataFrame) -> DataFrame:
    """First day, last day and row count of every series."""
    return sales.groupBy("store_id", "sku_id").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_days"),
    )


def duplicate_keys(table: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact counts per key value that the dimension lacks; NULL keys are not orphans.

    Facts are counted per key value before the join, so the anti join sees one row per value.
    """
    per_key = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return per_key.join(dimension.select(key), key, "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows for each given table."""
    result = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        result = one if result is None else result.unionAll(one)
    return result
