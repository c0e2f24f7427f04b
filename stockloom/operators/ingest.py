"""Raw retail tables to star schema: dimensions, calendar, prices, sales fact."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom import schemas

DAY_COLUMN = re.compile(r"^d_\d+$")
HOLIDAY_TYPES = ("National", "Religious")
PRICE_KEY = ("store_id", "sku_id", "wm_yr_wk")


def stores(raw_sales: DataFrame) -> DataFrame:
    return schemas.conform(raw_sales.select("store_id", "state_id").distinct(), schemas.STORES)


def skus(raw_sales: DataFrame) -> DataFrame:
    items = raw_sales.withColumnRenamed("item_id", "sku_id")
    return schemas.conform(items.select("sku_id", "dept_id", "cat_id").distinct(), schemas.SKUS)


def prices(raw_prices: DataFrame) -> DataFrame:
    return schemas.conform(raw_prices.withColumnRenamed("item_id", "sku_id"), schemas.PRICES)


def calendar(raw_calendar: DataFrame) -> DataFrame:
    """Typed calendar with date parts (0 = Sunday) and weekend, event, holiday and SNAP flags."""
    kinds = ", ".join(f"'{kind}'" for kind in HOLIDAY_TYPES)
    dated = raw_calendar.withColumn("date", F.to_date("date"))
    return schemas.conform(
        dated.selectExpr(
            "date",
            "d",
            "wm_yr_wk",
            "dayofweek(date) - 1 AS day_of_week",
            "weekofyear(date) AS week_of_year",
            "month(date) AS month",
            "year(date) AS year",
            "dayofweek(date) - 1 IN (0, 6) AS is_weekend",
            "event_name_1",
            "event_type_1",
            "event_name_2",
            "event_type_2",
            "event_name_1 IS NOT NULL OR event_name_2 IS NOT NULL AS is_event",
            f"coalesce(event_type_1, '') IN ({kinds}) OR coalesce(event_type_2, '') IN ({kinds})"
            " AS is_holiday",
            "snap_CA AS snap_ca",
            "snap_TX AS snap_tx",
            "snap_WI AS snap_wi",
        ),
        schemas.CALENDAR,
    )


def day_columns(raw_sales: DataFrame) -> list[str]:
    return [name for name in raw_sales.columns if DAY_COLUMN.match(name)]


def unpivot_days(raw_sales: DataFrame, id_columns: list[str]) -> DataFrame:
    """Wide day cells to one row per cell, without the empty (NULL) cells.

    The cells are exploded as one array. ``DataFrame.unpivot`` gives the same rows but plans one
    projection of the whole row per day column, which takes long with thousands of days.
    """
    days = day_columns(raw_sales)
    names = ", ".join(f"'{day}'" for day in days)
    cells = ", ".join(f"`{day}`" for day in days)
    pairs = F.expr(f"inline(arrays_zip(array({names}), array({cells})))")
    long = raw_sales.select(*id_columns, pairs.alias("d", "units_sold"))
    return long.where(F.col("units_sold").isNotNull())


def packed_days(raw_sales: DataFrame) -> DataFrame:
    """The wide file with all day cells in one array column, ``units``, in the order of its columns.

    Thousands of columns are slow to store and to scan: each row passes through as many writers.
    """
    days = day_columns(raw_sales)
    others = [name for name in raw_sales.columns if name not in days]
    return raw_sales.select(*others, F.array(*days).alias("units"))


def long_packed(packed: DataFrame, days: list[str]) -> DataFrame:
    """What :func:`long_sales` gives of the wide file, from its packed rows; ``days`` names the cells."""
    names = F.array(*map(F.lit, days))
    pairs = F.inline(F.arrays_zip(names.alias("d"), F.col("units").alias("units_sold")))
    long = packed.select("store_id", F.col("item_id").alias("sku_id"), pairs.alias("d", "units_sold"))
    return long.where(F.col("units_sold").isNotNull())


def long_sales(raw_sales: DataFrame) -> DataFrame:
    """store_id, sku_id, d, units_sold from the wide daily file."""
    return unpivot_days(raw_sales, ["store_id", "item_id"]).withColumnRenamed("item_id", "sku_id")


def sales(long: DataFrame, calendar_dim: DataFrame, price_table: DataFrame) -> DataFrame:
    """Sales fact. The inner price join drops every unpriced week, above all those before launch.

    The calendar is small enough for Catalyst to broadcast on its own; the price table is a fact
    and joins by shuffle, where adaptive execution splits a skewed week.
    """
    dated = long.join(calendar_dim.select("d", "date", "wm_yr_wk"), "d")
    return schemas.conform(dated.join(price_table, list(PRICE_KEY)), schemas.SALES)


def ingest_statistics(
    store_dim: DataFrame,
    sku_dim: DataFrame,
    calendar_dim: DataFrame,
    long: DataFrame,
    sales_fact: DataFrame,
) -> DataFrame:
    """One row of counts. ``dropped_rows`` holds all unpivoted cells that found no day or price."""
    sources = {
        "stores": store_dim,
        "skus": sku_dim,
        "calendar_days": calendar_dim,
        "long_rows": long,
        "sales_rows": sales_fact,
    }
    counts = None
    for name, frame in sources.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionAll(one)

    def value(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("n")))

    return counts.agg(
        value("stores").alias("stores"),
        value("skus").alias("skus"),
        value("calendar_days").alias("calendar_days"),
        value("sales_rows").alias("sales_rows"),
        (value("long_rows") - value("sales_rows")).alias("dropped_rows"),
    )
