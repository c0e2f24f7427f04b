"""Integrity checks of the star schema, one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Check names (below), modes and details, which users of the check table match on.
POSITIVE, ZERO = "positive", "zero"


class QualityError(ValueError):
    """At least one integrity check failed."""


def _check_rows(values: DataFrame, checks: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """One-row frame of numbers to (check_name, mode, value); a NULL number counts as 0."""
    entries = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.lit(mode).alias("mode"),
            F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))
            .cast("bigint")
            .alias("value"),
        )
        for name, (mode, column) in checks.items()
    ]
    return values.select(F.inline(F.array(*entries)))


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _dimension(table: DataFrame, key: str, found: str) -> DataFrame:
    return table.select(key).distinct().withColumn(found, F.lit(True))


def _sales_checks(
    sales: DataFrame, stores: DataFrame, skus: DataFrame, calendar: DataFrame
) -> DataFrame:
    """All sales checks from one scan: facts are first summed per key, then matched to dimensions."""
    per_key = sales.groupBy("store_id", "sku_id", "date").agg(
        F.count("*").alias("n"),
        _count_if(F.col("units_sold") < 0).alias("negative"),
        _count_if(F.col("sell_price").isNull() | (F.col("sell_price") <= 0)).alias("unpriced"),
    )
    matched = (
        per_key.join(_dimension(stores, "store_id", "has_store"), "store_id", "left")
        .join(_dimension(skus, "sku_id", "has_sku"), "sku_id", "left")
        .join(_dimension(calendar, "date", "has_day"), "date", "left")
    )

    def missing(key: str, found: str) -> Column:
        return F.sum(F.when(F.col(key).isNotNull() & F.col(found).isNull(), F.col("n")))

    totals = matched.agg(
        F.sum("n").alias("n_rows"),
        _count_if(F.col("n") > 1).alias("duplicates"),
        F.sum("negative").alias("negative"),
        F.sum("unpriced").alias("unpriced"),
        missing("store_id", "has_store").alias("no_store"),
        missing("sku_id", "has_sku").alias("no_sku"),
        missing("date", "has_day").alias("no_day"),
    )
    return _check_rows(
        totals,
        {
            "sales_non_empty": (POSITIVE, "n_rows"),
            "sales_key_unique": (ZERO, "duplicates"),
            "no_negative_units": (ZERO, "negative"),
            "positive_prices": (ZERO, "unpriced"),
            "sales_stores_exist": (ZERO, "no_store"),
            "sales_skus_exist": (ZERO, "no_sku"),
            "sales_dates_in_calendar": (ZERO, "no_day"),
        },
    )


def quality_checks(
    stores: DataFrame, skus: DataFrame, calendar: DataFrame, prices: DataFrame, sales: DataFrame
) -> DataFrame:
    """The 13 checks as (check_name, mode, value, passed, detail)."""
    counted = F.count("*").alias("n_rows")
    per_price = prices.groupBy("store_id", "sku_id", "wm_yr_wk").agg(F.count("*").alias("n"))
    price_totals = per_price.agg(
        F.sum("n").alias("n_rows"), _count_if(F.col("n") > 1).alias("duplicates")
    )
    days = calendar.agg(counted, F.min("date").alias("lo"), F.max("date").alias("hi"))
    span = F.datediff("hi", "lo") + 1 - F.col("n_rows")
    rows = (
        _check_rows(stores.agg(counted), {"stores_non_empty": (POSITIVE, "n_rows")})
        .unionAll(_check_rows(skus.agg(counted), {"skus_non_empty": (POSITIVE, "n_rows")}))
        .unionAll(
            _check_rows(
                days,
                {
                    "calendar_non_empty": (POSITIVE, "n_rows"),
                    "calendar_contiguous": (ZERO, span),
                },
            )
        )
        .unionAll(
            _check_rows(
                price_totals,
                {
                    "prices_non_empty": (POSITIVE, "n_rows"),
                    "prices_key_unique": (ZERO, "duplicates"),
                },
            )
        )
        .unionAll(_sales_checks(sales, stores, skus, calendar))
    )
    positive = F.col("mode") == POSITIVE
    value = F.col("value")
    passed = F.when(positive, value > 0).otherwise(value == 0)
    number = value.cast("string")
    detail = (
        F.when(positive & passed, F.concat(number, F.lit(" rows")))
        .when(positive, F.lit("table is empty"))
        .when(passed, F.lit("ok"))
        .otherwise(F.concat(number, F.lit(" violating rows")))
    )
    return rows.select("*", passed.alias("passed"), detail.alias("detail"))


def require_quality(checks: DataFrame) -> None:
    """Raise with the failing checks, if any. The frame has 13 rows."""
    failed = checks.where(~F.col("passed")).orderBy("check_name").collect()
    if failed:
        summary = "; ".join(f"{row.check_name}: {row.detail}" for row in failed)
        raise QualityError(f"data validation failed ({summary})")
