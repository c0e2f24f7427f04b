"""Report sections as small frames. They read stored results and recompute nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators.decisions import BASELINE_POLICY, ML_POLICY
from stockloom.settings import CostSpec

TOP_MISSES = 20


def recommendation_summary(recommendations: DataFrame) -> DataFrame:
    """One row; none when there are no recommendations."""
    return recommendations.agg(
        F.count("*").alias("n_recommendations"),
        F.min("origin_date").alias("recommendation_date"),
        F.max("lead_time_days").alias("lead_time_days"),
        F.sum("order_quantity").alias("total_order_quantity"),
        F.sum("safety_stock").alias("total_safety_stock"),
        F.min("critical_fractile").alias("critical_fractile"),
        F.max("snapshot_table").alias("snapshot_table"),
    ).where("n_recommendations > 0")


def top_misses(recommendations: DataFrame, n: int = TOP_MISSES) -> DataFrame:
    """The ``n`` recommendations furthest from realized demand; ties go by series and day."""
    miss = F.abs(F.col("order_quantity") - F.col("actual_demand"))
    return (
        recommendations.select(
            "store_id",
            "sku_id",
            "origin_date",
            "target_date",
            "order_quantity",
            "median_forecast",
            "safety_stock",
            "actual_demand",
            miss.alias("absolute_miss"),
        )
        .orderBy(F.desc("absolute_miss"), "store_id", "sku_id", "target_date")
        .limit(n)
    )


def policy_summary(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("policy")
        .agg(
            F.count("*").alias("n_decisions"),
            F.sum("cost").alias("total_cost"),
            F.sum("understock_cost").alias("total_understock_cost"),
            F.sum("overstock_cost").alias("total_overstock_cost"),
            F.avg("cost").alias("mean_cost"),
        )
        .orderBy("policy")
    )


def policy_savings(results: DataFrame) -> DataFrame:
    """One row; savings are NULL when either policy is missing."""

    def total(policy: str) -> Column:
        return F.sum(F.when(F.col("policy") == policy, F.col("cost")))

    return results.agg(
        total(BASELINE_POLICY).alias("baseline_cost"),
        total(ML_POLICY).alias("ml_cost"),
        (total(BASELINE_POLICY) - total(ML_POLICY)).alias("savings"),
    )


def cost_assumptions(spark: SparkSession, costs: CostSpec) -> DataFrame:
    """The ratios behind every decision and what follows from them."""
    ratios = spark.range(1).select(
        F.lit(costs.currency).alias("currency"),
        F.lit(costs.unit_cost_ratio).alias("unit_cost_ratio"),
        F.lit(costs.salvage_ratio).alias("salvage_ratio"),
        F.lit(costs.holding_cost_ratio).alias("holding_cost_ratio"),
        F.lit(costs.stockout_penalty_ratio).alias("stockout_penalty_ratio"),
    )
    return ratios.select("*", F.lit(costs.understock_ratio).alias("understock_cost_ratio"),
                         F.lit(costs.overstock_ratio).alias("overstock_cost_ratio"),
                         F.lit(costs.critical_fractile).alias("critical_fractile"))


def kpi_tiles(
    spark: SparkSession,
    recommendations: DataFrame | None,
    results: DataFrame | None,
    metrics: DataFrame | None,
) -> DataFrame:
    """One row of headline numbers; a missing input leaves its number NULL."""
    missing = F.lit(None).cast("double")
    quantity = stock = savings = wape = missing
    if recommendations is not None:
        summary = recommendation_summary(recommendations)
        quantity = summary.select("total_order_quantity").scalar()
        stock = summary.select("total_safety_stock").scalar()
    if results is not None:
        savings = policy_savings(results).select("savings").scalar()
    if metrics is not None:
        wape = metrics.where("name = 'wape'").agg(F.max("value")).scalar()
    return spark.range(1).select(
        quantity.alias("total_order_quantity"),
        stock.alias("total_safety_stock"),
        savings.alias("savings"),
        wape.alias("wape"),
    )
