"""Executive report sinks: metric rows and a top-ten, as CSV directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import divide_or_zero, full_name
from martwright.operators.kpis import (
    customer_summary,
    metric_rows,
    slice_sales,
    top_customers,
    top_products_orders,
)


def _sliced(df: DataFrame, filters: dict) -> DataFrame:
    return slice_sales(
        df,
        filters["start"],
        filters["end"],
        filters.get("category", "ALL"),
        filters.get("country", "ALL"),
    )


def report_product(df: DataFrame, filters: dict) -> tuple[DataFrame, DataFrame]:
    """Product executive summary: metric/value rows and the ten best products."""
    sliced = _sliced(df, filters)
    totals = sliced.agg(
        F.round(F.sum("gross_sales_amount"), 2).alias("sales"),
        F.count_distinct("order_number").alias("orders"),
        F.sum("quantity").alias("units"),
    ).withColumns(
        {
            "range": F.lit(f"{filters['start']} to {filters['end']}"),
            "aov": F.round(divide_or_zero("sales", "orders"), 2),
        }
    )
    kpi = metric_rows(
        totals,
        {
            "range": "Date Range",
            "sales": "Total Revenue ($)",
            "orders": "Total Orders",
            "units": "Units Sold",
            "aov": "Average Order Value ($)",
        },
    )
    top = top_products_orders(sliced).select(
        "product_name",
        F.round("revenue", 2).alias("Revenue"),
        F.col("units").alias("Units_Sold"),
        F.col("orders").alias("Orders"),
    )
    return kpi, top


def report_customer(df: DataFrame, filters: dict) -> tuple[DataFrame, DataFrame]:
    """Customer executive summary: metric/value rows and the ten best customers."""
    sliced = _sliced(df, filters)
    totals = customer_summary(sliced).withColumns(
        {
            "range": F.lit(f"{filters['start']} to {filters['end']}"),
            "category": F.lit(filters.get("category", "ALL")),
            "country": F.lit(filters.get("country", "ALL")),
            "spend": F.round("spend_per_customer", 2),
            "frequency": F.round("orders_per_customer", 2),
            "repeat": F.concat(F.format_number("repeat_rate", 1), F.lit("%")),
        }
    )
    kpi = metric_rows(
        totals,
        {
            "range": "Date Range",
            "category": "Category Filter",
            "country": "Region Filter",
            "active_customers": "Active Customers",
            "spend": "Avg Spend per Customer ($)",
            "frequency": "Avg Order Frequency",
            "repeat": "Repeat Rate (%)",
        },
    )
    top = top_customers(sliced).select(
        full_name("first_name", "last_name").alias("Customer_Name"),
        F.col("country").alias("Country"),
        F.col("total_orders").alias("Total_Orders"),
        F.round("total_spend", 2).alias("Total_Spend"),
    )
    return kpi, top


def write_report(frames: tuple[DataFrame, DataFrame], out: str) -> None:
    """Metric rows and top-ten as two CSV directories; both are a handful of rows."""
    for name, frame in zip(("summary", "top"), frames, strict=True):
        frame.coalesce(1).write.mode("overwrite").csv(f"{out}/{name}", header=True)
