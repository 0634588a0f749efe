"""Analyses over the star schema and over the merged frame.

Where a measure is grouped by a dimension attribute, the fact is summed per
surrogate key first: the shuffle then carries one row per key, and a key that
owns a large share of the fact costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.columns import (
    as_day,
    half_even_to_long,
    months_between_boundaries,
    round_to_long,
    years_between_boundaries,
)
from martwright.operators.gold import segment
from martwright.operators.ranking import ascending, descending, global_rank, top_k

MIN_DATE = "2010-01-01"
MIN_YEAR = 2010


def _since(fact: DataFrame, min_date) -> DataFrame:
    return fact.filter(F.col("order_date") >= F.lit(min_date).cast("date"))


def _year_start(column: str = "order_date"):
    return F.trunc(column, "year")


def _per_key(fact: DataFrame, key: str, *extra: str) -> DataFrame:
    """Revenue and units per surrogate key, the partial sums behind most analyses."""
    return fact.groupBy(key, *extra).agg(
        F.sum("gross_sales_amount").alias("revenue"), F.sum("quantity").alias("units")
    )


# --- over the star schema ---------------------------------------------------


def yearly_running(fact: DataFrame, min_date=MIN_DATE) -> DataFrame:
    """Sales per year, running total, running mean of the yearly mean price."""
    yearly = (
        _since(fact, min_date)
        .groupBy(_year_start().alias("order_date"))
        .agg(
            round_to_long(F.sum("gross_sales_amount")).alias("total_sales"),
            round_to_long(F.avg("unit_price")).alias("avg_price"),
        )
    )
    so_far = Window.orderBy("order_date")  # one row per calendar year
    return yearly.select(
        "order_date",
        "total_sales",
        F.sum("total_sales").over(so_far).alias("running_total_sales"),
        "avg_price",
        round_to_long(F.avg("avg_price").over(so_far)).alias("moving_avg_price"),
    ).orderBy("order_date")


def segment_counts(fact: DataFrame, vip: float = 5000, months: int = 12) -> DataFrame:
    """Customers per segment by lifespan in months and total spend."""
    spending = fact.groupBy("customer_key").agg(
        F.sum("gross_sales_amount").alias("total_spending"),
        months_between_boundaries(F.max("order_date"), F.min("order_date")).alias("lifespan_months"),
    )
    return (
        spending.groupBy(
            segment("lifespan_months", "total_spending", vip, months).alias("customer_segment")
        )
        .agg(F.count("customer_key").alias("total_customers"))
        .orderBy(F.desc("total_customers"), "customer_segment")
    )


def order_span(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        years_between_boundaries(F.max("order_date"), F.min("order_date"))
        .cast("long")
        .alias("order_range_year"),
    )


def birthdate_span(customers: DataFrame, as_of=None) -> DataFrame:
    """The labels follow the established report: the latest birthdate is ``oldest``."""
    return customers.agg(
        F.max("birthdate").alias("oldest_birthdate"),
        F.min("birthdate").alias("youngest_birthdate"),
        years_between_boundaries(as_day(as_of), F.min("birthdate")).cast("long").alias("oldest_age"),
    )


def customers_by(customers: DataFrame, column: str) -> DataFrame:
    """Customers per attribute value, NULL dropped."""
    return (
        customers.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("customer_key").alias("total_customers"))
    )


def product_stats(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(
        F.count("product_key").alias("total_products"),
        F.round(F.avg("cost"), 2).alias("avg_cost"),
    )


def revenue_by_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue per category; sales without a category keep a NULL group."""
    return (
        _per_key(fact, "product_key")
        .join(products.select("product_key", "category"), "product_key", "left")
        .groupBy("category")
        .agg(F.sum("revenue").alias("total_revenue"))
    )


def _customer_revenue(fact: DataFrame, customers: DataFrame, *columns: str) -> DataFrame:
    return (
        _per_key(fact, "customer_key")
        .join(
            customers.select("customer_key", *[c for c in columns if c != "customer_key"]),
            "customer_key",
            "left",
        )
        .groupBy(*columns)
        .agg(F.sum("revenue").alias("total_revenue"))
    )


def rank_customers_revenue(fact: DataFrame, customers: DataFrame) -> DataFrame:
    revenue = _customer_revenue(fact, customers, "customer_id", "first_name", "last_name")
    names = [key for c in ("customer_id", "first_name", "last_name") for key in ascending(c)]
    return global_rank(revenue, [*descending("total_revenue"), *names], "rank")


def units_by_country(fact: DataFrame, customers: DataFrame) -> DataFrame:
    located = customers.filter(F.col("country").isNotNull()).select("customer_key", "country")
    return (
        _per_key(fact, "customer_key")
        .join(located, "customer_key")
        .groupBy("country")
        .agg(F.sum("units").alias("total_sold_items"))
    )


# Measure labels of the metric audit, by source column.
SALES_MEASURES = {
    "total_sales": "Total Sales",
    "total_quantity": "Total Quantity",
    "avg_unit_price": "Average Unit Price",
    "total_distinct_orders": "Distinct Total Orders",
    "active_customers": "Active Purchasing Customers",
}


def metric_audit(fact: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Seven labelled measures as rows; the fact is read once."""
    sales = fact.agg(
        F.sum("gross_sales_amount").cast("double").alias("total_sales"),
        F.sum("quantity").cast("double").alias("total_quantity"),
        F.round(F.avg("unit_price"), 2).cast("double").alias("avg_unit_price"),
        F.count_distinct("order_number").cast("double").alias("total_distinct_orders"),
        F.count_distinct("customer_key").cast("double").alias("active_customers"),
    )
    labels = F.create_map(*[F.lit(x) for pair in SALES_MEASURES.items() for x in pair])
    rows = sales.unpivot([], list(SALES_MEASURES), "_column", "measure_value").select(
        labels[F.col("_column")].alias("measure_name"), "measure_value"
    )
    for frame, label in (
        (products, "Total Products (Catalog)"),
        (customers, "Total Customers (Registered)"),
    ):
        rows = rows.unionByName(
            frame.agg(F.count(F.lit(1)).cast("double").alias("measure_value")).select(
                F.lit(label).alias("measure_name"), "measure_value"
            )
        )
    return rows


def product_yoy(fact: DataFrame, products: DataFrame, min_date=MIN_DATE) -> DataFrame:
    """Product by year against its own mean and against the year before."""
    yearly = (
        _since(fact, min_date)
        .groupBy("product_key", _year_start().alias("order_year"))
        .agg(F.sum("gross_sales_amount").alias("revenue"))
        .join(products.select("product_key", "product_name"), "product_key", "left")
        .groupBy("order_year", "product_name")
        .agg(round_to_long(F.sum("revenue")).alias("current_sales"))
    )
    # One row per calendar year in each partition.
    own = Window.partitionBy("product_name")
    measured = yearly.select(
        "*",
        round_to_long(F.avg("current_sales").over(own)).alias("avg_sales"),
        F.lag("current_sales").over(own.orderBy("order_year")).alias("py_sales"),
    ).withColumns(
        {
            "diff_avg": F.col("current_sales") - F.col("avg_sales"),
            "diff_py": F.col("current_sales") - F.col("py_sales"),
        }
    )
    return measured.select(
        "order_year",
        "product_name",
        "current_sales",
        "avg_sales",
        "diff_avg",
        F.when(F.col("diff_avg") > 0, "Above Avg")
        .when(F.col("diff_avg") < 0, "Below Avg")
        .otherwise("Avg")
        .alias("avg_change"),
        "py_sales",
        "diff_py",
        F.when(F.col("diff_py") > 0, "Increase")
        .when(F.col("diff_py") < 0, "Decrease")
        .otherwise("No Change")
        .alias("py_change"),
    ).orderBy(F.asc_nulls_last("product_name"), "order_year")


def cost_bands(products: DataFrame, edges=(100, 500, 1000)) -> DataFrame:
    """Products per cost band, in band order; NULL cost falls in the last band."""
    low, middle, high = edges
    cost = F.col("cost")
    band = (
        F.when(cost < low, 1)
        .when((cost >= low) & (cost < middle), 2)
        .when((cost >= middle) & (cost <= high), 3)
        .otherwise(4)
    )
    label = (
        F.when(F.col("_band") == 1, f"Below {low}")
        .when(F.col("_band") == 2, f"{low} - {middle}")
        .when(F.col("_band") == 3, f"{middle} - {high}")
        .otherwise(f"Above {high}")
    )
    return (
        products.groupBy(band.alias("_band"))
        .agg(F.count("product_key").alias("total_products"))
        .orderBy("_band")
        .select(label.alias("cost_range"), "total_products")
    )


def rank_products(fact: DataFrame, products: DataFrame, desc: bool = True) -> DataFrame:
    revenue = (
        _per_key(fact, "product_key")
        .join(products.select("product_key", "product_name"), "product_key", "left")
        .groupBy("product_name")
        .agg(F.sum("revenue").alias("total_revenue"))
    )
    first = (descending if desc else ascending)("total_revenue")
    return global_rank(revenue, [*first, *ascending("product_name")], "product_rank")


def top_customers(fact: DataFrame, customers: DataFrame, k: int = 10) -> DataFrame:
    revenue = (
        _per_key(fact, "customer_key")
        .join(
            customers.select(
                "customer_key", "first_name", "last_name", F.col("customer_key").alias("_known")
            ),
            "customer_key",
            "left",
        )
        .groupBy(F.col("_known").alias("customer_key"), "first_name", "last_name")
        .agg(F.sum("revenue").alias("total_revenue"))
    )
    order = [F.desc_nulls_last("total_revenue"), F.asc_nulls_last("customer_key")]
    return top_k(revenue, order, k, "customer_rank")


def rank_customers_orders(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Fewest distinct orders first; sales without a known customer form one group."""
    known = customers.select(
        "customer_key", "first_name", "last_name", F.col("customer_key").alias("_known")
    )
    bought = fact.select("customer_key", "order_number").distinct()
    pairs = (
        bought.join(known, "customer_key", "left")
        .groupBy(F.col("_known").alias("customer_key"), "first_name", "last_name")
        .agg(F.count_distinct("order_number").alias("total_orders"))
    )
    order = [*ascending("total_orders"), *ascending("customer_key")]
    return global_rank(pairs, order, "customer_rank")


def category_share(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Category revenue as ``n.nn%`` of the total; the NULL category counts."""
    totals = revenue_by_category(fact, products).select(
        "category", round_to_long("total_revenue").alias("total_sales")
    )
    overall = totals.agg(F.sum("total_sales").alias("_all")).scalar()
    share = F.round(
        F.col("total_sales").cast("decimal(20,0)")
        / F.col("overall_sales").cast("decimal(20,0)")
        * 100,
        2,
    ).cast("decimal(9,2)")
    return (
        totals.withColumn("overall_sales", overall)
        .withColumn("percentage_of_total", F.concat(share.cast("string"), F.lit("%")))
        .orderBy(F.desc("total_sales"), F.asc_nulls_last("category"))
    )


def yearly_performance(fact: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    # The bound is on the date itself, so it reaches the scan.
    return (
        _since(fact, f"{min_year:04d}-01-01")
        .groupBy(F.year("order_date").cast("long").alias("order_year"))
        .agg(
            F.sum("gross_sales_amount").alias("total_sales"),
            F.count_distinct("customer_key").alias("total_customers"),
            F.sum("quantity").alias("total_quantity"),
        )
        .orderBy("order_year")
    )


def top_country_category(
    fact: DataFrame, customers: DataFrame, products: DataFrame, k: int = 10
) -> DataFrame:
    """Best country × category pairs over the inner star join."""
    # Joined first: the pairs are so few that the map side sums nearly all of the fact.
    pairs = (
        fact.join(products.select("product_key", "category"), "product_key")
        .join(customers.select("customer_key", "country"), "customer_key")
        .groupBy("country", "category")
        .agg(F.sum("gross_sales_amount").alias("total_revenue"))
    )
    order = [
        F.desc("total_revenue"),
        F.asc_nulls_last("country"),
        F.asc_nulls_last("category"),
    ]
    return top_k(pairs, order, k, "rank")


# --- over the merged frame; NULL groups drop, rounding is half-even ------------


def year_category(merged: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    return (
        _since(merged, f"{min_year:04d}-01-01")
        .filter(F.col("category").isNotNull())
        .groupBy(F.year("order_date").cast("string").alias("order_year"), "category")
        .agg(
            half_even_to_long(F.sum("gross_sales_amount")).alias("category_sales"),
            half_even_to_long(F.avg("unit_price")).alias("avg_price"),
        )
    )


def yearly_rollup(by_category: DataFrame) -> DataFrame:
    yearly = by_category.groupBy("order_year").agg(
        F.sum("category_sales").alias("total_sales"), F.avg("avg_price").alias("_mean")
    )
    # One row per calendar year.
    so_far = Window.orderBy("order_year").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return yearly.select(
        "order_year",
        "total_sales",
        half_even_to_long("_mean").alias("avg_price"),
        F.sum("total_sales").over(so_far).alias("running_total"),
        half_even_to_long(F.avg("_mean").over(so_far)).alias("moving_avg_price"),
    )


def top_products_rounded(merged: DataFrame, k: int = 10) -> DataFrame:
    revenue = (
        merged.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(half_even_to_long(F.sum("gross_sales_amount")).alias("product_revenue"))
    )
    return top_k(revenue, [F.desc("product_revenue"), F.col("product_name")], k)


def grand_total(yearly: DataFrame) -> DataFrame:
    return yearly.agg(F.sum("total_sales").alias("grand_total_revenue"))


def yearly_customers(fact: DataFrame, min_date=MIN_DATE) -> DataFrame:
    """Sales cut to whole numbers, distinct customers, and running sums of both."""
    yearly = (
        _since(fact, min_date)
        .groupBy(F.year("order_date").cast("string").alias("order_year"))
        .agg(
            F.sum("gross_sales_amount").cast("long").alias("total_sales"),
            F.count_distinct("customer_key").alias("total_customers"),
        )
    )
    so_far = Window.orderBy("order_year").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return yearly.withColumns(
        {
            "running_total_sales": F.sum("total_sales").over(so_far),
            "running_total_customers": F.sum("total_customers").over(so_far),
        }
    )


def segment_counts_since(
    fact: DataFrame, min_date=MIN_DATE, vip: float = 5000, months: int = 12
) -> DataFrame:
    """Segments from recent orders only; sales without a customer drop out."""
    recent = _since(fact, min_date).filter(F.col("customer_key").isNotNull())
    return segment_counts(recent, vip, months)


def merged_kpi_totals(fact: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Four totals over the three-way merge."""
    joined = fact.join(products.select("product_key"), "product_key", "left")
    joined = joined.join(customers.select("customer_key"), "customer_key", "left")
    return joined.agg(
        F.sum("gross_sales_amount").alias("total_sales"),
        F.count_distinct("order_number").alias("total_orders"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("customer_key").alias("total_customers"),
    )


def category_share_dropnull(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Share per known category; totals are cut, not rounded, to whole numbers."""
    totals = (
        revenue_by_category(fact, products)
        .filter(F.col("category").isNotNull())
        .select("category", F.col("total_revenue").cast("long").alias("total_sales"))
    )
    overall = totals.agg(F.sum("total_sales").alias("_all")).scalar()
    share = F.bround(F.col("total_sales").cast("double") / overall.cast("double") * 100, 2)
    return totals.withColumn(
        "percentage_of_total", F.concat(share.cast("string"), F.lit("%"))
    )
