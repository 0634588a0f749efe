"""Star schema and the two 360-degree marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import (
    days_between,
    months_between_boundaries,
    packed_text,
    round_to_long,
    safe_divide,
    surrogate_key,
    unpacked_text,
    years_between_boundaries,
)

# Fixed value: mean days per month.
DAYS_PER_MONTH = 30.4375


def dim_customers(customers: DataFrame, demographics: DataFrame, locations: DataFrame) -> DataFrame:
    """CRM customers with ERP birthdate, gender fallback and country."""
    demo = demographics.select(
        F.col("cid").alias("customer_number"), F.col("bdate").alias("birthdate"), "gen"
    )
    loc = locations.select(F.col("cid").alias("customer_number"), F.col("cntry").alias("country"))
    crm = customers.withColumn("customer_number", F.col("cst_key"))
    joined = crm.join(demo, "customer_number", "left")
    joined = joined.join(loc, "customer_number", "left")
    return joined.select(
        surrogate_key("cst_id").alias("customer_key"),
        F.col("cst_id").alias("customer_id"),
        "customer_number",
        F.col("cst_firstname").alias("first_name"),
        F.col("cst_lastname").alias("last_name"),
        "country",
        F.col("cst_marital_status").alias("marital_status"),
        F.coalesce("cst_gndr", "gen").alias("gender"),
        "birthdate",
        F.col("cst_create_date").alias("create_date"),
    )


def dim_products(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Current product versions with their category attributes."""
    lookup = categories.select(
        F.col("id").alias("cat_id"),
        F.col("cat").alias("category"),
        F.col("subcat").alias("subcategory"),
        "maintenance",
    )
    current = products.filter(F.col("prd_end_dt").isNull())
    return current.join(lookup, "cat_id", "left").select(
        surrogate_key("prd_id").alias("product_key"),
        F.col("prd_id").alias("product_id"),
        F.col("prd_key").alias("product_number"),
        F.col("prd_nm").alias("product_name"),
        F.col("cat_id").alias("category_id"),
        "category",
        "subcategory",
        "maintenance",
        F.col("prd_cost").alias("cost"),
        F.col("prd_line").alias("product_line"),
        F.col("prd_start_dt").alias("start_date"),
    )


def fct_sales(sales: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Sales lines with both surrogate keys; unmatched keys stay NULL."""
    cust = customers.select("customer_key", F.col("customer_id").alias("sls_cust_id"))
    prod = products.select("product_key", F.col("product_number").alias("sls_prd_key"))
    joined = sales.join(cust, "sls_cust_id", "left")
    joined = joined.join(prod, "sls_prd_key", "left")
    return joined.select(
        surrogate_key("sls_ord_num", "sls_prd_key").alias("sales_item_key"),
        "customer_key",
        "product_key",
        F.col("sls_ord_num").alias("order_number"),
        F.col("sls_order_dt").alias("order_date"),
        F.col("sls_ship_dt").alias("ship_date"),
        F.col("sls_due_dt").alias("due_date"),
        F.col("sls_quantity").alias("quantity"),
        F.col("sls_price").cast("decimal(38,9)").alias("unit_price"),
        F.col("sls_sales").cast("decimal(38,9)").alias("gross_sales_amount"),
    )


def anchor_date(fact: DataFrame):
    """Last order date of the whole fact as a scalar subquery: one column read, one value."""
    return fact.agg(F.max("order_date").alias("anchor_date")).scalar()


# One sale in so many is counted to tell products with very many sales.
CROWD_SAMPLE = 1024


def crowded_products(sales: DataFrame, crowd: int):
    """Products of about ``crowd`` sales or more as a scalar subquery: an array, mostly empty.

    Counted on a sample chosen by hash, which any line of an order may be in. The array only says
    how sales are dealt out; there are at most as many as crowds fit into the sales.
    """
    drawn = F.xxhash64("order_number", "quantity", "gross_sales_amount")
    counted = sales.filter(F.pmod(drawn, F.lit(CROWD_SAMPLE)) == 0).groupBy("product_key").count()
    crowded = counted.filter(F.col("count") >= F.lit(crowd / CROWD_SAMPLE))
    return crowded.agg(F.collect_list("product_key")).scalar()


def _sold(sales: DataFrame, distinct) -> DataFrame:
    """Volume, reach and first and last day of each product."""
    return sales.groupBy("product_key").agg(
        distinct("order_number").cast("long").alias("total_orders"),
        F.sum("gross_sales_amount").alias("total_sales"),
        F.sum("quantity").alias("total_quantity"),
        distinct("customer_key").cast("long").alias("total_unique_customers"),
        F.max("order_date").alias("last_sale_date"),
        F.min("order_date").alias("_first"),
    )


def sold_products(fact: DataFrame, crowd: int = 500_000) -> DataFrame:
    """``_sold`` of all products, each sale shuffled once, keys packed.

    All sales of a product meet in one task, which counts its orders and customers as sets. Sales
    of crowded products are dealt out by order and by customer instead, which sends each twice.
    """
    sales = fact.filter(F.col("product_key").isNotNull())
    kinds = dict(fact.dtypes)
    found = crowded_products(sales, crowd)
    crowded = (F.size(found) > 0) & F.array_contains(found, F.col("product_key"))

    def packed(column):
        return packed_text(column).alias(column) if kinds[column] == "string" else F.col(column)

    quiet = sales.filter(~crowded).select(
        packed("product_key"),
        "order_number",
        packed("customer_key"),
        "gross_sales_amount",
        "quantity",
        "order_date",
    )
    sold = _sold(quiet.repartition("product_key"), lambda c: F.size(F.collect_set(c)))
    if kinds["product_key"] == "string":
        # Never NULL, and told so: else the join's NULL check is computed through the packing in every scan.
        sold = sold.withColumn("product_key", F.coalesce(unpacked_text("product_key"), F.lit("")))
    return sold.unionByName(_sold(sales.filter(crowded), F.count_distinct))


def product_360(fact: DataFrame, products: DataFrame, tiers=(10000, 50000)) -> DataFrame:
    """Per product: volume, reach, lifespan, recency, tier and safe ratios."""
    mid, high = tiers
    days = days_between("last_sale_date", "_first")
    sold = sold_products(fact).withColumns(
        {
            "total_sales": round_to_long("total_sales"),
            "lifespan_days": days.cast("long"),
            "lifespan_months": F.greatest(F.round(days / F.lit(DAYS_PER_MONTH), 1), F.lit(1.0)),
            "anchor_date": anchor_date(fact),
        }
    )
    names = products.select("product_key", "product_name", "category", "subcategory", "cost")
    return sold.join(names, "product_key").select(
        "product_key",
        "product_name",
        "category",
        "subcategory",
        "cost",
        "last_sale_date",
        months_between_boundaries("anchor_date", "last_sale_date")
        .cast("long")
        .alias("recency_months"),
        F.when(F.col("total_sales") > high, "High-Performer")
        .when(F.col("total_sales") >= mid, "Mid-Range")
        .otherwise("Low-Performer")
        .alias("product_segment"),
        "lifespan_days",
        "lifespan_months",
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_unique_customers",
        F.round(safe_divide("total_sales", "total_quantity"), 2).alias("avg_selling_price"),
        F.round(safe_divide("total_sales", "total_orders"), 2).alias("avg_order_revenue"),
        F.round(
            safe_divide(
                "total_sales", F.coalesce(F.nullif("lifespan_months", F.lit(0)), F.lit(1))
            ),
            2,
        ).alias("avg_monthly_revenue"),
    )


def segment(months, spend, vip: float, min_months: int):
    """VIP / Regular / New by lifespan and spend."""
    settled = F.col(months) >= min_months
    return (
        F.when(settled & (F.col(spend) > vip), "VIP")
        .when(settled & (F.col(spend) <= vip), "Regular")
        .otherwise("New")
    )


def customer_360(fact: DataFrame, customers: DataFrame, vip: float = 5000, months: int = 12) -> DataFrame:
    """Per customer: age, segment, recency, volume and spend ratios."""
    bought = (
        fact.filter(F.col("customer_key").isNotNull())
        .groupBy("customer_key")
        .agg(
            F.count_distinct("order_number").alias("total_orders"),
            round_to_long(F.sum("gross_sales_amount")).alias("total_sales"),
            F.sum("quantity").alias("total_quantity"),
            F.count("product_key").alias("total_products"),
            F.max("order_date").alias("last_order_date"),
            months_between_boundaries(F.max("order_date"), F.min("order_date"))
            .cast("long")
            .alias("lifespan_months"),
        )
        .withColumn("anchor_date", anchor_date(fact))
    )
    people = customers.select(
        "customer_key",
        "customer_number",
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        "birthdate",
    )
    aged = bought.join(people, "customer_key").withColumn(
        "age", years_between_boundaries("anchor_date", "birthdate").cast("long")
    )
    age = F.col("age")
    return aged.select(
        "customer_key",
        "customer_number",
        "customer_name",
        "age",
        F.when(age < 20, "Under 20")
        .when(age.between(20, 29), "20-29")
        .when(age.between(30, 39), "30-39")
        .when(age.between(40, 49), "40-49")
        .otherwise("50 and above")
        .alias("age_group"),
        segment("lifespan_months", "total_sales", vip, months).alias("customer_segment"),
        "last_order_date",
        days_between("anchor_date", "last_order_date").cast("long").alias("recency_days"),
        months_between_boundaries("anchor_date", "last_order_date")
        .cast("long")
        .alias("recency_months"),
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_products",
        "lifespan_months",
        F.round(safe_divide("total_sales", "total_orders"), 2).alias("avg_order_value"),
        F.round(
            safe_divide(
                "total_sales", F.coalesce(F.nullif("lifespan_months", F.lit(0)), F.lit(1))
            ),
            2,
        ).alias("avg_monthly_spend"),
    )
